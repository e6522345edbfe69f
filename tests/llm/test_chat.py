"""Reply trees against a recursive walk: paths, ranks, template, loss mask; cycles, orphans, nulls and repeated messages."""

import random
import re

import pytest

from marlstone import storage
from marlstone.llm import chat

SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, leaf_id string, tree int"
HARD = ["", None, "plain", "<turn user>", "</turn>\n", "<\\turn <\\\\/turn", "a\\", "/turn>", "<", "ünï😀 </turn", "\\### Assistant: </turn> ok", "x" * 5000]


@pytest.fixture(autouse=True)
def swept(spark):
    yield
    storage.sweep(spark)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def plain(rows, best):
    """{(tree, leaf): (rank, [(role, text)])} by walking from each leaf to its root."""
    trees = {}
    for tree, i, parent, role, text, score in rows:
        if i is not None:
            own = trees.setdefault(tree, {})
            new = (parent, role, text, score)
            key = lambda m: [(v is not None, v) for v in m]  # noqa: E731  nulls first
            own[i] = min(own.get(i, new), new, key=key)
    out = {}
    for tree, own in trees.items():
        parents = {i: (m[0] if m[0] in own and m[0] != i else None) for i, m in own.items()}
        found = []
        for leaf in own.keys() - set(parents.values()):
            path, at = [], leaf
            while at is not None and len(path) <= len(own):
                path.append(at)
                at = parents[at]
            if at is None:
                path.reverse()
                scores = [own[i][3] for i in path if own[i][3] is not None]
                mean = sum(scores) / len(scores) if scores else None
                found.append(((mean is None, -mean if scores else 0, -len(path), leaf), leaf, [(own[i][1] or "", own[i][2] or "") for i in path]))
        for rank, (_, leaf, turns) in enumerate(sorted(found), 1):
            if best is None or rank <= best:
                out[tree, leaf] = (rank, turns)
    return out


def forest(rng):
    rows = []
    for tree in (1, 2, 3, None):
        n = rng.choice([1, 30, 60])
        for i in range(n):
            parent = None if i == 0 else rng.randrange(max(0, i - rng.choice([1, 2, 9])), i)
            rows.append((tree, i, parent, rng.choice(["user", "assistant", "a>b%", None]), rng.choice(HARD), rng.choice([None, 0.5, 1.0, 2.0, -1.0])))
    rows += [(4, 1, 2, "user", "on a cycle", 1.0), (4, 2, 1, "user", "on a cycle", 1.0), (4, 3, 2, "user", "below it", 1.0)]
    rows += [(5, 1, 1, "user", "own parent", None), (5, 2, 99, "user", "orphan", 3.0), (5, None, 1, "user", "no id", 3.0), (5, 1, 1, "user", "own parent", None), (5, 2, 99, "user", "least", 3.0)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "best"), [(1, None), (2, 1), (3, 2)])
def test_branches_equal_a_walk(spark, seed, best):
    rows = forest(random.Random(seed))
    got = chat.format_chats(frame(spark, rows), best).withColumn("turns", chat.read_turns("formatted")).withColumn("learned", chat.read_learned("formatted", "loss_mask"))
    want, told = plain(rows, best), got.collect()
    assert {(r.tree_id, r.leaf_id) for r in told} == want.keys() and len(told) == len(want)
    for r in told:
        rank, turns = want[r.tree_id, r.leaf_id]
        assert r["rank"] == rank and r.n_turns == len(turns) and [tuple(t) for t in r.turns] == turns
        assert r.learned == [t for role, t in turns if role == "assistant"]
        assert len(re.findall(r"<turn [^>]*>", r.formatted)) == r.formatted.count("</turn>") == len(turns)


def test_a_long_thread_takes_few_rounds(spark):
    rows = [(1, i, i - 1 if i else None, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(700)]
    _, jumps, tables = chat.branches(frame(spark, rows).selectExpr("tree_id tree", "message_id id", "parent_id parent", "score"))
    assert len(jumps) == 10
    storage.forget(*tables)
    (r,) = chat.format_chats(frame(spark, rows)).withColumn("turns", chat.read_turns("formatted")).collect()
    assert [t.text for t in r.turns] == [f"t{i}" for i in range(700)] and len(r.loss_mask) == 350


def test_one_message_with_very_many_replies(spark):
    rows = [(1, 0, None, "user", "q", None)] + [(1, i, 0, "assistant", f"a{i}", float(i % 50)) for i in range(1, 2000)]
    got = chat.format_chats(frame(spark, rows), None).select("leaf_id", "rank").collect()
    assert len(got) == 1999 and sorted(r["rank"] for r in got) == list(range(1, 2000))
    assert [r.leaf_id for r in got if r["rank"] == 1] == [49]


def test_no_messages_and_rows_as_conversations(spark):
    assert chat.format_chats(frame(spark, [])).count() == 0
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (None, 3, None, "alone"), (1, 1, "assistant", "a"), (1, None, "system", "s"), (1, 1, "assistant", "a")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.tree_id: [tuple(t) for t in r.turns] for r in chat.format_chats(chat.linear(table)).withColumn("turns", chat.read_turns("formatted")).collect()}
    assert got == {1: [("system", "s"), ("user", ""), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")], None: [("", "alone")]}
    assert chat.format_chats(chat.linear(table.limit(0))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.format_chats(frame(spark, forest(random.Random(9))))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
