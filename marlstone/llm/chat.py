"""Chat formatting of reply trees, in DataFrame functions only: iterative self-joins enumerate root-to-leaf paths, branches
are ranked by score, and each chosen path is formatted as one conversation with a loss mask.

The self-joins double: after round k a message knows its 2**k-th ancestor and the scores on the way there, so that a
thread of n messages takes log n rounds. Chosen leaves are then unfolded by the same tables, the longest jump first: each
ancestor is met once, by the binary digits of its distance. Each round is a written table of ids and numbers; texts are
joined once, at the end.

Template: each turn is `<turn ROLE>TEXT</turn>` and a line feed. Inside texts, `<turn` and `</turn` get a backslash behind
their `<`, one more than they have there already, and lose it again when read back; all else stays as it is. In roles, `%` and `>`
are written %25 and %3E.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranged import row_numbers
from ..storage import forget, written

END = "</turn>\n"
#: Rounds of doubling: threads of up to 2**62 messages.
_ROUNDS = 62


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit(">"), F.lit("%3E"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%3E"), F.lit(">")), F.lit("%25"), F.lit("%"))


def _met(rows: DataFrame, table: DataFrame, at: str, *values: Column) -> DataFrame:
    """`rows` joined with the rows of `table` (tree, id, …) whose id they have in `at`; a null tree is a tree like any other."""
    t = table.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), *values)
    return rows.join(t, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col(at) == F.col("_id")))


def branches(messages: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(tree, id, n, score) of every root-to-leaf path by its leaf, the jumps (tree, id, up) by 1, 2, 4 … messages, and the
    written tables that all this reads.

    `messages` has tree, id, parent and score, one row for each id of a tree; n is the number of messages on the path and
    score their mean score, null ones passed over. A parent that is null, the message itself or not there makes a root.
    Messages on a cycle or below one have no root: they are on no path.
    """
    nodes = messages.select("tree", "id", "parent", "score")
    linked = _met(nodes.where("parent <> id"), nodes, "parent").select("tree", "id", "parent")
    up = linked.withColumnRenamed("parent", "up").select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "up")
    start = nodes.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")), "left")
    start = start.select("tree", "id", "up", F.lit(1).cast("long").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"), F.col("score").isNotNull().cast("long").alias("scored"))
    state, jumps, done, waiting = written(start), [], [], None
    tables = [state]
    answered = state.where("up is not null").select("tree", F.col("up").alias("id")).distinct()
    for _ in range(_ROUNDS):
        done.append(state.where("up is null"))
        live = state.where("up is not null")
        left = live.count()
        if not left or left == waiting:  # in a tree fewer messages wait after each round: those left hang on cycles
            break
        waiting = left
        jumps.append(live.select("tree", "id", "up"))
        known = live
        for d in done:
            known = known.unionByName(d)
        further = _met(live, known, "up", F.col("up").alias("_up"), F.col("n").alias("_n"), F.col("sum").alias("_sum"), F.col("scored").alias("_scored"))
        state = written(further.select("tree", "id", F.col("_up").alias("up"), (F.col("n") + F.col("_n")).alias("n"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("scored") + F.col("_scored")).alias("scored")))
        tables.append(state)
    paths = done[0]
    for d in done[1:]:
        paths = paths.unionByName(d)
    a = answered.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    leaves = paths.join(a, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")), "left_anti")
    return leaves.select("tree", "id", "n", F.try_divide("sum", F.col("scored").cast("double")).alias("score")), jumps, tables


def ranked(leaves: DataFrame, best: int | None = None) -> DataFrame:
    """`leaves` with rank from 1 within each tree: the highest score first, those without one last; then more messages, then the smaller id.

    `best` keeps so many branches of each tree (Spark prunes them where they are read); without it, all are kept, and a
    tree's branches are numbered over ranges, so no task needs all of them.
    """
    if best is not None:
        w = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), F.desc("n"), "id")
        return leaves.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= best)
    keyed = leaves.withColumns({"_score": F.coalesce(-F.col("score"), F.lit(float("nan"))), "_n": -F.col("n")})  # NaN comes last
    return row_numbers(keyed, ["_score", "_n", "id"], ["tree"], "rank").drop("_score", "_n")


def unfolded(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """tree, leaf, id, back: every message on the path of each chosen leaf (tree, id, n), `back` messages before it."""
    first = chosen.select("tree", F.col("id").alias("leaf"), "id", "n", F.lit(0).cast("long").alias("back"))
    out = first
    for k in reversed(range(len(jumps))):
        far = out.where(F.col("back") + (1 << k) < F.col("n"))  # the others' roots are nearer
        more = _met(far, jumps[k], "id", F.col("up").alias("_up")).select("tree", "leaf", F.col("_up").alias("id"), "n", (F.col("back") + (1 << k)).alias("back"))
        out = out.unionByName(written(more))
    return out.select("tree", "leaf", "id", "n", "back")


def format_chats(messages: DataFrame, best: int | None = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree_id, leaf_id, rank, score, n_turns, formatted, loss_mask: one row for each chosen branch of each reply tree.

    `messages` has tree_id, message_id (longs), parent_id, role, text and score. `formatted` is the branch in the template,
    root first; `loss_mask` are the places [begin, end) in code points of `formatted` that hold texts of the roles in
    `learn`, as they are escaped there. `best` branches are kept of each tree, by mean score; None keeps all.

    A null tree_id is a tree like any other, null texts and roles are empty, null scores count nowhere. Rows without a
    message_id can be replied to by none and placed nowhere: they are left out, as are messages on cycles. Of rows that
    repeat a message_id, the least (by parent, role, text, score) stays. Other columns are not read; an empty table
    gives no rows. A conversation is one string, so it has to fit a row; texts of any length below that stay whole.
    """
    columns = [F.col("tree_id").cast("long").alias("tree"), F.col("message_id").cast("long").alias("id"), F.struct(F.col("parent_id").cast("long").alias("parent"), "role", "text", F.col("score").cast("double").alias("score")).alias("m")]
    told = messages.select(*columns).where("id is not null").groupBy("tree", "id").agg(F.min("m").alias("m")).select("tree", "id", "m.*")
    told = written(told)
    leaves, jumps, tables = branches(told)
    chosen = written(ranked(leaves, best))
    places = unfolded(chosen, jumps)
    forget(*tables)
    turns = _met(places, told, "id", F.col("role"), F.col("text")).select("tree", "leaf", (F.col("n") - F.col("back")).alias("turn"), "role", "text")
    body = escape(F.coalesce("text", F.lit("")))
    front = F.concat(F.lit("<turn "), _role_out(F.col("role")), F.lit(">"))
    turns = turns.select("tree", "leaf", "turn", F.coalesce(F.col("role").isin(*learn), F.lit(False)).alias("own"), F.length(front).cast("long").alias("skip"), F.concat(front, body, F.lit(END)).alias("piece"))
    size = F.length("piece").cast("long")
    so_far = Window.partitionBy("tree", "leaf").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("end", F.sum(size).over(so_far) - len(END)).withColumn("begin", F.col("end") - size + len(END) + F.col("skip"))
    mask = F.when(F.col("own"), F.struct("begin", "end"))
    made = placed.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("turn", "piece"))).alias("pieces"), F.sort_array(F.collect_list(mask)).alias("loss_mask"))
    made = made.select("tree", "leaf", F.array_join("pieces.piece", "").alias("formatted"), "loss_mask")
    picked = chosen.select(F.col("tree").alias("_tree"), F.col("id").alias("_leaf"), "rank", "score", "n")
    both = made.join(picked, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("leaf") == F.col("_leaf")))
    return both.select(F.col("tree").alias("tree_id"), F.col("leaf").alias("leaf_id"), "rank", "score", F.col("n").alias("n_turns"), "formatted", "loss_mask")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.filter(F.split(formatted, F.lit(END)), lambda p: p != "")
    at = lambda p: F.instr(p, ">")
    return F.transform(pieces, lambda p: F.struct(_role_in(F.substring(p, F.lit(7), at(p) - 7)).alias("role"), unescape(F.substring(p, at(p) + 1, F.length(p))).alias("text")))


def read_learned(formatted: Column, loss_mask: Column) -> Column:
    """array<string> of what stands under the loss mask, unescaped."""
    return F.transform(loss_mask, lambda m: unescape(F.substring(formatted, (m["begin"] + 1).cast("int"), (m["end"] - m["begin"]).cast("int"))))


def linear(rows: DataFrame) -> DataFrame:
    """Messages of reply trees of one branch each, from rows (conv_id, turn, role, text): each answers the one before it.

    Rows are ordered by turn, null turns first, then by role and text. A null conv_id is a conversation like any other.
    Rows are numbered over ranges, so that a conversation of very many turns meets in no task before it is formatted.
    """
    numbered = row_numbers(rows.select("conv_id", "turn", "role", "text"), ["turn", "role", "text"], ["conv_id"], "message_id")
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return numbered.select(F.col("conv_id").alias("tree_id"), "message_id", parent.alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))
