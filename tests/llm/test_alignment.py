"""Alignment against the tokenizer libraries, byte by byte, and counts against a dictionary; shards mapped and fetched."""

import collections
import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone import storage
from marlstone.llm import alignment

HARD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n b\n\nc \n", "\tx\r\ny", "nul\x00 byte", "▁x", "a▁", "<s> </s> <unk> <|endoftext|>", "don't stop", "日本語 テキスト", "😀😀 é́ ﬁ\xa0x", "word " * 400, "x" * 3000, "… z", "12 345", "   \n   "]
WORDS = ["the", "Straße", "été", "alpha,", "(beta)", "\n", "x1", "—", "unbelievably"]


def texts(rng, n):
    return HARD + [rng.choice([" ", " ", "\n"]).join(rng.choice(WORDS) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    chars = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in chars} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in chars)}
    vocab = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, vocab, b


def brute(libraries, text):
    """(groups, links) of one text; None where it has no tokens."""
    a, vocab, b = libraries
    if not text:
        return None
    want = (" " + text).encode()
    side_a = [(i, vocab[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    side_b = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if any(b"".join(x for _, x in side) != want for side in (side_a, side_b)):
        return None
    spans = []
    for side in (side_a, side_b):
        at, own = 0, []
        for i, x in side:
            own.append((i, at, at + len(x)))
            at += len(x)
        spans.append(own)
    links = [(i, j) for i, p, q in spans[0] for j, r, s in spans[1] if max(p, r) < min(q, s)]
    common, begin, groups = sorted({q for _, _, q in spans[0]} & {q for _, _, q in spans[1]}), 0, []
    for end in common:
        groups.append("|".join(",".join(str(i) for i, p, q in side if begin <= p and q <= end) for side in spans))
        begin = end
    return [len(side_a), len(side_b), len(groups), len(links), ";".join(groups)], links


@pytest.mark.parametrize("seed", [1, 2])
def test_alignment_equals_the_libraries(libraries, seed):
    import public_tokenizers

    own = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rows = texts(random.Random(seed), 25)
    n_a, n_b, groups, links, told, keys, times, distinct = own.align(rows)
    at = 0
    for k, text in enumerate(rows):
        head, pairs = brute(libraries, text) or ([0, 0, 0, 0, ""], [])
        assert [n_a[k], n_b[k], groups[k], links[k], told[k]] == head, text
        mine = {(int(x) >> 32, int(x) & 0xFFFFFFFF): int(t) for x, t in zip(keys[at : at + distinct[k]], times[at : at + distinct[k]], strict=True)}
        assert mine == collections.Counter(pairs)
        at += distinct[k]
    assert [len(v) for v in own.align([None, ""])[5:7]] == [0, 0]


@pytest.mark.parametrize("mounted", [True, False])
def test_counts_equal_a_dictionary(spark, libraries, mounted):
    rows = texts(random.Random(7), 60) * 2 + ["the the"] * 90
    table = spark.createDataFrame([(k if k % 9 else None, t, "x", "y") for k, t in enumerate(rows)], "doc_id long, text string, pairs string, n_best string").repartition(6)
    aligned = storage.written(alignment.align(table))
    counts = alignment.count_pairs(aligned, alignment.vocabulary_size(), mounted)
    got = sorted(str(tuple(r)) for r in alignment.with_counts(aligned, counts).collect())
    made = [brute(libraries, t) or ([0, 0, 0, 0, ""], []) for t in rows]
    held = collections.Counter(p for _, links in made for p in set(links))
    best = collections.defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    want = [(k if k % 9 else None, *head, sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links)) for k, (head, links) in enumerate(made)]
    assert got == sorted(map(str, want))
    keys = np.array(sorted(alignment.pack(np.array([i]), np.array([j]))[0] for i, j in held))
    assert counts.of(keys).tolist() == [held[int(x) >> 32, int(x) & 0xFFFFFFFF] for x in keys] and counts.of(np.array([-5, 3])).tolist() == [0, 0]
    if mounted:
        assert all(isinstance(m, np.memmap) for m in counts._open[0]) and not [f for f in os.listdir(counts.shards.path) if f.count(".") > 1]
    storage.sweep(spark)


def test_no_documents_and_no_pairs(spark):
    for rows in ([], [(1, None), (2, "")]):
        aligned = storage.written(alignment.align(spark.createDataFrame(rows, "doc_id long, text string")))
        got = alignment.with_counts(aligned, alignment.count_pairs(aligned, alignment.vocabulary_size())).drop("groups").collect()
        assert sorted(tuple(r) for r in got) == [(i, 0, 0, 0, 0, 0, 0) for i, _ in rows]


def test_partial_counts_and_runs_over_batches(monkeypatch):
    monkeypatch.setattr(alignment, "PARTIAL", 50)
    monkeypatch.setattr(alignment, "BATCH", 7)
    rng = np.random.default_rng(1)
    lists = [np.unique(rng.integers(0, 200, 30)).tolist() for _ in range(40)]
    batches = [pa.RecordBatch.from_arrays([pa.array(lists[k : k + 3], pa.list_(pa.int64()))], ["pairs"]) for k in range(0, 40, 3)]
    partial = list(alignment._partial(iter(batches)))
    want = collections.Counter(x for own in lists for x in own)
    rows = sorted((k, n) for b in partial for k, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True))
    stream = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[k : k + 5], strict=True)], ["key", "n"]) for k in range(0, len(rows), 5)]
    summed = [(int(k), int(n)) for keys, counts in alignment._summed(iter(stream)) for k, n in zip(keys, counts, strict=True)]
    assert summed == sorted(want.items()) and len(rows) > len(summed)


def test_the_query_hides_nothing_of_the_groups(spark, libraries):
    from marlstone.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in queries.documents(spark, folder).collect()}
    rows = queries.op11_token_alignment(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in [r for r in rows if len(docs[r.doc_id] or "") < 3000][::7]:  # the comparison is quadratic in a text's length
        head, _ = brute(libraries, docs[r.doc_id]) or ([0, 0, 0, 0, ""], [])
        assert [r.n_a, r.n_b, r.n_groups, r.n_links] == head[:4]
        assert r.groups_sha256 == (hashlib.sha256(head[4].encode()).hexdigest() if head[4] else "")
    storage.sweep(spark)
