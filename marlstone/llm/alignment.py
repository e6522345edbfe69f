"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) and a piece BPE (B) cover the same bytes, and how many
documents link each pair of ids.

A pair of ids is packed into one int64, A's id above B's. Tasks count their documents' distinct pairs with np.unique; the
partial counts are sorted globally by range partitions, and runs of one key are summed as they stream by. Each range is a
shard: two arrays, keys and counts, in a file each of the shared folder, which tasks map into memory and search.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import forget, shared_dir, written
from .bpe import _WHOLE, ByteBpe, default_vocabulary
from .common import map_slices, ship

#: Distinct words that each encoder of a task remembers; beyond that it keeps those of its slice at hand.
REMEMBERED = 300_000
#: Rows and bytes of a slice; partial counts that a task holds before it hands them on; rows of a batch that it hands on.
ROWS, BYTES, PARTIAL, BATCH = 512, 1 << 20, 1 << 21, 1 << 16
_LOW = (1 << 32) - 1


def pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


class BlankBpe(ByteBpe):
    """A: encodes a blank and the text. Strings of special tokens are plain text."""

    def encode(self, texts: list[str | None]) -> list[bytes]:
        made = []
        for t in texts:
            if not t:
                made.append([])
            elif t.split() == t.replace("\n", " ").split(" "):  # units as in ByteBpe; the first stands behind a blank, too
                made.append(t.replace("\n", " \n").split(" "))
            else:
                made.append([_WHOLE + w for w in self.split.findall(" " + t)])
        wanted = set().union(*made)
        if len(self.cache) + len(wanted) > REMEMBERED:
            self.cache = {u: self.cache[u] for u in wanted if u in self.cache}
        self._learn(list(wanted.difference(self.cache)))
        return [b"".join(map(self.cache.__getitem__, units)) for units in made]


class Pieces:
    """B: a piece vocabulary with byte fallback, which puts a blank before the text.

    No piece holds a blank behind another character, and none a line feed: so a text is cut before its runs of blanks and
    its line feeds, and every distinct unit is encoded once. A unit that begins with a line feed stands as it is; any other
    is kept without the blank before it.
    """

    _CUT = re.compile(r"\n[^ \n]*| +[^ \n]*")

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        if any(" " in p.decode("utf-8", "replace").lstrip(" ") or b"\n" in p for i, p in enumerate(self.bytes) if not self.model.is_byte(i)):
            raise ValueError("pieces that cross words cannot be encoded word by word")
        self.lengths = np.array([len(p) for p in self.bytes], np.int64)
        self.blank = self.model.piece_to_id("▁")
        self.cache: dict[str, bytes | None] = {}

    def _learn(self, units: list[str]) -> None:
        """Put the ids of units into the cache; None where their bytes are not those of the unit."""
        if not units:
            return
        made = self.model.encode(units, num_threads=1)
        for k, u in enumerate(units):
            if not u:
                made[k] = [self.blank]
            elif u[0] == "\n":
                made[k] = made[k][1:]  # the blank that was put before it
        own = [(u if u[:1] == "\n" else " " + u).encode("utf-8", "surrogatepass") for u in units]
        n = np.array([len(ids) for ids in made], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(made), np.int32, n.sum())
        ends = np.append(0, np.cumsum(n))
        whole = np.diff(np.append(0, np.cumsum(self.lengths[ids]))[ends]) == np.array([len(x) for x in own])
        if not whole.all() or b"".join([self.bytes[i] for i in ids.tolist()]) != b"".join(own):
            whole = [ok and b"".join([self.bytes[i] for i in row]) == x for ok, row, x in zip(whole.tolist(), made, own, strict=True)]
        raw, at = ids.tobytes(), (4 * ends).tolist()
        self.cache.update((u, raw[a:b] if ok else None) for u, a, b, ok in zip(units, at, at[1:], whole, strict=False))

    def encode(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids as little-endian int32 bytes; None where their bytes are not those of a blank and the text."""
        made = []
        for t in texts:
            if not t:
                made.append([])
            elif t.split() == t.replace("\n", " ").split(" "):
                made.append(t.replace("\n", " \n").split(" "))
            else:
                made.append([u if u[0] == "\n" else u[1:] for u in self._CUT.findall(" " + t)])
        wanted = set().union(*made)
        if len(self.cache) + len(wanted) > REMEMBERED:
            self.cache = {u: self.cache[u] for u in wanted if u in self.cache}
        self._learn(list(wanted.difference(self.cache)))
        out, odd = [], {u for u in wanted if self.cache[u] is None}
        for units in made:
            out.append(None if odd and not odd.isdisjoint(units) else b"".join(map(self.cache.__getitem__, units)))
        return out


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = BlankBpe(a_path), Pieces(b_path)
        ids_a, ids_b = (list(map(str, range(len(v.lengths)))) for v in (self.a, self.b))
        self.words = [i + end for i in ids_a for end in ",|"] + [i + end for i in ids_b for end in (",", ";", "")]
        self.first_b = 2 * len(ids_a)

    def align(self, texts: list[str | None]) -> list[np.ndarray | list]:
        """n_a, n_b, n_groups, n_links, groups, then the distinct pairs of each text: keys, times and the number of them."""
        raw_a, raw_b = self.a.encode(texts), self.b.encode(texts)
        ok = [bool(t) and y is not None for t, y in zip(texts, raw_b, strict=True)]
        a, b = (np.frombuffer(b"".join([r for r, good in zip(raw, ok, strict=True) if good]), np.int32) for raw in (raw_a, raw_b))
        n_a, n_b = (np.array([len(r) // 4 if good else 0 for r, good in zip(raw, ok, strict=True)], np.int64) for raw in (raw_a, raw_b))
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        doc_end = np.append(0, ends_a)[np.cumsum(n_a)]
        if not np.array_equal(doc_end, np.append(0, ends_b)[np.cumsum(n_b)]):
            raise AssertionError("both tokenizers keep all bytes of a text")
        # every stretch between neighbouring ends of either side is one link
        cuts = np.concatenate([ends_a, ends_b])
        cuts.sort(kind="stable")
        cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])] if len(cuts) else cuts
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        common = cuts[(ends_a[at_a] == cuts) & (ends_b[at_b] == cuts)]
        link_doc, group_doc = (np.searchsorted(doc_end, x) for x in (cuts, common))  # empty texts end where the one before does
        m, bits_b = len(texts), int(len(self.b.lengths)).bit_length()
        bits = bits_b + int(len(self.a.lengths)).bit_length()
        flat = link_doc << bits | a[at_a].astype(np.int64) << bits_b | b[at_b]
        flat.sort()
        new = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(flat)))
        flat = flat[new]
        keys = pack(flat >> bits_b & ((1 << (bits - bits_b)) - 1), flat & ((1 << bits_b) - 1))
        distinct = np.bincount(flat >> bits, minlength=m)
        count = lambda doc: np.bincount(doc, minlength=m)
        return [n_a, n_b, count(group_doc), count(link_doc), self._groups(a, b, ends_a, ends_b, common, doc_end, n_a + n_b), keys, times, distinct]

    def _groups(self, a, b, ends_a, ends_b, common, doc_end, n) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of each text: tokens of both sides in the order of groups, each with what follows it."""
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        before_b = np.searchsorted(ends_b, np.append(0, common), "right")  # tokens of B in the groups before
        upto_a = np.searchsorted(ends_a, common, "right")
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + before_b[group_a]] = 2 * a.astype(np.int64) + (ends_a == common[group_a])
        last = (ends_b == common[group_b]).astype(np.int64)
        code[np.arange(len(b)) + upto_a[group_b]] = self.first_b + 3 * b.astype(np.int64) + last * (1 + np.isin(ends_b, doc_end))
        word, stop = list(map(self.words.__getitem__, code.tolist())), np.cumsum(n).tolist()
        return ["".join(word[i:j]) for i, j in zip([0, *stop], stop, strict=False)]


@functools.cache
def load(a_path: str, b_path: str) -> Aligner:
    """One a Python worker."""
    return Aligner(a_path, b_path)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def align(docs: DataFrame, a_vocabulary: str | None = None, b_model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups string, pairs array<long>, times array<int> for every row of `docs`.

    A encodes a blank and the text, B the text, before which it puts a blank itself; neither adds or knows special tokens.
    Tokens are laid over the bytes; where both sides end, a group ends. A link is a token of A and one of B whose bytes
    overlap; `pairs` are a document's distinct linked pairs of ids (A's in the upper 32 bits), `times` how often each is
    linked. Null and empty texts, and those that B does not give back byte by byte, have no tokens, no links and empty
    groups. Texts of any length are aligned whole. Other columns are not read; nothing is shuffled.
    """
    paths = (a_vocabulary or default_vocabulary(), b_model or default_pieces())

    def make():
        aligner = load(*paths)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_a, n_b, groups, links, told, keys, times, distinct = aligner.align(batch.column("text").to_pylist())
            ends = pa.array(np.append(0, np.cumsum(distinct)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, kind)) for v, kind in ((keys, pa.int64()), (times, pa.int32()))]
            numbers = [pa.array(v, pa.int64()) for v in (n_a, n_b, groups, links)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(told, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"])

        return fn

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema, rows=ROWS, limit=BYTES)


def _batches(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + BATCH]) for c in columns], names)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, n of a task's documents, by np.unique; at most about PARTIAL of them are held."""
    keys, n, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def merged():
        every, which = np.unique(np.concatenate([keys, *waiting]), return_inverse=True)
        return every, np.bincount(which, np.concatenate([n, np.ones(size, np.int64)]), len(every)).astype(np.int64)

    for batch in batches:
        waiting.append(batch.column("pairs").flatten().to_numpy())
        size += len(waiting[-1])
        if size >= PARTIAL:
            (keys, n), waiting, size = merged(), [], 0
            if len(keys) >= PARTIAL:
                yield from _batches([keys, n], ["key", "n"])
                keys, n = keys[:0], n[:0]
    yield from _batches(list(merged()), ["key", "n"])


class Shards:
    """Arrays of int64 in the shared folder, one a file: mapped into memory where the folder is mounted, else fetched."""

    def __init__(self, uri: str, mounted: bool | None = None):
        where = urlparse(uri)
        self.mounted = where.scheme in ("", "file") if mounted is None else mounted
        self.uri, self.path = uri, unquote(where.path)

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def put(self, name: str, parts: Iterator[np.ndarray]) -> None:
        """Write `name` whole and then give it its name: a task that runs twice leaves one file, the same either time."""
        for_now = f"{name}.{uuid.uuid4().hex}"
        if self.mounted:
            os.makedirs(self.path, exist_ok=True)
            with open(f"{self.path}/{for_now}", "wb") as f:
                for p in parts:
                    f.write(p.tobytes())
            os.replace(f"{self.path}/{for_now}", f"{self.path}/{name}")
            return
        system, path = self._system()
        system.create_dir(path)
        with system.open_output_stream(f"{path}/{for_now}") as f:
            for p in parts:
                f.write(p.tobytes())
        system.move(f"{path}/{for_now}", f"{path}/{name}")

    def get(self, name: str) -> np.ndarray:
        if self.mounted:
            return np.memmap(f"{self.path}/{name}", np.int64, "r")
        system, path = self._system()
        with system.open_input_file(f"{path}/{name}") as f:
            return np.frombuffer(f.read(), np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of a sorted stream of (key, n): runs of one key are summed, across batches too."""
    key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        key, n = np.append(key, batch.column("key").to_numpy()), np.append(n, batch.column("n").to_numpy())
        if not len(key):
            continue
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key, n = key[start], np.add.reduceat(n, start)
        yield key[:-1], n[:-1]
        key, n = key[-1:], n[-1:]
    if len(key):
        yield key, n


class Counts:
    """How many documents link each pair of ids: sorted shards in the shared folder, and what is known of them."""

    def __init__(self, shards: Shards, index: list[tuple[int, int]], best: np.ndarray):
        self.shards, self.index, self.best = shards, sorted(index), best
        self.firsts = np.array([first for first, _ in self.index], np.int64)
        self._open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys; 0 for one that no document has."""
        out = np.zeros(len(keys), np.int64)
        place = np.searchsorted(self.firsts, keys, "right") - 1
        edges = np.searchsorted(place, np.arange(len(self.index) + 1))
        for k in np.unique(place[place >= 0]).tolist():
            if k not in self._open:
                name = self.index[k][1]
                self._open[k] = self.shards.get(f"{name}.keys"), self.shards.get(f"{name}.counts")
            known, counts = self._open[k]
            asked = keys[edges[k] : edges[k + 1]]
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            out[edges[k] : edges[k + 1]] = np.where(known[at] == asked, counts[at], 0)
        return out


def vocabulary_size(path: str | None = None) -> int:
    """Ids of A, special tokens included."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def count_pairs(aligned: DataFrame, ids: int, mounted: bool | None = None) -> Counts:
    """Counts of the documents (rows of `aligned`, with pairs) that hold each pair linked.

    `ids` is the number of A's ids. What reaches the driver is a row a shard and the highest count of each id of A.
    """
    spark = aligned.sparkSession
    ship(spark)
    shards = Shards(shared_dir(spark), mounted)
    partial = written(aligned.select("pairs").mapInArrow(_partial, "key long, n long"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, first, most, counts = TaskContext.get().partitionId(), [], {}, []

        def keys():
            for key, n in _summed(batches):
                if len(key):
                    first.append(int(key[0]))
                    counts.append(n)
                    ids = key >> 32
                    start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    for a, top in zip(ids[start].tolist(), np.maximum.reduceat(n, start).tolist(), strict=True):
                        most[a] = max(top, most.get(a, 0))
                    yield key

        stream = keys()
        begun = next(stream, None)
        if begun is None:
            return
        shards.put(f"{name}.keys", (part for rest in ([begun], stream) for part in rest))
        shards.put(f"{name}.counts", iter(counts))
        yield from _batches([np.full(1, name), np.array(first[:1]), np.full(1, -1), np.full(1, -1)], ["shard", "first", "a", "best"])
        yield from _batches([np.full(len(most), name), np.full(len(most), -1), np.array(list(most)), np.array(list(most.values()))], ["shard", "first", "a", "best"])

    made = written(partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(shard, "shard long, first long, a long, best long"))
    index = [(r["first"], r["shard"]) for r in made.where("a = -1").collect()]  # a row a range
    best = np.zeros(ids, np.int64)
    for r in made.where("a >= 0").groupBy("a").agg(F.max("best").alias("best")).collect():  # a row an id of the vocabulary
        best[r["a"]] = r["best"]
    forget(partial, made)
    return Counts(shards, index, best)


def with_counts(aligned: DataFrame, counts: Counts) -> DataFrame:
    """`aligned` (with pairs and times) and n_best, count_sum long in place of them.

    n_best are the links whose pair has the highest count of its A id, ties included; count_sum sums the counts over links.
    """
    spark = aligned.sparkSession
    sent = spark.sparkContext.broadcast(counts)
    kept = [c for c in aligned.columns if c not in ("pairs", "times", "n_best", "count_sum")]

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            known, lists = sent.value, batch.column("pairs")
            keys, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            distinct, which = np.unique(keys, return_inverse=True)
            n = known.of(distinct)
            n, top = n[which], (n == known.best[distinct >> 32])[which] if len(distinct) else n[which]
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            totals = [np.diff(np.append(0, np.cumsum(v))[ends]) for v in (times * top, times * n)]
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, pa.int64()) for v in totals)], [*kept, "n_best", "count_sum"])

        return fn

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.select(*kept).schema)
    return map_slices(aligned, make, f"{schema}, n_best long, count_sum long", rows=ROWS, limit=4 * BYTES)
