"""Near-duplicate documents by HyperMinHash: each register keeps the leading-zero count and a few mantissa bits of its
bucket's least hash; bands of registers propose pairs, a collision-corrected estimate thins them out, full shingle sets decide.

Equal sets are one node from the start. A band's bucket proposes its members against its least member only; what those
links leave apart is then compared across, by rare shingles, so that a large group of near copies never becomes all of its
pairs, and yet no pair that meets in a bucket is left undecided unless its two documents already belong together.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, written
from .common import map_slices, mix64, mixer
from .components import connected

#: Registers of a sketch: 2**P buckets; bits of mantissa kept beside the leading-zero count.
P, MANTISSA = 8, 10
BUCKETS = 1 << P
#: Largest chance that a pair just at the threshold meets in no band.
MISS = 1e-8
#: Standard errors of the estimate by which a pair may fall short of the threshold and still be verified.
SLACK = 6.5
#: Expected random collisions of two registers, times 2**MANTISSA, for sets of equal size (a constant of the published analysis).
COLLISIONS = 0.169919487159739093975315012348630288992889
_EMPTY = np.uint16(0xFFFF)
#: Bytes whose words are hashed at once.
PIECE = 1 << 17
#: Sets that meet over one shingle in one task, at most (on average): more are dealt out over shards.
SHARD = 512
#: Ids of documents that are broadcast, at most (about 40 MB).
MOST_IDS = 1 << 20
#: Shingles before it that each shingle of a prefix has with it.
EARLIER = 12

_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_PRIME = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _PRIME and of its inverse modulo 2**64."""
    up = np.cumprod(np.full(n, _PRIME, np.uint64))
    down = np.cumprod(np.full(n, pow(_PRIME, -1, 1 << 64), np.uint64))
    return up, down


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, A-Z lower-cased, and the number of words of each text.

    Words are hashed in runs of about PIECE bytes, which bounds the memory beside the texts and their words.
    """
    parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    begins = np.cumsum([0, *[len(p) + 1 for p in parts]])
    edge = np.flatnonzero(np.diff(_BLANK[data].astype(np.int8), prepend=1))
    start, end = edge[::2], edge[1::2]
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        stop = max(k + 1, int(np.searchsorted(end, start[k] + PIECE, "right")))
        low, high = start[k], end[stop - 1]
        up, down = _powers(max(PIECE, 1 << int(high - low).bit_length()))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(mixer(9)[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = start[k:stop] - low, end[k:stop] - low
        out[k:stop] = mix64((sums[b] - sums[a]) * down[a])
        k = stop
    return out, np.diff(np.searchsorted(start, begins))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of each text; of fewer words, the whole sequence is one."""
    words, counts = word_hashes(texts)
    factor = mixer(10)[:width]
    m = max(0, len(words) - width + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(width):
        rolled += words[j : m + j] * factor[j]
    rolled = mix64(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            h = np.sort(rolled[at : at + c - width + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif c:
            out.append(mix64((words[at : at + c] * factor[:c]).sum(keepdims=True, dtype=np.uint64) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


_FIRST = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - P)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BUCKETS) registers: leading zeros << MANTISSA | mantissa of each bucket's least hash.

    An empty bucket borrows from one that is not, by a sequence of random choices that depends on the bucket alone, so
    small sets agree in as large a share of registers as of elements. A set without elements keeps _EMPTY.
    """
    least = np.zeros((len(sets), BUCKETS), np.uint64)
    bare = np.ones((len(sets), BUCKETS), bool)
    for i, h in enumerate(sets):
        at = np.searchsorted(h, _FIRST)
        ends = np.append(at[1:], len(h))
        full = ends > at
        least[i, full] = h[at[full]]
        bare[i] = ~full
    rest = (least << np.uint64(P)) >> np.uint64(12)  # 52 bits, exact in a double
    part, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.where(rest == 0, 53, 52 - exponent)
    mantissa = np.where(rest == 0, 0, np.floor((2 * part - 1) * (1 << MANTISSA)))
    out = ((zeros.astype(np.int64) << MANTISSA) | mantissa.astype(np.int64)).astype(np.uint16)
    out[bare] = _EMPTY
    some = ~bare.all(1)
    row, col = np.nonzero(bare & some[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        pick = (mix64(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(attempt)) >> np.uint64(64 - P)).astype(np.int64)[col]
        found = ~bare[row, pick]
        out[row[found], col[found]] = out[row[found], pick[found]]
        row, col = row[~found], col[~found]
    return out


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of registers: equal registers less those that collide by chance."""
    big, small = np.maximum(n_a, n_b).astype(float), np.minimum(n_a, n_b).astype(float)
    ratio = small / np.maximum(big, 1)
    chance = COLLISIONS * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(0.0, (a == b).mean(1) - chance) / (1 - chance)


def band_rows(percent: int) -> int:
    """Registers of a band: as many as leave the chance of a miss at the threshold at MISS at most."""
    s, rows = percent / 100, 1
    while rows < BUCKETS and (1 - s ** (rows + 1)) ** (BUCKETS // (rows + 1)) <= MISS:
        rows += 1
    return rows


def band_hashes(regs: np.ndarray, rows: int) -> np.ndarray:
    """(sketches, bands) hashes of the bands, each band with a seed of its own."""
    bands = BUCKETS // rows
    x = regs[:, : bands * rows].astype(np.uint64).reshape(len(regs), bands, rows)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        h = mix64((h + x[:, :, j]) * np.uint64(_PRIME))
    return h


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def sketch(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, n_shingles long, digest (16 bytes of the set), registers (2 * BUCKETS bytes) for every row."""

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            regs = [r.tobytes() for r in registers(sets)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "n_shingles", "digest", "registers"])

        return fn

    return map_slices(docs.select("doc_id", "text"), make, "doc_id long, n_shingles long, digest binary, registers binary")


def _bands(nodes: DataFrame, rows: int) -> DataFrame:
    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            h = band_hashes(_regs(batch.column("registers")), rows)
            spread = lambda name: pa.array(np.repeat(batch.column(name).to_numpy(), h.shape[1]), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), spread("node"), spread("n")], ["bucket", "node", "n"])

        return fn

    return map_slices(nodes.select("node", "n", "registers"), make, "bucket long, node long, n long", rows=1024)


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimated similarity does not rule the threshold out."""
    for side in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = [batch.column(f"n_{k}").to_numpy() for k in "ab"]
            near = similarity(_regs(batch.column("r_a")), _regs(batch.column("r_b")), *n) >= _floor(percent)
            return batch.select(["a", "b"]).filter(pa.array(near))

        return fn

    return map_slices(pairs.where(fits), make, "a long, b long", rows=1024).distinct()


def _floor(percent: int) -> float:
    """The least estimate with which a pair is verified: SLACK standard errors below the threshold."""
    s = percent / 100
    return s - SLACK * (s * (1 - s) / BUCKETS) ** 0.5


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is in `ids` (distinct, cheap to count): up to MOST_IDS are broadcast, so that no text is
    shuffled that is not asked for."""
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_IDS else ids, "doc_id", "left_semi")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold. Texts travel, not sets: they compress.

    `docs` has doc_id and text; where it has registers and n as well, the estimate rules pairs out first, in the same pass.
    """
    judged = "registers" in docs.columns
    if not judged:  # else they are those of the pairs already
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        docs = _only(docs, ids).distinct()  # a repeated row would meet each of its like
    for side in "ab":
        pairs = pairs.join(docs.select(F.col("doc_id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in docs.columns if c != "doc_id"]), side)

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked = np.ones(batch.num_rows, bool)
            if judged:
                n = [batch.column(f"n_{k}").to_numpy() for k in "ab"]
                linked = similarity(_regs(batch.column("registers_a")), _regs(batch.column("registers_b")), *n) >= _floor(percent)
            a, b = (batch.column(f"text_{k}").filter(pa.array(linked)).to_pylist() for k in "ab")
            own = list({*a, *b})
            sets = dict(zip(own, shingle_sets(own, width), strict=True))
            for i, x, y in zip(np.flatnonzero(linked), a, b, strict=True):
                x, y = sets[x], sets[y]
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = both and 100 * both >= percent * (len(x) + len(y) - both)
            return batch.select(["a", "b"]).filter(pa.array(linked))

        return fn

    return map_slices(pairs, make, "a long, b long", rows=128)


def _cross(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of `nodes` (node, c) of different components c that may reach the threshold, by prefix filtering.

    Two sets that reach it share one of their n - ceil(n * percent / 100) + 1 rarest shingles, rarity counted among these
    sets. Near copies that have grown apart show it in shingles of their own and so meet nobody; a shingle that a whole
    component shares makes no pairs within it. Two sets that share several of these come out of the join at the first of
    them, as long as no more than EARLIER of a set's own stand between: the others see an earlier one and keep still.
    """

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            size = np.array([len(x) for x in sets])
            own = np.array([np.bitwise_xor.reduce(x) if len(x) else 0 for x in sets], np.uint64).view(np.int64)
            spread = lambda v: pa.array(np.repeat(v, size), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *(spread(v) for v in (batch.column("node").to_numpy(), own, size, batch.column("c").to_numpy()))], ["h", "node", "own", "n", "c"])

        return fn

    texts = _only(docs, nodes.select(F.col("node").alias("doc_id")).distinct())
    texts = texts.select(F.col("doc_id").alias("node"), "text").join(nodes, "node")
    # rows that repeat a document's set count once, or the prefix would hold copies in place of shingles
    rows = written(map_slices(texts, make, "h long, node long, own long, n long, c long", rows=128).distinct())
    common = rows.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rarest = Window.partitionBy("node", "own").orderBy("df", "h")
    ranked = rows.join(common, "h", "left").withColumn("df", F.coalesce("df", F.lit(1).cast("long"))).withColumn("r", F.row_number().over(rarest))
    ranked = ranked.where(f"r <= n - (n * {int(percent)} + 99) div 100 + 1 and df > 1")
    prefix = written(ranked.withColumn("earlier", F.collect_list("h").over(rarest.rowsBetween(-EARLIER, -1))).select("h", "node", "n", "c", "r", "earlier"))
    forget(rows)
    heads = prefix.groupBy("h").agg(F.min_by("c", "node").alias("l"), F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("m")).where("low <> high")
    met = prefix.join(heads.select("h", "l", F.ceil(F.col("m") / SHARD).cast("int").alias("shards")), "h")
    # of a frequent shingle, one side is dealt out over shards and the other goes to each of them
    x = met.where("c <> l").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).alias("x")
    y = met.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int")).alias("y")
    # what two sets share begins with their first common shingle in this order; there, enough of both must be left
    left = f"(least(x.n - x.r, y.n - y.r) + 1) * {100 + int(percent)} >= (x.n + y.n) * {int(percent)}"
    pairs = x.join(y, ["h", "shard"]).where(f"x.c <> y.c and (y.c = y.l or x.node < y.node) and {left} and not arrays_overlap(x.earlier, y.earlier)")
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), prefix


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Documents are linked where 100 * |A and B| >= percent * |A or B| of their sets of `width`-word shingles; component_id
    is the smallest doc_id that can be reached over links, and kept is doc_id = component_id. Null, empty and blank texts
    have no shingles and are linked with nothing. Rows that repeat a doc_id are one document with several texts: what is
    linked with one of them is linked with it. Rows with null doc_id take no part: component_id null, kept true. Whole
    texts are read; other columns are not. Empty input gives no rows.
    A pair whose similarity is just the threshold is missed with a chance of MISS, and of a higher one with less.
    """
    docs = docs.select("doc_id", "text")
    sketches = written(sketch(docs, width))
    live = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = written(live.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")))
    copies = live.select("digest", "doc_id").join(nodes.select("digest", "node"), "digest").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))

    bands = _bands(nodes, band_rows(percent))
    shared = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(bands.join(shared, "bucket").where("node <> leader"))
    to_leader = members.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    # written, few pairs are known to be few: they travel to the texts
    likely = written(_estimated(to_leader, nodes, percent))
    links = written(_verified(likely, docs, width, percent))

    # buckets in which the leader does not reach all members: what they hold is compared across components
    reached = connected(links)
    of = lambda node, name: reached.select(F.col("node").alias(node), F.col("component").alias(name))
    placed = members.where("size > 2").join(of("node", "c"), "node", "left").join(of("leader", "l"), "leader", "left")
    placed = written(placed.select("bucket", "node", "leader", F.coalesce("c", "node").alias("c"), F.coalesce("l", "leader").alias("l")))
    contested = placed.join(placed.where("c <> l").select("bucket").distinct(), "bucket")
    contested = written(contested.select("node", "c").unionByName(contested.select(F.col("leader").alias("node"), F.col("l").alias("c"))).distinct())
    met, prefix = _cross(contested, docs, width, percent)
    # nearly all of these pairs are as like as their group: what is estimated and what is verified is joined at once
    sides = _only(docs, contested.select(F.col("node").alias("doc_id")).distinct()).distinct().join(nodes.select(F.col("node").alias("doc_id"), "n", "registers"), "doc_id")
    across = written(_verified(met.join(to_leader, ["a", "b"], "left_anti"), sides, width, percent).distinct())
    linked = connected(links.unionByName(copies).unionByName(across))
    forget(likely, links, reached, placed, contested, prefix, across, members, nodes)
    comps = linked.select(F.col("node").alias("doc_id"), "component")
    out = sketches.select("doc_id", "n_shingles").join(comps, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of `docs` that near_duplicates keeps: of each group, the document with the smallest id. Null ids stay."""
    gone = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
