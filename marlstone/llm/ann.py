"""Nearest neighbours by adaptive dimension scans: vectors are rotated at random and dealt to inverted lists; a scan of a
probed list goes through blocks of columns, and a hypothesis test on the partial distance abandons candidates early.

After t of d rotated columns, partial distance * d / t estimates the whole; a candidate is abandoned where that exceeds
the query's bound by more than the factor (1 + ERROR / sqrt(t))**2. What survives is measured on the original vectors.

Each query probes as many lists as it needs. Its nearest lists come first, until they hold more than k vectors; the k-th
distance found there is its bound, and of the other lists only those follow that can hold anything within it: a list
whose centre is further away than the bound and the list's own radius together is passed over. A few queries are asked of
all lists that are left; how far down a query's list of lists their neighbours were is where the others stop.

Lists grow with the root of the table. Where there are more than the sample has vectors to place, centres are of two
levels: a centre of the first, and one of the second, shared by all, for what is left of the vector. Both are small
tables, so distances from all pairs of them are sums of a few products.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import forget, written
from .common import map_slices, ship

#: Numbers in the sample that the lists of a dimension are fitted on, at most, and its vectors, at most.
SAMPLE_VALUES, SAMPLE_ROWS = 1 << 21, 1 << 15
#: Sampled vectors to a centre, at least, and the centres of a level, at most.
PER_LIST, MAX_CENTERS = 16, 2048
#: Queries that are asked of every list that can hold a neighbour, before the others' stop is set.
TESTED = 128
#: Different dimensions beyond which a table is refused.
MAX_DIMENSIONS = 64
#: Columns of a block, and the test's factor.
COLUMNS, ERROR = 16, 2.1
#: Vectors and queries that meet in one group, at most (on average, where ids are hashed).
BLOCK, QUERY_BLOCK = 8192, 4096
_SCANNED = 256


@dataclass
class Lists:
    """The inverted lists of one dimension. Those of several are numbered on: the first one's number is `base`.

    List i * len(inner) + j has the centre outer[i] + inner[j].
    """

    base: int
    rotation: np.ndarray  # (d, d)
    outer: np.ndarray  # (centres of the first level, d), double
    inner: np.ndarray  # (centres of the second, d), double; one level has a single one, the origin
    held: np.ndarray  # vectors in each list
    radius: np.ndarray  # distance of each list's furthest vector from its centre; minus infinity for an empty list
    stop: int = 1 << 62  # how many of the other lists, the nearest first, a query probes at most


def _squares(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (q * q).sum(1)[:, None] - 2 * (q @ x.T) + (x * x).sum(1)


def _own_list(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i : i + 2048], centers).argmin(1) for i in range(0, len(x), 2048)])


def place(x: np.ndarray, outer: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(list, distance from its centre) of each vector."""
    first = _own_list(x, outer)
    rest = x.astype(np.float64) - outer[first]
    second = _own_list(rest, inner) if len(inner) > 1 else np.zeros(len(x), np.int64)
    return first * len(inner) + second, np.sqrt(((rest - inner[second]) ** 2).sum(1))


def _means(sample: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """k-means centres."""
    centers = sample[rng.choice(len(sample), n, replace=False)].copy()
    for _ in range(10 if n > 1 else 1):
        own = _own_list(sample, centers)
        size = np.bincount(own, minlength=n)
        sums = np.stack([np.bincount(own, sample[:, j], n) for j in range(sample.shape[1])], 1)
        centers = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centers).astype(np.float32)
    return centers.astype(np.float64)


def fit(sample: np.ndarray, total: int, base: int = 0, seed: int = 17) -> Lists:
    """Rotation and k-means centres from the sample: half the root of `total` lists, in two levels where one has too few."""
    rng, (n, d) = np.random.default_rng(seed), sample.shape
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.float32)
    most = int(max(1, min(n / PER_LIST, MAX_CENTERS)))
    wanted = max(1.0, total**0.5 / 2)
    outer, inner = _means(sample, min(int(wanted), most), rng), np.zeros((1, d))
    if wanted >= 2 * len(outer):
        rest = (sample - outer[_own_list(sample, outer)]).astype(np.float32)
        inner = _means(rest, min(int(wanted / len(outer)), most), rng)
    lists = len(outer) * len(inner)
    return Lists(base, rotation, outer, inner, np.zeros(lists, np.int64), np.full(lists, -np.inf))


def center_distances(lists: Lists, q: np.ndarray) -> np.ndarray:
    """(queries, lists) distances from the centres, in double precision."""
    q = q.astype(np.float64)
    near = _squares(q, lists.outer)
    if len(lists.inner) > 1:  # |q - a - b|² = |q - a|² + |b|² - 2 q b + 2 a b
        a, b = lists.outer, lists.inner
        near = near[:, :, None] + ((b * b).sum(1) - 2 * (q @ b.T))[:, None, :] + 2 * (a @ b.T)[None]
    return np.sqrt(np.maximum(0, near.reshape(len(q), -1)))


def first_lists(lists: Lists, away: np.ndarray, k: int) -> np.ndarray:
    """(queries, lists) booleans: the nearest lists, until they hold more than k vectors: the query may be among them."""
    order = np.argsort(np.where(lists.held > 0, away, np.inf), 1, kind="stable")
    before = np.cumsum(lists.held[order], 1) - lists.held[order]
    first = np.zeros(away.shape, bool)
    np.put_along_axis(first, order, (before <= k) & (lists.held[order] > 0), 1)
    return first


def other_places(lists: Lists, away: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
    """(queries, lists): the place from 1, the nearest first, of each list besides first_lists that can hold a vector within
    the bound; 0 for the rest."""
    slack = 1e-6 * (1 + away)
    can = (away - lists.radius - slack <= bound[:, None]) & (lists.held > 0) & ~first_lists(lists, away, k)
    order = np.argsort(np.where(can, away, np.inf), 1, kind="stable")
    out = np.zeros(away.shape, np.int64)
    np.put_along_axis(out, order, np.arange(1, away.shape[1] + 1)[None], 1)
    return np.where(can, out, 0)


def other_lists(lists: Lists, away: np.ndarray, k: int, bound: np.ndarray) -> np.ndarray:
    """(queries, lists) booleans: those of other_places, up to the stop."""
    places = other_places(lists, away, k, bound)
    return (places > 0) & (places <= lists.stop)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of row i of q and row i of x, in double precision."""
    return np.sqrt(((q.astype(np.float64) - x) ** 2).sum(1))


def scan(rotation: np.ndarray, q: np.ndarray, bound: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that survive all blocks of columns; a pair within the bound is abandoned with small chance only.

    Vectors are taken relative to the candidates' mean; what rounding may still add to the first block is allowed for.
    """
    mean = x.mean(0, dtype=np.float64)
    q, x = ((v - mean).astype(np.float32) for v in (q, x))
    d, limit = x.shape[1], (bound * bound) * (1 + 1e-5)
    rq, columns = q @ rotation, np.ascontiguousarray((x @ rotation).T)
    t = min(COLUMNS, d)
    first = np.maximum(0, _squares(rq[:, :t], columns[:t].T))
    rounding = 1e-6 * ((rq[:, :t] ** 2).sum(1)[:, None] + (columns[:t] ** 2).sum(0))
    who, what = np.nonzero((first - rounding) * (d / t) <= (limit * (1 + ERROR / t**0.5) ** 2)[:, None])
    part = ((rq[who, :t] - columns[:t, what].T) ** 2).sum(1)
    while t < d:
        end = min(t + COLUMNS, d)
        part = part + ((rq[who, t:end] - columns[t:end, what].T) ** 2).sum(1)
        t = end
        factor = 1.0 if t == d else d / t / (1 + ERROR / t**0.5) ** 2
        on = part * factor <= limit[who] * (1 + 1e-5) + 1e-12
        who, what, part = who[on], what[on], part[on]
    return who, what


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float32).reshape(len(parts), -1)


def _search(rotations: dict[int, np.ndarray], k: int, number: int, vectors: pa.Table, queries: pa.Table) -> pa.Table:
    """The k nearest vectors of a block, within the bound, of each query, and the list's number.

    Without a bound, the block's own 2 k measured vectors are never abandoned.
    """
    found = []
    if vectors.num_rows and queries.num_rows:
        x, ids = _matrix(vectors["v"]), vectors["vec_id"].to_numpy()
        all_q, all_ids, bounds = _matrix(queries["v"]), queries["query_id"].to_numpy(), queries["bound"].to_numpy()
        d = x.shape[1]
        rotation = rotations[d]
        for at in range(0, len(all_q), _SCANNED):
            q, own, bound = all_q[at : at + _SCANNED], all_ids[at : at + _SCANNED], bounds[at : at + _SCANNED]
            spared = np.zeros((2, 0), np.int64)
            if len(x) > 2 * k:  # what the block itself allows: the 2 k nearest after the first columns, measured
                t = min(COLUMNS, d)
                first = _squares((q @ rotation[:, :t]), x @ rotation[:, :t])
                first[own[:, None] == ids[None, :]] = np.inf
                near = np.argpartition(first, 2 * k - 1, 1)[:, : 2 * k]
                local = _distances(np.repeat(q, 2 * k, 0), x[near.ravel()]).reshape(near.shape).max(1)
                free = np.flatnonzero(np.isinf(bound))
                spared = np.stack([np.repeat(free, 2 * k), near[free].ravel()])
                bound = np.minimum(bound, np.where(np.isinf(np.take_along_axis(first, near, 1)).any(1), np.inf, local))
            who, what = np.unique(np.concatenate([scan(rotation, q, bound, x), spared], 1), axis=1) if spared.size else scan(rotation, q, bound, x)
            other = own[who] != ids[what]
            who, what = who[other], what[other]
            score = _distances(q[who], x[what])
            order = np.lexsort((ids[what], score, who))
            order = order[score[order] <= bound[who[order]]]
            who = who[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            order, who = order[place < k], who[place < k]
            found.append((own[who], ids[what[order]], score[order]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(np.full(len(columns[0]), number, np.int32))], ["query_id", "vec_id", "score", "list"])


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part, one a vec_id.

    Out go null ids, null, empty and zero vectors, and those with null or non-finite numbers. Of rows that repeat a
    vec_id, the least vector stays. Vectors of several dimensions may stand side by side.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<float>").alias("embedding"))
    return good.where(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _sampled(whole: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Of each dimension, the vectors of lowest hash: SAMPLE_ROWS and SAMPLE_VALUES at most.

    Rows below a hash that follows from their number are fetched, about a fifth more than needed; nothing is sorted by Spark.
    """
    most = {d: max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // d)) for d in sizes}
    cut = {d: min(1 << 62, int((1.2 * most[d] + 200) / n * (1 << 62))) for d, n in sizes.items()}
    below = F.element_at(F.create_map(*[x for d, v in cut.items() for x in (F.lit(d), F.lit(v).cast("long"))]), F.size("embedding"))
    rows = whole.withColumn("h", F.shiftrightunsigned(F.xxhash64("vec_id"), 2)).where(F.col("h") < below).collect()
    by: dict[int, list] = {d: [] for d in sizes}
    for r in rows:
        by[len(r["embedding"])].append((r["h"], r["vec_id"], r["embedding"]))
    return {d: np.array([v for _, _, v in sorted(found, key=lambda f: f[:2])[: most[d]]], np.float32) for d, found in by.items() if found}


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`.

    Euclidean distance in double precision on the original vectors, ties to the smaller vec_id; all candidates where
    there are fewer than k. A query is no candidate of its own; candidates are the vectors of its own dimension. See
    `clean` for the rows that take part; without any, the result is empty. More than MAX_DIMENSIONS dimensions raise a
    ValueError. Other columns are not read.

    The scans' tests can miss a neighbour, and so can the stop: the nearest lists are probed, of those that can hold a
    neighbour, as far as the neighbours of TESTED queries were found that had no stop; with fewer queries, none stops.
    The lists are fitted on a bounded sample (SAMPLE_VALUES, SAMPLE_ROWS), and every vector is in one. A list of many vectors or queries is cut
    into blocks by hashes of ids, so its size burdens no single task; each block sends a query's k nearest at most, and
    these are thinned out again before they are shuffled.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = written(clean(vectors))
    sizes = {r["d"]: r["n"] for r in whole.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).limit(MAX_DIMENSIONS + 1).collect()}
    if len(sizes) > MAX_DIMENSIONS:
        raise ValueError(f"vectors of more than {MAX_DIMENSIONS} dimensions")
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    samples, index, base = _sampled(whole, sizes), {}, 0
    for d in sorted(sizes):
        index[d] = fit(samples.get(d, np.zeros((1, d), np.float32)), sizes[d], base)
        base += len(index[d].held)
    deal = spark.sparkContext.broadcast({d: (m.base, m.outer, m.inner) for d, m in index.items()})

    def dealt():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [np.array(v, np.float32) for v in batch.column("embedding").to_pylist()]
            size, own, away = np.array([len(v) for v in rows]), np.zeros(len(rows), np.int32), np.zeros(len(rows))
            for d in np.unique(size).tolist():
                at, (first, outer, inner) = np.flatnonzero(size == d), deal.value[d]
                number, away[at] = place(np.stack([rows[i] for i in at]), outer, inner)
                own[at] = first + number
            return pa.RecordBatch.from_arrays([pa.array(own), batch.column("vec_id"), pa.array([v.tobytes() for v in rows], pa.binary()), pa.array(away)], ["list", "vec_id", "v", "away"])

        return fn

    placed = written(map_slices(whole, dealt, "list int, vec_id long, v binary, away double"))
    forget(whole)
    stats = {r["list"]: r for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()}  # a row a list
    for m in index.values():
        for i in range(len(m.held)):
            if m.base + i in stats:
                m.held[i], m.radius[i] = stats[m.base + i]["n"], stats[m.base + i]["radius"]
    rotations = {d: m.rotation for d, m in index.items()}
    asked = placed.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")

    def matrix(raw: list[bytes], d: int) -> np.ndarray:
        return np.frombuffer(b"".join(raw), np.float32).reshape(-1, d)

    def probing(bounded: bool):
        known = spark.sparkContext.broadcast(index)

        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, lists = batch.column("v").to_pylist(), [None] * batch.num_rows
            size, bound = np.array([len(v) // 4 for v in raw]), batch.column("bound").to_numpy()
            for d in np.unique(size).tolist():
                at, m = np.flatnonzero(size == d), known.value[d]
                away = center_distances(m, matrix([raw[i] for i in at], d))
                which = other_lists(m, away, k, bound[at]) if bounded else first_lists(m, away, k)
                for i, row in zip(at, which, strict=True):
                    lists[i] = m.base + np.flatnonzero(row)
            return pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), batch.column("bound"), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "v", "bound", "lists"])

        return lambda: fn

    def found(queries: DataFrame, bounded: bool) -> tuple[DataFrame, DataFrame]:
        """What the lists that `queries` (query_id, v, bound) probe hold within their bounds, and the table behind it."""
        probes = written(map_slices(queries, probing(bounded), "query_id long, v binary, bound double, lists array<int>", rows=64))
        pairs = probes.select(F.explode("lists").alias("list"), "query_id", "v", "bound")
        n_asked = {r["list"]: r["count"] for r in pairs.groupBy("list").count().collect()}  # a row a list
        cuts = [(i, -(-stats[i]["n"] // BLOCK), -(-n // QUERY_BLOCK)) for i, n in n_asked.items()]
        cuts = F.broadcast(spark.createDataFrame(cuts, "list int, shards int, chunks int"))  # of the lists that are probed
        every_chunk, every_shard = (F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("chunks", "shards"))
        left = placed.join(cuts, "list").withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int")).select("list", "vec_id", "v", "shard", every_chunk.alias("chunk"))
        right = pairs.join(cuts, "list").withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int")).select("list", "query_id", "v", "bound", "chunk", every_shard.alias("shard"))
        keys = ["list", "shard", "chunk"]
        search = lambda key, a, b: _search(rotations, k, key[0].as_py(), a, b)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double, list int"), probes

    def best(rows: DataFrame) -> DataFrame:
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        return rows.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "list")

    near, probes = found(asked.withColumn("bound", F.lit(float("inf"))), False)
    near = written(best(near))
    forget(probes)
    bounds = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    bounded = asked.join(bounds, "query_id", "left").select("query_id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    # a few queries are asked of all lists; the others stop where the last of these queries' neighbours was
    lot = F.xxhash64("query_id", F.lit(1))
    few = bounded.orderBy(lot, "query_id").limit(TESTED).collect()  # TESTED rows
    tested = F.broadcast(spark.createDataFrame([(r["query_id"],) for r in few], "query_id long"))
    exact, probes = found(bounded.join(tested, "query_id", "left_semi"), True)
    answered = best(near.join(tested, "query_id", "left_semi").select("query_id", "vec_id", "score", "list").unionByName(exact))
    answered = written(answered)
    forget(probes)
    held: dict[int, set] = {}
    for r in answered.collect():  # k rows a tested query
        held.setdefault(r["query_id"], set()).add(r["list"])
    for d, m in index.items():
        own = [r for r in few if len(r["v"]) == 4 * d]
        if own:
            places = other_places(m, center_distances(m, matrix([r["v"] for r in own], d)), k, np.array([r["bound"] for r in own]))
            m.stop = max((int(row[i - m.base]) for r, row in zip(own, places, strict=True) for i in held.get(r["query_id"], ())), default=0)
    further, _ = found(bounded.join(tested, "query_id", "left_anti"), True)
    others = best(near.join(tested, "query_id", "left_anti").select("query_id", "vec_id", "score", "list").unionByName(further))
    return answered.unionByName(others).drop("list")
