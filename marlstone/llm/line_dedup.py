"""Line deduplication: lines' hashes ranged over partitions in the order (hash, document descending, position),
streamed once, and answered with a compressed keep bitmap for each document that loses lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .common import ascii_lower, fresh, map_slices, ship

#: What counts as blank at a line's ends: [\x20\x09-\x0D].
BLANK = " \t\n\x0b\x0c\r"
_OUT = "part int, h1 long, h2 long, doc_id long, place long, n_docs long, first_doc long, last_doc long"


def _place(text: Column, pos: Column) -> Column:
    """One long of a 31-bit digest of the row's text and the line's number: rows of one doc_id with unlike texts differ."""
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF)), 32).bitwiseOR(pos.cast("long"))


def _stream(min_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a partition that is sorted by (h1, h2, doc descending, place).

    A run of one hash that lies inside the partition is judged here: with enough documents, all its rows but those of
    the first document are dropped. The first and the last run may go on in a neighbouring partition: their rows are
    passed on as open, with a summary row (place -1) of their documents. At any time, one batch and the rows of at most
    `min_docs` documents of one run are held.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    key, held, n, first, last, border, dropping = None, [], 0, None, None, True, False

    def out(h, doc, pos, n_docs=None, first_doc=None, last_doc=None):
        m = len(doc)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, h[0])), pa.array(np.full(m, h[1])), pa.array(doc, pa.int64()), pa.array(pos, pa.int64())] + [pa.array([v] * m, pa.int64()) for v in (n_docs, first_doc, last_doc)],
            ["part", "h1", "h2", "doc_id", "place", "n_docs", "first_doc", "last_doc"],
        )

    def closed(at_end: bool):
        """What is left of the run that ends: its held rows if it is open, and its summary."""
        if key is not None and (border or at_end):
            yield from held if not border else []
            yield out(key, np.array([first]), np.array([-1]), n, first, last)

    for batch in batches:
        h1, h2, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
        # whole runs of fewer rows than min_docs inside the batch cannot be dropped: they are skipped at numpy's speed
        edges = np.concatenate([[0], cut, [len(h1)]])
        size = np.diff(edges)
        big = (size >= min_docs) | (np.arange(len(size)) == 0) | (np.arange(len(size)) == len(size) - 1)
        for k in np.flatnonzero(big):
            a, b = edges[k], edges[k + 1]
            if (h1[a], h2[a]) != key:
                if key is not None:
                    yield from closed(False)
                    border = False
                key, held, n, first, last, dropping = (h1[a], h2[a]), [], 0, None, None, False
            elif k > 0:
                raise ValueError("the input is not sorted")
            d, p = doc[a:b], pos[a:b]
            new = np.empty(len(d), bool)
            new[0], new[1:] = d[0] != last, d[1:] != d[:-1]
            n += int(new.sum())
            first, last = d[0] if first is None else first, d[-1]
            if border:  # the partition's first run: open as it stands
                yield out(key, d, p)
                continue
            later = d != first
            rows = out(key, d[later], p[later])
            if dropping:
                yield rows.set_column(5, "n_docs", pa.array([-1] * rows.num_rows, pa.int64()))
                continue
            held.append(rows)
            if n >= min_docs:
                dropping = True
                for r in held:
                    yield r.set_column(5, "n_docs", pa.array([-1] * r.num_rows, pa.int64()))
                held = []
    yield from closed(True)


def duplicate_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, partitions: int | None = None) -> DataFrame:
    """(doc_id, place) of the lines to drop, from a written table; the low 32 bits of place are the line's number.

    A key held by at least `min_docs` distinct documents keeps its lines only in the document with the largest id.
    Range partitioning over (hash, doc, place) splits the rows of a frequent line over as many partitions as they fill;
    what their runs know of one another is two summary rows a partition.
    """
    spark = docs.sparkSession
    ship(spark)
    line = F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")
    lines = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", "text", line)
    lines = lines.select("doc_id", _place(F.col("text"), F.col("pos")).alias("place"), F.trim(F.col("line"), F.lit(BLANK)).alias("key")).where(F.length("key") >= min_chars).withColumn("key", ascii_lower(F.col("key")))
    rows = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "place")
    order = ["h1", "h2", F.desc("doc_id"), "place"]
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda it: _stream(min_docs, it), _OUT))

    runs = told.where("place = -1")  # at most two a partition
    beside = Window.partitionBy("h1", "h2").orderBy("part")
    runs = runs.withColumn("again", (F.lag("last_doc").over(beside) == F.col("first_doc")).cast("long"))
    runs = runs.groupBy("h1", "h2").agg((F.sum("n_docs") - F.coalesce(F.sum("again"), F.lit(0))).alias("docs"), F.max("first_doc").alias("keeper")).where(F.col("docs") >= min_docs)
    closed = told.where("place >= 0 and n_docs = -1").select("doc_id", "place")
    opened = told.where("place >= 0 and n_docs is null").join(F.broadcast(runs), ["h1", "h2"]).where("doc_id <> keeper").select("doc_id", "place")
    return closed.unionByName(opened)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_digest, dropped (long), bitmap (binary) for each document that loses lines.

    Bit i of the zlib-compressed bitmap (lowest bit of a byte first) is 1 where line i stays; lines beyond its end stay.
    Rows that repeat a doc_id count as one document; text_digest (31 bits) tells those with unlike texts apart. Rows
    with null doc_id lose nothing and count nowhere. Empty input gives no rows. Other columns are not read.
    """
    places = duplicate_lines(docs, min_chars, min_docs)
    places = places.select("doc_id", F.shiftright("place", 32).alias("text_digest"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("line"))
    gone = places.groupBy("doc_id", "text_digest").agg(F.collect_set("line").alias("gone"))

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            maps, dropped = [], []
            for g in batch.column("gone").to_pylist():
                bits = np.ones((max(g) // 8 + 1) * 8, np.uint8)
                bits[g] = 0
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
                dropped.append(len(g))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_digest"), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "text_digest", "dropped", "bitmap"])

        return fn

    return map_slices(gone, make, "doc_id long, text_digest long, dropped long, bitmap binary", rows=2048)


def keep_lines(text: str, bitmap: bytes | None) -> tuple[str, int, int]:
    """(kept text, lines before, lines dropped)."""
    lines = text.split("\n")
    if bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[: len(lines)].tolist()
    bits += [1] * (len(lines) - len(bits))
    kept = [s for s, b in zip(lines, bits, strict=True) if b]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of `docs` with its text reduced to the kept lines, plus n_lines (before) and n_dropped.

    Null and empty texts are one empty line and come back empty. Columns named n_lines or n_dropped are replaced; all
    others stay, whatever their names. The join is by doc_id and digest; text is shuffled once.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
    digest, bitmap = fresh("text_digest", kept), fresh("bitmap", kept)
    keyed = docs.select(*kept, "text", F.shiftright(_place(F.col("text"), F.lit(0)), 32).alias(digest))
    maps = bitmaps.select("doc_id", F.col("text_digest").alias(digest), F.col("bitmap").alias(bitmap))
    # sorted and merged at every size: a broadcast that only small inputs allow would say nothing of large ones
    joined = keyed.join(maps.hint("merge"), ["doc_id", digest], "left").select(*kept, "text", bitmap)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["text string, n_lines long, n_dropped long"])

    def make():
        def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [keep_lines(t or "", b) for t, b in zip(batch.column("text").to_pylist(), batch.column(bitmap).to_pylist(), strict=True)]
            text, n, gone = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*kept, "text", "n_lines", "n_dropped"])

        return fn

    return map_slices(joined, make, schema)


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` without repeated lines: keep_bitmaps, then apply_bitmaps."""
    return apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
