"""Bounded training samples: the same rows on every run and at every partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of a class, where it has so many, however many classes share the sample; classes beyond which sampling refuses.
FLOOR, MAX_CLASSES = 16, 512
#: Keys that are fetched for one that is wanted: some turn out to have no usable text.
SPARE = 1.25
_RANGE = 1 << 62


def candidates(rows: DataFrame, key: str, cls: str, total: int, max_classes: int = MAX_CLASSES, spare: float = SPARE) -> tuple[int, dict[object, list]]:
    """(share, {class: keys}): the share of each class in a sample of `total`, and its keys in order of hash, spare * share or all.

    `rows` has key and class; nulls in either are passed over, and a key that repeats counts once a class. The share is
    FLOOR at least. Every class has one: more than `max_classes` raise a ValueError, for none is left out silently.
    The hash below which a class is fetched follows from its number of rows, so each task sends little, nothing is
    sorted, and what reaches the driver is bounded by a small multiple of `total`; where repeated rows make that too
    few keys, the bound is raised for that class alone.
    """
    rows = rows.select(F.col(key).alias("k"), F.col(cls).alias("c")).where(F.col("k").isNotNull() & F.col("c").isNotNull())
    todo = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()}
    if len(todo) > max_classes:
        raise ValueError(f"more than {max_classes} different values of {cls}")
    share, factor, out = max(FLOOR, total // max(1, len(todo))), 1.5 * spare, {}
    most = math.ceil(spare * share)
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.col("k").cast("string")), 2))
    while todo:
        cut = {c: min(_RANGE, math.ceil((factor * share + 64) / n * _RANGE)) for c, n in todo.items()}
        below = F.element_at(F.create_map(*[x for c, v in cut.items() for x in (F.lit(c), F.lit(v).cast("long"))]), F.col("c"))
        found: dict[object, list] = {c: [] for c in todo}
        for r in hashed.where(F.col("c").isin(list(todo)) & (F.col("h") < below)).distinct().collect():
            found[r["c"]].append((r["h"], r["k"]))
        for c, keys in found.items():
            if len(keys) >= most or cut[c] == _RANGE:
                out[c] = [k for _, k in sorted(keys)][:most]
                del todo[c]
        factor *= 16
    return share, out


def chosen(spark: SparkSession, keys: dict[object, list], key: str) -> DataFrame:
    """The candidates as a one-column table of longs, at most SPARE times the sample, marked for broadcasting."""
    return F.broadcast(spark.createDataFrame([(k,) for k in sorted({k for ks in keys.values() for k in ks})], f"{key} long"))


def settled(share: int, keys: dict[object, list], usable: set) -> dict:
    """{key: class} of the first `share` usable keys of each class; a key of several classes has the least of them."""
    out = {}
    for c in sorted(keys):
        for k in [k for k in keys[c] if k in usable][:share]:
            out.setdefault(k, c)
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None, sample: int, chars: int) -> tuple[int, dict[object, list], DataFrame | None]:
    """(share, {label: keys}, texts): candidates among the labels 0 and 1 where `learn` (on doc_id) holds, and the rows
    doc_id, text of those that have a text of 1 to `chars` characters; of rows that repeat an id, the least text.

    The labels choose, so the documents are read once. No labels: no texts (None).
    """
    known = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    share, keys = candidates(known.where(learn) if learn is not None else known, "doc_id", "label", sample)
    if not keys:
        return share, keys, None
    pool = docs.select("doc_id", "text").join(chosen(docs.sparkSession, keys, "doc_id"), "doc_id", "left_semi")
    return share, keys, pool.where(F.length("text").between(1, chars)).groupBy("doc_id").agg(F.min("text").alias("text"))
