"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A leak is a place where, laid over a benchmark item without gaps, at least MATCHES of WINDOW consecutive words agree.
The two masks are lossless for that: whichever two of thirteen words are substituted, one of the masks, somewhere in the
window, selects only words that agree. So what the hash join finds, verified, is all there is. An item of fewer than
WINDOW words, but of LEAST, leaks where it stands whole, word for word: its first LEAST words are a seed of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW, MATCHES = 13, 11
#: Word positions that each mask looks at; the others may differ.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Words of the shortest item that is looked for.
LEAST = 8
#: Words of the benchmark up to which its seeds are broadcast (about 45 MB); beyond it, they are joined by a shuffle.
BROADCAST_WORDS = 100_000
#: Places of the documents that share a seed and meet in one task of that shuffle: more are dealt out.
PLACES = 100_000
#: What separates words, as a regular expression.
BREAKS = r"[^\p{L}\p{N}\p{M}]+"

_SPAN = min(m[-1] for m in MASKS) + 1
_BACK = WINDOW - _SPAN  # how far a window may begin before a seed


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and marks. Null and empty texts have none."""
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BREAKS, " ")), " ")


def _hashed(text: Column) -> Column:
    """64-bit hashes of the words: what is compared from here on. Unlike words share one with a chance of 5e-20."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(table: DataFrame, short: bool, items: bool = False) -> DataFrame:
    """`table` (with words) and one row for each place and mask: the place as `at`, the hash as `seed`.

    With `short`, each place has the hash of its LEAST words as well; of `items`, only the first place of short ones.
    """
    at, size = F.col("at"), F.size("words")
    # outer, for a filter on the words would be pushed below what makes them, and make them twice
    places = F.when(size >= LEAST, F.sequence(F.lit(0), size - LEAST)) if short else F.when(size >= WINDOW, F.sequence(F.lit(0), size - _SPAN))
    placed = table.withColumn("at", F.explode_outer(places)).where(F.col("at").isNotNull())
    hashes = []
    for k, mask in enumerate(MASKS):
        seen = F.xxhash64(F.lit(k), *[F.get("words", at + o) for o in mask])
        hashes.append(F.when((size >= WINDOW) & (at + mask[-1] < size), seen) if short or mask[-1] >= _SPAN else seen)
    if short:
        seen = F.xxhash64(F.lit(len(MASKS)), *[F.get("words", at + o) for o in range(LEAST)])
        hashes.append(F.when((size < WINDOW) & (at == 0), seen) if items else seen)
    return placed.withColumn("seed", F.explode(F.array(*hashes))).where(F.col("seed").isNotNull())


def _met(texts: DataFrame, seeds: DataFrame, short: bool) -> DataFrame:
    """doc_id, words, at, item_id, near, short of the places that share a seed, for a benchmark too large to broadcast.

    Only ids, places and seeds of the documents are shuffled, a seed in as many parts as the documents' places that share
    it fill tasks of PLACES, so that a passage that many documents share is not one task's; what meets is joined with the
    words again.
    """
    keyed = texts.withColumn("key", F.xxhash64("words"))  # rows of one doc_id may have several texts
    slim = _seeds(keyed, short).select("doc_id", "key", "at", "seed").join(seeds.select("seed").distinct().hint("merge"), "seed", "left_semi")
    counts = slim.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / PLACES).cast("int").alias("salts")).where("salts > 1").hint("merge")
    parts = F.coalesce("salts", F.lit(1))
    slim = slim.join(counts, "seed", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), parts).cast("int")).drop("salts")
    spread = seeds.join(counts, "seed", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("salts")
    # sizes are not guessed from the small tables that all this is made of: both joins sort
    met = slim.join(spread.hint("merge"), ["seed", "salt"]).select("doc_id", "key", "at", "item_id", "near", "short").distinct()
    return met.join(keyed.hint("merge"), ["doc_id", "key"]).select("doc_id", "words", "at", "item_id", "near", "short")


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, best_match int: one row for each document and item that it leaks.

    best_match is the most agreeing words of any window of 13; of an item of 8 to 12 words, which leaks where a document
    holds it whole, their number. Shorter items cannot be told from chance and are not looked for; items of 13 words and
    more are not found in documents of fewer. Null ids, null and empty texts have no leak.
    Rows that repeat an id are one document (or item) with several texts: their leaks add up. Very long texts are
    searched whole; other columns are not read. With a benchmark of up to BROADCAST_WORDS words, only confirmed hits
    are shuffled, and those are summed up first.
    """
    items = benchmark.select(F.col("item_id"), _hashed(F.col("text")).alias("words")).where(F.col("item_id").isNotNull())
    size = F.size("words")
    known = items.where(size >= LEAST).agg(F.sum(size).alias("n"), F.coalesce(F.bool_or(size < WINDOW), F.lit(False)).alias("short")).first()
    n_words, short = known["n"] or 0, known["short"]
    at = F.col("at")
    near = F.transform(F.sequence(F.lit(-_BACK), F.lit(WINDOW - 1)), lambda j: F.get("words", at + j))
    seeds = _seeds(items, short, items=True).select("seed", "item_id", near.alias("near"), F.when(size < WINDOW, size).alias("short")).distinct()

    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", _hashed(F.col("text")).alias("words"))
    hits = _seeds(texts, short).join(F.broadcast(seeds), "seed") if n_words <= BROADCAST_WORDS else _met(texts, seeds, short)
    # bit k of `mask`: word at - _BACK + k agrees. The largest count is filtered only once it is summed up: as a condition
    # of the join, it would be part of the code that each seed runs through, and too long for the JVM to compile
    same = [F.get("words", at + k - _BACK) == F.get("near", F.lit(k)) for k in range(_BACK + WINDOW)]
    mask = reduce(lambda x, y: x.bitwiseOR(y), [F.when(v, 1 << k).otherwise(0) for k, v in enumerate(same)])
    hits = hits.select("doc_id", "item_id", "short", mask.alias("mask"))
    agreeing = [F.bit_count(F.shiftright("mask", o).bitwiseAND(F.lit((1 << WINDOW) - 1))) for o in range(_BACK + 1)]
    best = F.max(F.when(F.col("short").isNull(), F.greatest(*agreeing))).alias("best")
    if not short:
        return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best").alias("best_match")).where(F.col("best_match") >= MATCHES)
    whole = F.max(F.when(agreeing[_BACK] == F.col("short"), F.col("short"))).alias("whole")
    found = hits.groupBy("doc_id", "item_id").agg(best, whole).withColumn("best", F.when(F.col("best") >= MATCHES, F.col("best")))
    return found.select("doc_id", "item_id", F.greatest("best", "whole").alias("best_match")).where(F.col("best_match").isNotNull())


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id has no leak; rows with null doc_id stay. The leaking ids are not collected."""
    leaking = find_leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaking, "doc_id", "left_anti").select(*docs.columns)
