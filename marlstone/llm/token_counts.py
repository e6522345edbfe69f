"""Token counts as an exact histogram of encoded lengths; suffix sums over it answer for every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from ..storage import written
from .common import map_slices

#: Lengths in a block: suffix sums run within blocks and over the blocks' totals.
BLOCK = 256


def token_lengths(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One long n_tokens for each row of `docs`; null and empty texts have 0. Whole texts; nothing is shuffled."""
    path = vocabulary or bpe.default_vocabulary()

    def make():
        encoder = bpe.load(path)
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([len(r) // 4 for r in encoder.encode(batch.column(0).to_pylist())], pa.int64())], ["n_tokens"])

    return map_slices(docs.select("text"), make, "n_tokens long", rows=bpe.ROWS, limit=bpe.BYTES)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs: how many documents have each length. Summed up before the shuffle, so a frequent length is no burden."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as the context limit: what fits and what is cut.

    docs_at_least and tokens_at_least count documents of at least that length; truncated_total is the tokens left when
    every document is cut to it; quantile is the share of documents of at most that length, so the least length with
    quantile >= q is the exact q-quantile. Any other limit is answered by `at_limit`. An empty histogram gives no rows.
    The suffix sums take two levels, so that no task gets more than BLOCK lengths or one row a block.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"), F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("d", F.sum("docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(blocks, "block")
    at_least, tokens = F.col("d") + F.col("d_after"), F.col("t") + F.col("t_after")
    return h.select(
        "n_tokens", "docs", at_least.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("t_all") - tokens + F.col("n_tokens") * at_least).alias("truncated_total"), ((F.col("d_all") - at_least + F.col("docs")) / F.col("d_all")).alias("quantile"),
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens kept and documents cut when every document is cut to `limit` tokens; 0 for an empty histogram."""
    n, d = F.col("n_tokens"), F.col("docs")
    return histogram.agg(F.coalesce(F.sum(F.least(n, F.lit(limit)) * d), F.lit(0)).alias("truncated_total"), F.coalesce(F.sum(F.when(n > limit, d)), F.lit(0)).alias("docs_cut"))


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """context_limits of the lengths of all texts of `docs`. Ids, ties and repeated rows play no part: each row counts.

    The histogram, which has a row for each length that occurs, is written once: its two uses don't encode twice.
    """
    return context_limits(written(length_histogram(token_lengths(docs, vocabulary))))
