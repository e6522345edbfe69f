"""Scans of long series without one task for all: row numbers, fills, running products and peaks, the row before.

A table is ranged over partitions in the order of the scan. What a range needs to know of those before it is one row of
summaries; these rows are scanned themselves, a row a range and series, and each is put before the first row of its own
range as a seed. A window within a range then goes on from its seed, so neither a series nor the whole table ever meets
in one task. Orders are ascending, nulls first, by columns that together tell a series' rows apart.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

_PART, _SEED = "_part", "_seed"


def ranges(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """`df` as a written table, ranged by `within` and then `order`, with the range of each row as `_part`."""
    by = [F.col(f"`{c}`") for c in (*within, *order)]
    dealt = df.repartitionByRange(*by) if partitions is None else df.repartitionByRange(partitions, *by)
    return written(dealt.withColumn(_PART, F.spark_partition_id()))


def _names(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _at(order: Sequence[str]) -> Column:
    return F.struct(*_names(order))


def seeded(ranged: DataFrame, within: Sequence[str], summary: Mapping[str, Column], seed: Callable[[str, Window], Column]) -> DataFrame:
    """The rows of `ranges` and one seed row (`_seed` true) for each range and series, its other columns null.

    `summary` are aggregates of a range by the column that they seed; `seed` makes a column's seed of it, over the ranges
    before. Nulls are a series of their own.
    """
    before = Window.partitionBy(*_names(within)).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*_names(within), _PART).agg(*[c.alias(n) for n, c in summary.items()])
    seeds = parts.select(*_names(within), _PART, *[seed(n, before).alias(n) for n in summary])
    kinds = {f.name: f.dataType for f in ranged.schema}
    rest = [F.lit(None).cast(kinds[c]).alias(c) for c in ranged.columns if c not in (*within, _PART, *summary)]
    seeds = seeds.select(*seeds.columns, *rest, F.lit(True).alias(_SEED))
    return ranged.withColumn(_SEED, F.lit(False)).unionByName(seeds)


def _past(within: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*_names(within), _PART).orderBy(F.desc(_SEED), *_names(order))


def _so_far(within: Sequence[str], order: Sequence[str]) -> Window:
    return _past(within, order).rowsBetween(Window.unboundedPreceding, 0)


def _kept(df: DataFrame, *columns: str) -> DataFrame:
    """Without the seeds."""
    return df.where(~F.col(_SEED)).select(*_names(columns))


def row_numbers(df: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "row_number", partitions: int | None = None) -> DataFrame:
    """`df` with the place of each row in its series, from 1. A column called `name` is replaced."""
    columns = [c for c in df.columns if c != name]
    ranged = ranges(df.select(*_names(columns)), order, within, partitions).withColumn(name, F.lit(1).cast("long"))
    rows = seeded(ranged, within, {name: F.sum(f"`{name}`")}, lambda n, w: F.coalesce(F.sum(f"`{n}`").over(w), F.lit(0)).cast("long"))
    return _kept(rows.withColumn(name, F.sum(f"`{name}`").over(_so_far(within, order))), *columns, name)


def forward_fill(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Each null of `columns` (by default all but order and within) takes the last value before it; leading nulls stay."""
    todo = list(columns if columns is not None else [c for c in df.columns if c not in (*order, *within)])
    if set(todo) & {*order, *within}:
        raise ValueError("a column of the order cannot be filled along it")
    ranged = ranges(df, order, within, partitions)
    last = {c: F.max_by(f"`{c}`", F.when(F.col(f"`{c}`").isNotNull(), _at(order))) for c in todo}
    rows = seeded(ranged, within, last, lambda n, w: F.last(f"`{n}`", ignorenulls=True).over(w))
    made = rows.withColumns({c: F.last(f"`{c}`", ignorenulls=True).over(_so_far(within, order)) for c in todo})
    return _kept(made, *df.columns)


def rows_before(df: DataFrame, order: Sequence[str], columns: Mapping[str, str], within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """`df` with values of the row before in its series: `columns` maps new names to those that are read. The first has nulls."""
    ranged = ranges(df, order, within, partitions)
    shown = {new: F.col(f"`{old}`") for new, old in columns.items()}
    ranged = ranged.withColumns(shown)
    rows = seeded(ranged, within, {n: F.max_by(f"`{n}`", _at(order)) for n in columns}, lambda n, w: F.lag(f"`{n}`").over(Window.partitionBy(*_names(within)).orderBy(_PART)))
    return _kept(rows.withColumns({n: F.lag(f"`{n}`").over(_past(within, order)) for n in columns}), *[c for c in df.columns if c not in columns], *columns)


def running_max(df: DataFrame, value: str, order: Sequence[str], within: Sequence[str] = (), name: str = "peak", partitions: int | None = None) -> DataFrame:
    """`df` with the highest value so far, nulls passed over. NaN counts as the highest, as in Spark's order."""
    columns = [c for c in df.columns if c != name]
    ranged = ranges(df, order, within, partitions).withColumn(name, F.col(f"`{value}`"))
    rows = seeded(ranged, within, {name: F.max(f"`{name}`")}, lambda n, w: F.max(f"`{n}`").over(w))
    return _kept(rows.withColumn(name, F.max(f"`{name}`").over(_so_far(within, order))), *columns, name)


def running_product(df: DataFrame, factor: str, order: Sequence[str], within: Sequence[str] = (), name: str = "equity", partitions: int | None = None) -> DataFrame:
    """`df` with the product of the factors so far, null ones passed over; 0 from a factor of 0 or below on.

    The scan carries the sum of logarithms and whether a factor has ruined the series: both join in any grouping.
    """
    columns = [c for c in df.columns if c != name]
    f = F.col(f"`{factor}`")
    ranged = ranges(df, order, within, partitions).withColumns({"_log": F.when(f > 0, F.ln(f)).cast("double"), "_ruin": f <= 0})
    rows = seeded(ranged, within, {"_log": F.sum("_log"), "_ruin": F.bool_or("_ruin")}, lambda n, w: (F.sum(n) if n == "_log" else F.bool_or(n)).over(w))
    w = _so_far(within, order)
    ruined, logs = F.coalesce(F.bool_or("_ruin").over(w), F.lit(False)), F.sum("_log").over(w)
    return _kept(rows.withColumn(name, F.when(ruined, F.lit(0.0)).otherwise(F.exp(logs))), *columns, name)


def drawdown(df: DataFrame, value: str, order: Sequence[str], within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """`df` with drawdown: the share lost since the highest value so far (0 or below)."""
    peaks = running_max(df, value, order, within, "_peak", partitions)
    return peaks.withColumn("drawdown", F.try_divide(F.col(f"`{value}`"), F.col("_peak")) - 1).select(*_names([c for c in df.columns if c != "drawdown"]), "drawdown")


def breakout(bars: DataFrame, order: Sequence[str], k: float = 0.5, within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """target and factor of each bar, as series.breakout gives them, for series of any length."""
    made = rows_before(bars, order, {"_high": "high", "_low": "low"}, within, partitions)
    made = made.withColumn("target", F.col("open") + k * (F.col("_high") - F.col("_low"))).drop("_high", "_low")
    return made.withColumn("factor", F.when(F.col("high") >= F.col("target"), F.try_divide(F.col("close"), F.col("target"))).otherwise(F.lit(1.0)))


def align(search: DataFrame, prices: DataFrame, keep_key: bool = False, within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """series.align for series of any length: outer join of search(day, …) and prices(trade_day, …), filled over ranges."""
    joined = search.withColumn("key", F.col("day")).join(prices.withColumnRenamed("trade_day", "key"), ["key", *within], "full")
    if keep_key:
        joined = joined.withColumn("day", F.col("key"))
    return forward_fill(joined, ["key"], [c for c in joined.columns if c != "key" and c not in within], within, partitions)


def lagged_correlation(df: DataFrame, x: str, y: str, lags: Sequence[int], order: Sequence[str], within: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """lag, correlation: of y with x of `lag` rows before in its series, over all series together.

    Rows meet by their numbers: one join for all lags, on keys that no two rows of a side share. A lag that no row
    reaches has no correlation (null).
    """
    chosen = df.select(*_names(within), *_names(order), F.col(f"`{x}`").alias("_x"), F.col(f"`{y}`").alias("_y"))
    rows = row_numbers(chosen, order, within, "_rn", partitions)
    late = rows.select("_y", F.col("_rn").alias("_at"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(within)])
    early = rows.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("_to", F.col("_rn") + F.col("lag"))
    same = [F.col("_at") == F.col("_to"), *[F.col(f"_k{i}").eqNullSafe(F.col(f"`{c}`")) for i, c in enumerate(within)]]
    found = late.join(early.select("lag", "_x", "_to", *_names(within)), same).groupBy("lag").agg(F.corr("_y", "_x").alias("correlation"))
    every = df.sparkSession.createDataFrame([(k,) for k in lags], "lag int")
    return every.join(found, "lag", "left")


def every_nth(df: DataFrame, order: Sequence[str], n: int, partitions: int | None = None) -> DataFrame:
    """Rows 1, n + 1, 2 n + 1 … in order, of a table of any size."""
    numbered = row_numbers(df, order, name="_rn", partitions=partitions)
    return numbered.where((F.col("_rn") - 1) % n == 0).drop("_rn")
