"""Daily series: bars, alignment of two series, normalising, break-out back-test, compounding, drawdown, lagged correlation.

Windows over a whole series run after aggregation to one row a day (and symbol), so what a task sorts is days, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shape import forward_fill, number


def daily_bars(df: DataFrame, time: str, tie: str, value: str, within: Sequence[str] = ()) -> DataFrame:
    """day, open, high, low, close, volume: ties in time are ordered by `tie`. Null times and null or NaN values are left out."""
    rows = df.where(F.col(time).isNotNull() & number(value).isNotNull())
    at = F.struct(time, tie)
    return rows.groupBy(*within, F.to_date(time).alias("day")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"), F.sum(value).alias("volume")
    )


def between_dates(df: DataFrame, day: str, as_of: str, days_back: int) -> DataFrame:
    """Rows of the `days_back` days up to `as_of` (both ends included); the end is a parameter, not the clock."""
    end = F.to_date(F.lit(as_of))
    return df.where(F.col(day).between(F.date_sub(end, days_back), end))


def align(search: DataFrame, prices: DataFrame, keep_key: bool = False, within: Sequence[str] = ()) -> DataFrame:
    """Outer join of search(day, ratio) and prices(trade_day, …), filled forward in day order for each of `within`.

    By default `day` is filled too, so that a day with prices only shows the day of the last search, as a fill over all
    columns does; keep_key=True shows the day itself. `key` is the row's own day in both cases. Without `within`, both
    are one series of a row a day.
    """
    ids = list(within)
    joined = search.withColumn("key", F.col("day")).join(prices.withColumnRenamed("trade_day", "key"), ["key", *ids], "full")
    if keep_key:
        joined = joined.withColumn("day", F.col("key"))
    return forward_fill(joined, [F.col("key")], [c for c in joined.columns if c != "key" and c not in ids], ids)


def normalise_to_max(df: DataFrame, column: str, to: float = 100.0, within: Sequence[str] = ()) -> DataFrame:
    """The column as a share of its largest value, times `to`; null where that is 0."""
    return df.withColumn(column, F.try_divide(F.col(column), F.max(column).over(Window.partitionBy(*within))) * to)


def breakout(bars: DataFrame, k: float = 0.5, within: Sequence[str] = ()) -> DataFrame:
    """target and factor of each day: buy where the high reaches open + k * (previous high - previous low), sell at the close.

    Entry is at the target; a day without a signal, and the first, has factor 1. No fees.
    """
    days = Window.partitionBy(*within).orderBy("day")
    target = F.col("open") + k * (F.lag("high").over(days) - F.lag("low").over(days))
    made = bars.withColumn("target", target)
    return made.withColumn("factor", F.when(F.col("high") >= F.col("target"), F.try_divide(F.col("close"), F.col("target"))).otherwise(F.lit(1.0)))


def compounded(factors: DataFrame, factor: str = "factor", within: Sequence[str] = ()) -> DataFrame:
    """equity: running product of daily factors, as the exponential of summed logarithms; 0 from a factor of 0 on."""
    past = Window.partitionBy(*within).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    ruined = F.min(F.col(factor)).over(past) <= 0
    return factors.withColumn("equity", F.when(ruined, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(F.when(F.col(factor) > 0, F.col(factor)))).over(past))))


def total_return(df: DataFrame, rate: str) -> Column:
    """Aggregate: product of 1 + rate, less 1. +100 % and then -50 % make 0."""
    return F.product(1 + F.col(rate)) - 1


def drawdown(curve: DataFrame, value: str = "equity", within: Sequence[str] = ()) -> DataFrame:
    """drawdown: share lost since the highest value so far (0 or below)."""
    past = Window.partitionBy(*within).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return curve.withColumn("drawdown", F.try_divide(F.col(value), F.max(value).over(past)) - 1)


def lagged_correlation(df: DataFrame, x: str, y: str, lags: Sequence[int], within: Sequence[str] = ()) -> DataFrame:
    """lag, correlation: of y with x of `lag` days before."""
    days = Window.partitionBy(*within).orderBy("day")
    lagged = df.select(y, *[F.lag(x, k).over(days).alias(f"_{k}") for k in lags])
    made = lagged.agg(*[F.corr(y, f"_{k}").alias(f"_{k}") for k in lags])
    return made.select(F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("correlation")) for k in lags])))
