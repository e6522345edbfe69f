"""Reshaping, missing values and summary statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] | None = None) -> DataFrame:
    """Wide to long: ids, variable, value. Without `values`, all other columns; they need one common type."""
    names = list(values or [c for c in df.columns if c not in ids])
    return df.unpivot([F.col(f"`{c}`") for c in ids], [F.col(f"`{c}`") for c in names], "variable", "value")


def skip_first(df: DataFrame, *order: str) -> DataFrame:
    """Without the row that comes first in `order`, whose columns together are unique and not null; the rest keeps no order.

    The first row is an aggregate, so rows are not brought together to be counted off.
    """
    first = df.agg(F.min(F.struct(*order)).alias("_first"))
    return df.crossJoin(F.broadcast(first)).where(F.struct(*order) != F.col("_first")).drop("_first")  # one row


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by the listed column values, 0 where there are none. Listing them saves a pass."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def fill_rounded_mean(df: DataFrame, column: str) -> DataFrame:
    """Nulls become the column's mean, rounded half to even. The mean is a scalar of one pre-aggregated pass."""
    mean = df.agg(F.bround(F.avg(column)).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(column, F.coalesce(F.col(column), "_mean")).drop("_mean")  # one row


def forward_fill(df: DataFrame, order: Sequence[Column], columns: Sequence[str] | None = None, within: Sequence[str] = ()) -> DataFrame:
    """Each null takes the last value before it in order; leading nulls stay. Without `within`, all rows meet in one
    task: aggregate to the grain of the series first."""
    past = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    todo = set(columns or [c for c in df.columns if c not in within])
    return df.select(*[F.last(c, ignorenulls=True).over(past).alias(c) if c in todo else F.col(c) for c in df.columns])


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_by_ordered(df: DataFrame, x: str, hue: str, order: Sequence[str]) -> DataFrame:
    """Counts by (x, hue) with x's place in `order` (from 1); values that are not listed are left out."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(x)).cast("int")
    return count_by(df.where(F.col(x).isin(list(order))), x, hue).withColumn("position", place)


def number(column: str) -> Column:
    """The column, NaN as null: aggregates then skip both alike."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None).cast("double"))


def mean_by(df: DataFrame, x: str, y: str) -> DataFrame:
    """mean of y for each x, and n, the number of its values; null and NaN are skipped in both. Values are not rounded."""
    return df.groupBy(x).agg(F.avg(number(y)).alias("mean"), F.count(number(y)).alias("n"))


def mean_interval(df: DataFrame, x: str, y: str, row_id: str, replicates: int = 200, level: float = 0.95, blocks: int = 1024) -> DataFrame:
    """mean of y for each x and its bootstrap interval low, high: the same at every partitioning and on every run.

    A Poisson bootstrap: each replicate weighs rows by Poisson numbers of mean 1 and takes the weighted mean; the interval
    holds `level` of the replicates' means. Rows are dealt to `blocks` by a hash of their id and weighted by the block, so
    that rows are read and summed up once, whatever the number of replicates. Null and NaN values are skipped; a null id
    is an id like any other.
    """
    unit = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 12), 16, 10).cast("long")
    rows = df.select(F.col(f"`{x}`").alias("_x"), number(y).alias("_y"), F.coalesce(F.col(f"`{row_id}`").cast("string"), F.lit("")).alias("_id")).where("_y is not null")
    sums = rows.groupBy("_x", (unit("_id") % blocks).alias("_b")).agg(F.sum("_y").alias("_s"), F.count("_y").alias("_n"))
    drawn = sums.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = unit(F.col("_b").cast("string"), F.col("_k").cast("string"))
    term, sure, weight = math.exp(-1), 0.0, F.lit(0)
    for k in range(1, 13):  # the chance of 13 or more is 6e-11, less than a step of u
        sure += term
        term /= k
        weight += (u >= int(sure * 16**12)).cast("int")
    drawn = drawn.withColumn("_w", weight).groupBy("_x", "_k").agg(F.sum(F.col("_w") * F.col("_s")).alias("_s"), F.sum(F.col("_w") * F.col("_n")).alias("_n"))
    means = drawn.groupBy("_x").agg(F.percentile(F.try_divide("_s", F.col("_n").cast("double")), [(1 - level) / 2, (1 + level) / 2]).alias("_q"))
    whole = sums.groupBy("_x").agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n")).withColumnRenamed("_x", "_same")
    return means.join(whole, F.col("_x").eqNullSafe(F.col("_same"))).select(F.col("_x").alias(x), "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "n")


QUARTILES = ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))


def quartiles(df: DataFrame, *keys: str, value: str) -> DataFrame:
    """Exact lower quartile, median and upper quartile of each group, interpolated; null and NaN are left out.

    Equal values are counted first. The counts are ranged over partitions, their running sums taken within each and
    continued from one to the next, so that no task needs a whole group however many values it has.
    The counts are written while the plan is built, and the result reads them: see storage.sweep.
    """
    counts = df.select(*keys, number(value).alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()))
    so_far = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))  # a row for each group and partition
    parts = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_s").over(so_far), F.lit(0)).alias("_before"), F.sum("_s").over(whole).alias("_all"))
    within = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    placed = ranged.withColumn("_end", F.sum("_n").over(within)).join(parts, same).select(*keys, "_v", "_n", (F.col("_end") + F.col("_before")).alias("_end"), "_all")
    first, last = F.col("_end") - F.col("_n"), F.col("_end") - 1  # places from 0 that the value takes
    at = {p: F.col("_all") * p - p for p, _ in QUARTILES}
    sides = [F.max(F.when(r(at[p]).between(first, last), F.col("_v"))).alias(f"_{i}{n}") for i, (p, _) in enumerate(QUARTILES) for n, r in (("a", F.floor), ("b", F.ceil))]
    found = placed.groupBy(*keys).agg(F.first("_all").alias("_all"), *sides)
    return found.select(*keys, *[(F.col(f"_{i}a") + (at[p] - F.floor(at[p])) * (F.col(f"_{i}b") - F.col(f"_{i}a"))).alias(n) for i, (p, n) in enumerate(QUARTILES)])


#: Width of a bin as a share of the bandwidth, and moments that are kept of it: a density is off by 3e-14 of its kernel's
#: peak at most, as the next term of the series is below 1.09 * (BIN / 2) ** MOMENTS / sqrt(MOMENTS!).
BIN, MOMENTS = 0.25, 11


def _series() -> list[list[tuple[int, float]]]:
    """For each power of u, the moments k that He_k(u) / k! gives it, and by which factor."""
    he = [[1.0], [0.0, 1.0]]
    while len(he) < MOMENTS:
        k = len(he)
        he.append([(a - (k - 1) * b) for a, b in zip([0.0, *he[-1]], [*he[-2], 0.0, 0.0], strict=True)])
    return [[(k, he[k][i] / math.factorial(k)) for k in range(i, MOMENTS) if he[k][i]] for i in range(MOMENTS)]


def density(df: DataFrame, column: str, grid: Sequence[float] | None = None, within: Sequence[str] = (), points: int = 200, cut: float = 3.0) -> DataFrame:
    """x, density: Gaussian kernel density, bandwidth sd * n ** (-1/5); one curve a group, its places in order.

    Without `grid`, a group's curve has `points` places from `cut` bandwidths below its least value to as many above its
    greatest. Values are binned, and of each bin the first moments around its centre are kept: the kernel's series there
    gives each bin's share of a place's density, so that places are paid for by the bin and not by the row, and only
    moments of bins are shuffled. Nulls, NaN and rows with a null key are left out; fewer than two distinct values have
    null density (at the places of `grid`; without one, they have no curve).
    """
    keys = list(within)
    data = df.select(*keys, number(column).alias("_x")).where("_x is not null").dropna(subset=keys or None)
    stats = data.groupBy(*keys).agg(F.count("_x").alias("_n"), F.nullif(F.stddev_samp("_x") * F.pow(F.count("_x").cast("double"), F.lit(-0.2)), F.lit(0.0)).alias("_h"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    both = data.join(stats, keys) if keys else data.crossJoin(F.broadcast(stats))  # without keys, one row
    place = (F.col("_x") - F.col("_low")) / F.col("_h") / BIN
    bins = both.select(*keys, "_n", "_h", "_low", "_high", F.floor(place).alias("_bin"), ((place - F.floor(place) - 0.5) * BIN).alias("_e"))
    power, moments = F.lit(1.0), []
    for k in range(MOMENTS):
        moments.append(F.sum(power).alias(f"_m{k}"))
        power = power * F.col("_e")
    summed = bins.groupBy(*keys, "_bin").agg(*[F.first(c).alias(c) for c in ("_n", "_h", "_low", "_high")], *moments)
    if grid is None:
        first, last = F.col("_low") - cut * F.col("_h"), F.col("_high") + cut * F.col("_h")
        at = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: first + (last - first) * i / (points - 1))
        summed = summed.where("_h is not null")
    else:
        at = F.array(*[F.lit(float(g)) for g in grid])
    # the series is a polynomial in the distance from the bin's centre: its coefficients are made once a bin
    terms = [reduce(lambda a, b: a + b, [F.col(f"_m{k}") * c for k, c in row]).alias(f"_c{i}") for i, row in enumerate(_series())]
    spread = summed.select(*keys, "_n", "_h", F.explode(at).alias("x"), "_low", "_bin", *terms)
    u = (F.col("x") - F.col("_low")) / F.col("_h") - (F.col("_bin") + 0.5) * BIN
    spread = spread.select(*keys, "_n", "_h", "x", u.alias("_u"), *[f"_c{i}" for i in range(MOMENTS)])
    inner = reduce(lambda a, i: a * F.col("_u") + F.col(f"_c{i}"), range(MOMENTS - 2, -1, -1), F.col(f"_c{MOMENTS - 1}"))
    share = F.exp(-F.col("_u") * F.col("_u") / 2) * inner
    total = F.greatest(F.sum(share), F.lit(0.0)) / (F.first("_n") * F.first("_h") * math.sqrt(2 * math.pi))
    made = spread.groupBy(*keys, "x").agg(F.when(F.first("_h").isNotNull(), total).alias("density"))
    return made.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "density"))).alias("_curve")).select(*keys, F.inline("_curve"))  # a row a place


def null_counts(df: DataFrame) -> DataFrame:
    """variable, nulls: null values of each column, from one pass."""
    made = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return made.unpivot([], df.columns, "variable", "nulls")


def profile(df: DataFrame) -> DataFrame:
    """variable, type, non_null, total: what each column holds, from one pass."""
    made = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema], F.count(F.lit(1)).alias("_total"))
    rows = F.array(*[F.struct(F.lit(f.name).alias("variable"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`").alias("non_null"), F.col("_total").alias("total")) for f in df.schema])
    return made.select(F.inline(rows))


def distinct_in_order(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """Distinct values with the row id of their first appearance."""
    return df.groupBy(column).agg(F.min(row_id).alias("first_row"))
