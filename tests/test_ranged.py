"""Scans over ranges equal plain windows, on series longer than a range, with nulls, ties of series and repeated values."""

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone import storage
from marlstone.operators import ranged, relational, series, shape


@pytest.fixture
def rows(spark):
    rng = random.Random(3)
    made = [(rng.choice(["a", "a", "a", "b", None]), k, *[rng.choice([None, float(rng.randrange(9))]) for _ in "xy"]) for k in range(700)]
    made += [("c", None, 4.0, None), ("c", 3, None, 2.0), ("d", 5, None, None)]
    rng.shuffle(made)
    yield spark.createDataFrame(made, "s string, t int, x double, y double").repartition(3)
    storage.sweep(spark)


def told(df):
    return sorted(map(str, df.collect()))


def rows_in_one_task(df):
    """What is brought together into one partition, by the physical plan: the node below each such exchange."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    return [lines[k + 1].lstrip("-+:| 0123456789()*") for k, line in enumerate(lines) if "SinglePartition" in line]


@pytest.mark.parametrize("within", [[], ["s"]])
def test_scans_equal_windows(rows, within):
    order = ["t", "s"] if not within else ["t"]
    w = Window.partitionBy(*within).orderBy(*order)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    numbers = ranged.row_numbers(rows, order, within, partitions=7)
    assert told(numbers) == told(rows.withColumn("row_number", F.row_number().over(w).cast("long")))
    fill = ranged.forward_fill(rows, order, ["x", "y"], within, partitions=7)
    assert told(fill) == told(shape.forward_fill(rows, [F.col(c) for c in order], ["x", "y"], within))
    before = ranged.rows_before(rows, order, {"p": "x"}, within, partitions=7)
    assert told(before) == told(rows.withColumn("p", F.lag("x").over(w)))
    peak = ranged.running_max(rows, "x", order, within, partitions=7)
    assert told(peak) == told(rows.withColumn("peak", F.max("x").over(past)))
    for df in (numbers, fill, before, peak):  # a row of summaries a range at most
        assert all(re.match(r"\w*Aggregate\(keys?=\[_part", line) for line in rows_in_one_task(df)), rows_in_one_task(df)


def test_one_range_holds_no_whole_series(rows):
    table = ranged.ranges(rows, ["t"], ["s"], partitions=7)
    assert table.where("s = 'a'").select("_part").distinct().count() >= 3


def test_breakout_product_and_drawdown_equal_those_of_daily_series(spark):
    rng = random.Random(4)
    bars = []
    for s in "pq":
        for day in range(200):
            low = 100 * math.exp(rng.gauss(0, 0.1))
            bars.append((s, day, low * 1.01, low * 1.05, low, low * 1.03))
    df = spark.createDataFrame(bars, "s string, day int, open double, high double, low double, close double").repartition(4)
    mine = ranged.breakout(df, ["day"], within=["s"], partitions=5)
    plain = series.breakout(df, within=["s"])
    assert told(mine.select(*plain.columns)) == told(plain)
    curve = ranged.running_product(mine, "factor", ["day"], ["s"], partitions=5)
    want = {(r.s, r.day): (r.equity, r.drawdown) for r in series.drawdown(series.compounded(plain, within=["s"]), within=["s"]).collect()}
    got = ranged.drawdown(curve, "equity", ["day"], ["s"], partitions=5).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.equity, r.drawdown) == pytest.approx(want[r.s, r.day], rel=1e-12, abs=1e-12)
    assert storage.sweep(spark) == 3 and storage.sweep(spark) == 0


def test_alignment_and_lagged_correlation_equal_those_of_daily_series(spark):
    rng = random.Random(8)
    days = lambda n: sorted(rng.sample(range(300), n))
    search = spark.createDataFrame([(s, d, rng.choice([None, rng.random()])) for s in "pq" for d in days(150)], "s string, day int, ratio double")
    prices = spark.createDataFrame([(s, d, rng.choice([None, rng.random()])) for s in "pqr" for d in days(150)], "s string, trade_day int, close double")
    for keep in (False, True):
        got = ranged.align(search, prices, keep, ["s"], partitions=5)
        plain = series.align(search, prices, keep, ["s"])
        assert told(got.select(*plain.columns)) == told(plain)
    rows = prices.withColumn("day", F.col("trade_day"))
    got = {r.lag: r.correlation for r in ranged.lagged_correlation(rows, "close", "trade_day", [0, 2, 500], ["day"], ["s"], partitions=4).collect()}
    want = {r.lag: r.correlation for r in series.lagged_correlation(rows, "close", "trade_day", [0, 2, 500], ["s"]).collect()}
    assert got.keys() == want.keys() and got[500] is None and want[500] is None
    assert [got[k] for k in (0, 2)] == pytest.approx([want[k] for k in (0, 2)], rel=1e-9)
    storage.sweep(spark)


def test_a_factor_of_zero_ruins_the_rest(spark):
    df = spark.createDataFrame([(k, f) for k, f in enumerate([2.0, None, 1.5, 0.0, 3.0, 1.0])], "k int, f double")
    got = ranged.running_product(df, "f", ["k"], partitions=3).orderBy("k").collect()
    assert [round(r.equity, 12) for r in got] == [2.0, 2.0, 3.0, 0.0, 0.0, 0.0]


def test_every_nth_of_rows_and_of_nothing(spark):
    df = spark.range(0, 103, numPartitions=5).withColumn("_seed_not", F.lit(1))
    assert sorted(r.id for r in ranged.every_nth(df, ["id"], 5, partitions=6).collect()) == list(range(0, 103, 5))
    assert ranged.every_nth(df.limit(0), ["id"], 5).count() == 0
    assert sorted(r.id for r in relational.every_nth(df, "id", 50).collect()) == [0, 50, 100]
    with pytest.raises(ValueError):
        ranged.forward_fill(df, ["id"], ["id"])
