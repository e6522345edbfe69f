"""Semantics where libraries differ: simultaneous renames, NaN, rounding, null keys, last rule wins, ordering, fills."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import content, relational, series, shape


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_rename_is_simultaneous(spark):
    df = relational.rename(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "b", "b": "c", "zz": "q"})
    assert df.columns == ["b", "c"] and values(df, "b", "c") == [(1, 2)]


def test_label_last_rule_wins_and_null_stays(spark):
    df = spark.createDataFrame([("ab",), ("a",), (None,), ("",)], "s string")
    label = relational.label_by_rules(F.col("s"), [("a", "first"), ("b", "second")])
    assert values(df.select(label.alias("l")), "l") == [("second",), ("first",), (None,), (None,)]
    assert df.where(relational.matches_any(F.col("s"), ["a", "x|y"])).count() == 2


def test_ratio_and_band(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 100.0), (2.0, 100.0), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    out = df.select(relational.band(relational.ratio(F.col("a"), F.col("b")), 3.0).alias("band"))
    assert values(out, "band") == [(None,), ("high",), ("low",), (None,), (None,)]


def test_rounded_mean_is_half_even(spark):
    for data, mean in (([2.0, 3.0, None], 2.0), ([3.0, 4.0, None], 4.0), ([None, None], None)):
        out = shape.fill_rounded_mean(spark.createDataFrame([(v,) for v in data], "v double"), "v")
        assert sorted(values(out, "v"), key=str) == sorted([(mean if v is None else v,) for v in data], key=str)


def test_join_null_keys(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "x int"), spark.createDataFrame([(1,), (None,)], "y int")
    assert relational.join_keys(a, b, "x", "y").count() == 1
    assert relational.join_keys(a, b, "x", "y", null_safe=True).count() == 2


def test_recode_does_not_cascade(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("z",)], "s string")
    table = spark.createDataFrame([("a", "b"), ("b", "c")], "value string, replacement string")
    for mapping in ({"a": "b", "b": "c"}, table):
        assert sorted(values(relational.recode(df, "s", mapping), "s"), key=str) == sorted([("b",), ("c",), (None,), ("z",)], key=str)
    with pytest.raises(ValueError):
        relational.recode(df, "s", {str(i): "x" for i in range(201)})


def test_top_k_nulls_last_with_ties(spark):
    df = spark.createDataFrame([(3, None), (2, 1.0), (1, 1.0)], "id int, v double")
    assert values(relational.top_k(df, "v", "id", 3), "id") == [(1,), (2,), (3,)]


def test_patch_drop_and_append(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k int, s string")
    assert values(relational.patch(df, "k", "s", {1: "x"}), "s") == [("a",), ("x",), ("c",)]
    assert values(relational.drop_keys(df, "k", [0]), "s") == [("b",), ("c",)]
    assert values(relational.append_row(df, s="d"), "k", "s")[-1] == (None, "d")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(0, 9)), max_size=12))
def test_forward_fill_is_idempotent(spark, data):
    df = spark.createDataFrame(list(enumerate(data)), "k int, v int")
    once = shape.forward_fill(df, [F.col("k")], ["v"])
    want, last = [], None
    for v in data:
        last = v if v is not None else last
        want.append((last,))
    assert values(once.orderBy("k"), "v") == want
    assert values(shape.forward_fill(once, [F.col("k")], ["v"]).orderBy("k"), "v") == want


def test_align_shows_previous_day_unless_key_is_kept(spark):
    search = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-03", 2.0)], "day string, ratio double").withColumn("day", F.to_date("day"))
    prices = spark.createDataFrame([("2024-01-02", 5.0)], "trade_day string, close double").withColumn("trade_day", F.to_date("trade_day"))
    for keep, second in ((False, "2024-01-01"), (True, "2024-01-02")):
        rows = values(series.align(search, prices, keep).orderBy("key"), F.col("day").cast("string"), "ratio", "close")
        assert rows == [("2024-01-01", 1.0, None), (second, 1.0, 5.0), ("2024-01-03", 2.0, 5.0)]


def test_gain_and_loss_compound_to_nothing(spark):
    df = spark.createDataFrame([(1, 1.0), (2, -0.5)], "day int, rate double")
    assert df.agg(series.total_return(df, "rate")).first()[0] == 0.0
    curve = series.compounded(df.withColumn("factor", 1 + F.col("rate")))
    assert [round(r[0], 9) for r in values(curve.orderBy("day"), "equity")] == [2.0, 1.0]
    assert [round(r[0], 9) for r in values(series.drawdown(curve).orderBy("day"), "drawdown")] == [0.0, -0.5]


def test_melt_then_crosstab_and_density(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, None)], "id int, a double, b double")
    long = shape.melt(df, ["id"])
    assert long.count() == 4
    assert sorted(map(tuple, long.groupBy("id").pivot("variable").agg(F.first("value")).collect())) == [(1, 2.0, 3.0), (2, 4.0, None)]
    grid = [x / 4 for x in range(-40, 80)]
    data = [1.0, 2.0, 4.0, float("nan"), None]
    got = shape.density(spark.createDataFrame([(v,) for v in data], "v double"), "v", grid).collect()
    h = math.sqrt(sum((v - 7 / 3) ** 2 for v in data[:3]) / 2) * 3**-0.2
    want = [sum(math.exp(-(((g - v) / h) ** 2) / 2) for v in data[:3]) / (3 * h * math.sqrt(2 * math.pi)) for g in grid]
    assert all(abs(r.density - w) < 1e-12 and r.density >= 0 for r, w in zip(got, want, strict=True))
    assert shape.density(spark.createDataFrame([(1.0,)], "v double"), "v", [0.0]).first().density is None


def test_regions_tokens_and_reading_time(spark):
    df = spark.createDataFrame([("서울특별시",), ("충청북도",), ("abc",), (None,)], "s string")
    assert values(df.select(text.shorten_region(F.col("s")).alias("r")), "r") == [("서울",), ("충북",), ("ab",), (None,)]
    strict = spark.createDataFrame([("one",)], "s string").select(text.token(F.col("s"), 1, lenient=False))
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        strict.collect()
    posts = spark.createDataFrame([("w " * 300,), ("<b>x</b>",), (None,)], "t string")
    assert values(posts.select(text.reading_minutes(F.col("t")).alias("m")), "m") == [(2,), (1,), (1,)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "k int, s string, v double, tags array<string>")
    assert shape.count_by(df, "s").count() == 0 and shape.profile(df).count() == 4 and content.tag_counts(df).count() == 0
    assert shape.fill_rounded_mean(df, "v").count() == 0 and series.lagged_correlation(df.withColumn("day", F.col("k")), "v", "v", [0, 1]).count() == 2


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-5, 5).map(float))), max_size=60))
def test_quartiles_equal_the_built_in_percentile(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    got = shape.quartiles(df.repartition(3), "k", value="v")
    want = df.where("v is not null").groupBy("k").agg(*[F.percentile("v", p).alias(n) for p, n in shape.QUARTILES])
    assert sorted(values(got, "k", "q1", "median", "q3"), key=str) == sorted(values(want, "k", "q1", "median", "q3"), key=str)


def test_quartiles_without_keys(spark):
    assert values(shape.quartiles(spark.range(0, 1001, numPartitions=5), value="id"), "q1", "median", "q3") == [(250.0, 500.0, 750.0)]


def test_density_by_group_is_the_density_of_each_group(spark):
    df = spark.createDataFrame([("a", float(i % 7)) for i in range(40)] + [("b", 2.0), ("b", 5.0), ("c", 1.0), (None, 3.0), ("a", None), ("a", float("nan"))], "k string, v double")
    got = values(shape.density(df, "v", [0.0, 3.0], ["k"]), "k", "x", "density")
    for k in ("a", "b", "c"):
        alone = values(shape.density(df.where(F.col("k") == k), "v", [0.0, 3.0]), "x", "density")
        mine = sorted((x, d) for g, x, d in got if g == k)
        assert all(d == pytest.approx(e) if e is not None else d is None for (_, d), (_, e) in zip(mine, sorted(alone), strict=True))
    assert {g for g, _, _ in got} == {"a", "b", "c"}


def test_pre_is_kept_and_the_rest_compressed(spark):
    page = "<p> a  \n b <!-- x\ny --><PRE class=x>\n  1  <!-- kept -->\n</PRE>\n\n c<pre>2\n\n3</pre><prefix>  d</prefix><pre>  open"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(text.compress_html(F.col("h"))).collect()] == ["<p> a b <PRE class=x>\n  1  <!-- kept -->\n</PRE> c<pre>2\n\n3</pre><prefix> d</prefix><pre>  open", None, ""]


def test_listings_are_ordered_and_texts_made(spark):
    df = spark.createDataFrame([(1, "2021-09-14"), (2, None), (3, "2021-10-01"), (4, "2021-09-14")], "id int, d string").withColumn("d", F.to_date("d"))
    assert values(content.newest_first(df, "d", "id"), "id") == [(3,), (1,), (4,), (2,)]
    assert values(df.orderBy("id").select(text.date_text(F.col("d")).alias("t")), "t") == [("14 Sep 2021",), (None,), ("01 Oct 2021",), ("14 Sep 2021",)]
    tags = spark.createDataFrame([(["b", "a"],), (["a", "Z"],), ([],), (None,)], "tags array<string>")
    assert values(content.sorted_tags(tags), "tag", "posts") == [("Z", 1), ("a", 2), ("b", 1)]
    assert values(tags.select(text.keywords(F.col("tags")).alias("k")), "k") == [("b, a",), ("a, Z",), (None,), (None,)]
    n = spark.createDataFrame([(1,), (2,), (3,), (7,), (None,)], "n int")
    assert values(n.select(text.column_class(F.col("n")).alias("c")), "c") == [("",), ("half",), ("third",), ("",), ("",)]


def test_skip_first_and_totals_and_renames(spark):
    df = spark.createDataFrame([("x", 2), ("a", 9), ("a", 3)], "k string, v int")
    assert sorted(values(shape.skip_first(df, "k", "v"), "k", "v")) == [("a", 9), ("x", 2)] and shape.skip_first(df.limit(0), "k", "v").count() == 0
    both = spark.createDataFrame([(1, 2), (None, 2)], "a int, b int")
    assert values(both.select(relational.total(F.col("a"), F.col("b")).alias("t")), "t") == [(3,), (None,)]
    assert relational.rename_by(both, str.upper).columns == ["A", "B"]
    with pytest.raises(ValueError):
        relational.rename_by(both, lambda c: "z")


def test_align_keeps_symbols_apart(spark):
    search = spark.createDataFrame([("p", 1, 5.0), ("q", 2, 7.0)], "s string, day int, ratio double")
    prices = spark.createDataFrame([("p", 2, 1.0), ("q", 1, 3.0)], "s string, trade_day int, close double")
    got = sorted(values(series.align(search, prices, within=["s"]), "s", "key", "day", "ratio", "close"), key=str)
    assert got == [("p", 1, 1, 5.0, None), ("p", 2, 1, 5.0, 1.0), ("q", 1, None, None, 3.0), ("q", 2, 2, 7.0, 3.0)]


def test_means_and_sums_do_not_round_their_input(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 0.001), ("a", 0.004), ("b", 1e17), ("b", 3e17), ("c", nan), ("c", 2.0), ("c", None), ("d", nan)], "x string, y double")
    got = {r.x: (r["mean"], r.n) for r in shape.mean_by(df, "x", "y").collect()}
    assert got == {"a": (0.0025, 2), "b": (2e17, 2), "c": (2.0, 1), "d": (None, 0)}
    bars = df.where("x in ('a', 'c')").withColumn("t", F.lit("2024-01-01").cast("timestamp")).withColumn("k", F.monotonically_increasing_id())
    got = {r.x: (r.volume, r.high) for r in series.daily_bars(bars, "t", "k", "y", ["x"]).collect()}
    assert got == {"a": (0.005, 0.004), "c": (2.0, 2.0)}


def test_nan_is_left_out_of_quartiles_and_densities_alike(spark):
    df = spark.createDataFrame([(v,) for v in (2.0, 3.0, 4.0, float("nan"), None)], "v double")
    assert values(shape.quartiles(df, value="v"), "q1", "median", "q3") == [(2.5, 3.0, 3.5)]


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b` int, `c.d` double")
    assert values(shape.melt(df, ["a.b"]), "`a.b`", "variable", "value") == [(1, "c.d", 2.0)]


def test_interval_of_the_mean(spark):
    df = spark.range(0, 3000, numPartitions=7).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE CAST(id % 3 AS STRING) END AS x", "CASE WHEN id % 100 = 7 THEN NULL WHEN id % 100 = 8 THEN double('NaN') ELSE id % 10 + 0.001 END AS y")
    one, two = ({r.x: r for r in shape.mean_interval(d, "x", "y", "id").collect()} for d in (df, df.repartition(2, "y")))
    assert one.keys() == {None, "1", "2"}
    for k, r in one.items():
        assert tuple(r)[1:] == pytest.approx(tuple(two[k])[1:], rel=1e-12)
        (n, mean, sd), = df.where(F.col("x").eqNullSafe(F.lit(k))).select(shape.number("y").alias("y")).agg(F.count("y"), F.avg("y"), F.stddev("y")).collect()
        half = 1.96 * sd / n**0.5
        assert r.n == n and r["mean"] == pytest.approx(mean, rel=1e-12) and r.low < mean < r.high
        assert r.high - r.low == pytest.approx(2 * half, rel=0.25)


def test_binned_density_is_within_its_bound(spark):
    data = [math.sin(k) ** 3 * 50 + (k % 7) for k in range(800)] + [400.0]
    n, mean = len(data), sum(data) / len(data)
    h = math.sqrt(sum((v - mean) ** 2 for v in data) / (n - 1)) * n**-0.2
    exact = lambda x: sum(math.exp(-(((x - v) / h) ** 2) / 2) for v in data) / (n * h * math.sqrt(2 * math.pi))
    got = shape.density(spark.createDataFrame([(v,) for v in data], "v double"), "v").collect()
    places = sorted(r.x for r in got)
    assert len(got) == 200 and places[0] == pytest.approx(min(data) - 3 * h) and places[-1] == pytest.approx(max(data) + 3 * h)
    bound = 1.09 * (shape.BIN / 2) ** shape.MOMENTS / math.sqrt(math.factorial(shape.MOMENTS)) / (h * math.sqrt(2 * math.pi)) * 1.2
    assert all(abs(r.density - exact(r.x)) <= bound + 1e-15 for r in got)
    assert shape.density(spark.createDataFrame([(1.0,)], "v double"), "v").count() == 0


def test_upsert_by_label(spark):
    df = spark.createDataFrame([("24", "a", 1.0, "k"), ("25", "b", 2.0, "k"), ("25", "c", 3.0, "l"), (None, "n", 4.0, "m")], "id string, name string, v double, rest string")
    changes = spark.createDataFrame([("25", "South Korea", None, 1), ("26", "new", 5.71, 1), (None, "x", 0.0, 1), (None, "y", 0.0, 1)], "id string, name string, v double, other int")
    got = values(relational.upsert(df, changes, "id"), "id", "name", "v", "rest")
    want = [("24", "a", 1.0, "k"), ("25", "South Korea", None, "k"), ("25", "South Korea", None, "l"), (None, "n", 4.0, "m"), ("26", "new", 5.71, None), (None, "x", 0.0, None), (None, "y", 0.0, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    with pytest.raises(Exception, match="label repeats"):
        relational.upsert(df, changes.union(changes.where("id = '26'")), "id").collect()
    assert relational.upsert(df.limit(0), changes.limit(0), "id").count() == 0


def test_one_dictionary_for_all_cells(spark):
    df = spark.createDataFrame([("a", "b", 1), ("b", None, 2), ("z", "a", 3)], "s string, `t.u` string, n int")
    assert sorted(values(relational.distinct_cells(df, ["s", "t.u"]), "value")) == [("a",), ("b",), ("z",)]
    dictionary = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("unused", "q"), (None, "n"), ("z", None)], "value string, replacement string")
    got = relational.recode_cells(df, ["s", "t.u"], dictionary)
    assert got.columns == df.columns and sorted(map(str, values(got, "s", "`t.u`", "n"))) == sorted(map(str, [("b", "c", 1), ("c", None, 2), (None, "b", 3)]))
