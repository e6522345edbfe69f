"""Registered queries: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import content, ranged, relational, series, shape
from ..sources import documents as sources

GRID = [float(x) for x in range(0, 501, 25)]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    """events with value null in every seventh row."""
    return table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return series.daily_bars(table(spark, d, "events"), "ts", "event_id", "value")


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_name", F.split("p_name", " ").alias("tags"))


def regex_brand_count(spark, d):
    part = table(spark, d, "part").select("p_name", "p_type")
    name = F.col("p_name")
    hits = part.where(name.isNotNull() & relational.matches_any(name, ["cold", "widget"]))
    return shape.count_by(hits.withColumn("brand", relational.label_by_rules(name, [("cold", "cold"), ("widget", "widget")])), "p_type", "brand")


def project_rename_swap(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return relational.rename(df, {"c_name": "c_mktsegment", "c_mktsegment": "segment"})


def positional_projection(spark, d):
    df = relational.first_columns(table(spark, d, "orders"), 4, drop=["o_custkey"])
    return relational.rename_by_position(df, ["order_id", "status", "price"])


def compare_filters(spark, d):
    df = table(spark, d, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45) & (F.col("l_discount") >= 0.05) & (F.col("l_tax") < 0.03))
    return df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")


def ratio_bands(spark, d):
    df = table(spark, d, "lineitem").select(relational.ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio"))
    return shape.count_by(df.select(F.coalesce(relational.band(F.col("ratio"), 100.0), F.lit("none")).alias("band")), "band")


def null_coalesce(spark, d):
    return _gaps(spark, d).select("event_id", F.coalesce("value", (F.col("event_id") % 100).cast("double")).alias("value"))


def inner_join_two_keys(spark, d):
    customers = table(spark, d, "customer").select("c_custkey", "c_name").distinct()
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = relational.join_keys(orders, customers, "o_custkey", "c_custkey")
    return joined.withColumn("price_cents", F.round(F.col("o_totalprice") * 100).cast("long"))


def index_aligned_copy(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    totals = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return relational.align_column(orders, totals, "o_orderkey", "o_totalprice")


def union_outer_schema(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    return relational.union_outer(c, s)


def distinct_rows(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").dropDuplicates()


def append_row(spark, d):
    return relational.append_row(table(spark, d, "region"), r_regionkey=99, r_name="ATLANTIS")


def topk_nulls_last(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("price"))
    return relational.top_k(df, "price", "p_partkey", 10).select("p_partkey", "p_name")


def dictionary_recode(spark, d):
    df = relational.recode(table(spark, d, "orders").select("o_orderstatus"), "o_orderstatus", {"F": "O", "O": "open"})
    return shape.count_by(df, "o_orderstatus")


def patch_rows(spark, d):
    return relational.patch(relational.drop_keys(table(spark, d, "nation"), "n_nationkey", [0]), "n_nationkey", "n_name", {3: "THIRD", 4: "FOURTH"})


def count_by_ordered(spark, d):
    return shape.count_by_ordered(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["5-LOW", "1-URGENT", "3-MEDIUM"])


def global_mean_max(spark, d):
    df = table(spark, d, "customer")
    return df.agg(F.round(F.avg(shape.number("c_acctbal")), 6).alias("mean_balance"), F.max("c_acctbal").alias("max_balance"), F.count(F.lit(1)).alias("n"))


def mean_by_x(spark, d):
    df = table(spark, d, "orders").select(F.year("o_orderdate").alias("year"), "o_totalprice")
    return shape.mean_by(df, "year", "o_totalprice").withColumn("mean", F.round("mean", 6))


def mean_interval(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), "o_totalprice")
    made = shape.mean_interval(df, "year", "o_totalprice", "o_orderkey")
    return made.select("year", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")], "n")


def every_fifth_year(spark, d):
    return relational.every_nth(table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct(), "year", 5)


def every_fifth_row(spark, d):
    """Of a table of rows: they are numbered over ranges."""
    return relational.every_nth(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 5)


def forward_fill_rows(spark, d):
    """One series of a row an event, filled over ranges."""
    return ranged.forward_fill(_gaps(spark, d).select("event_id", "ts", "value"), ["ts", "event_id"], ["value"]).select("event_id", "value")


def row_drawdown(spark, d):
    """A factor an event, compounded for each user over ranges, and what is lost since the peak."""
    df = table(spark, d, "events").select("event_id", "user_id", "ts", (1 + (F.col("value") - 250) / 10000).alias("factor"))
    curve = ranged.running_product(df, "factor", ["ts", "event_id"], ["user_id"])
    made = ranged.drawdown(curve, "equity", ["ts", "event_id"], ["user_id"])
    return made.select("event_id", F.round("equity", 6).alias("equity"), F.round("drawdown", 6).alias("drawdown"))


def breakout_by_symbol(spark, d):
    """The break-out of five symbols; the day before may lie in another range."""
    events = table(spark, d, "events").withColumn("symbol", F.col("user_id") % 5)
    bars = series.daily_bars(events, "ts", "event_id", "value", ["symbol"])
    return ranged.breakout(bars, ["day"], within=["symbol"]).select("symbol", "day", F.round("target", 6).alias("target"), F.round("factor", 6).alias("factor"))


def align_event_series(spark, d):
    """Two series of a row an event, with gaps, side by side and filled over ranges."""
    events = table(spark, d, "events")
    of = lambda kind, every, column, day: events.where(F.col("event_type") == kind).select(F.col("event_id").alias(day), F.when(F.col("event_id") % every != 0, F.col("value")).alias(column))
    return ranged.align(of("view", 3, "ratio", "day"), of("purchase", 4, "close", "trade_day")).select("key", "day", "ratio", "close")


def lead_lag_rows(spark, d):
    """Of a row an event, within users: rows meet by their numbers."""
    made = ranged.lagged_correlation(table(spark, d, "events"), "value", "value", [0, 1, 2, 3], ["ts", "event_id"], ["user_id"])
    return made.select("lag", F.round("correlation", 6).alias("correlation"))


def recode_all_cells(spark, d):
    """One dictionary for two columns, made of the distinct values of both."""
    part = table(spark, d, "part").select("p_brand", "p_type")
    dictionary = relational.distinct_cells(part, ["p_brand", "p_type"]).where("value like '%1' or value like '%L%'").select("value", F.reverse("value").alias("replacement"))
    return shape.count_by(relational.recode_cells(part, ["p_brand", "p_type"], dictionary), "p_brand", "p_type")


def upsert_rows(spark, d):
    """Every tenth customer gets a new balance; as many are added, without a nation."""
    customer = table(spark, d, "customer")
    tenth = customer.where("c_custkey % 10 = 0").select("c_custkey", "c_name", (F.col("c_acctbal") + 1).alias("c_acctbal"))
    added = tenth.select((F.col("c_custkey") + 100_000_000).alias("c_custkey"), "c_name", F.lit(None).cast("double").alias("c_acctbal"))
    made = relational.upsert(customer, tenth.unionByName(added), "c_custkey")
    return made.select("c_custkey", "c_name", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment")


def html_table_spans(spark, d):
    """A table with cells over two rows and columns before each page's own markup, read back as a grid."""
    cell = F.coalesce(F.regexp_replace("url", "[<>&]", ""), F.lit(""))
    front = F.concat(
        F.lit('<table><tr><th rowspan="2">page</th><th colspan=2>url</th></tr><tr><th>text<th>length</tr><tr><td rowspan="3">'), F.col("page_id").cast("string"),
        F.lit("</td><td>"), cell, F.lit("<td>"), F.length(cell).cast("string"), F.lit("</td></tr><tr><td colspan='2'>none</td></tr></table>"),
    )
    pages = table(spark, d, "pages").select("page_id", F.concat(front, F.coalesce("html", F.lit(""))).alias("html"))
    rows = sources.html_tables(pages, "page_id").where("table_no = 0")
    return rows.select("page_id", "row_no", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


def quartiles_by_group(spark, d):
    q = shape.quartiles(table(spark, d, "events"), "event_type", value="value")
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


def crosstab(spark, d):
    return shape.crosstab(table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type"), "day", "event_type", EVENT_TYPES)


def null_profile(spark, d):
    return shape.null_counts(_gaps(spark, d).select("event_id", "value"))


def column_profile(spark, d):
    return shape.profile(_gaps(spark, d).select("event_id", "event_type", "value"))


def distinct_values(spark, d):
    return shape.distinct_in_order(table(spark, d, "events"), "event_type", "event_id")


def melt(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return shape.melt(df, ["p_partkey"])


def melt_skip_first(spark, d):
    """Long rows without the first in column-major order."""
    return shape.skip_first(melt(spark, d), "variable", "p_partkey")


def fill_mean(spark, d):
    return shape.fill_rounded_mean(_gaps(spark, d).select("event_id", "value"), "value")


def _search_and_prices(spark, d, *within):
    """Two daily series of events with gaps: every third search and every fourth price is null."""
    events = table(spark, d, "events")
    days = lambda kind, *more: events.where(F.col("event_type") == kind).groupBy(F.to_date("ts").alias("day"), *more)
    user = [(F.col("user_id") % 5).alias(k) for k in within]
    search = days("view", *user).agg(F.avg(shape.number("value")).alias("ratio"))
    search = search.withColumn("ratio", F.when(F.dayofmonth("day") % 3 != 0, F.col("ratio")))
    prices = days("purchase", *user).agg(F.max("value").alias("close"), F.sum(shape.number("value")).alias("volume")).withColumnRenamed("day", "trade_day")
    there = F.dayofmonth("trade_day") % 4 != 0
    prices = prices.withColumns({c: F.when(there, F.col(c)) for c in ("close", "volume")})
    return search, series.between_dates(prices, "trade_day", "2024-01-30", 60)


def align_ffill_normalise(spark, d):
    out = series.normalise_to_max(series.align(*_search_and_prices(spark, d)), "volume")
    return out.select("key", "day", F.round("ratio", 6).alias("ratio"), "close", F.round("volume", 6).alias("volume"))


def align_by_symbol(spark, d):
    """The same for five symbols side by side: the fills and the maxima stay within each."""
    out = series.align(*_search_and_prices(spark, d, "symbol"), keep_key=True, within=["symbol"])
    out = series.normalise_to_max(out, "volume", within=["symbol"])
    return out.select("symbol", "day", F.round("ratio", 6).alias("ratio"), "close", F.round("volume", 6).alias("volume"))


def json_field(spark, d):
    k = F.from_json("props", "k int")["k"]
    return shape.count_by(table(spark, d, "events").select(k.alias("k")), "k")


def json_series(spark, d):
    """A nested document of two groups is made of daily values; its first group is read back."""
    return sources.json_series(_nested(spark, d), "json")


def json_series_groups(spark, d):
    return sources.json_series(_nested(spark, d), "json", group=None)


def _nested(spark, d):
    events = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("high"), F.min("value").alias("low"))
    of = lambda c: F.struct(F.array(F.struct(F.date_format("day", "yyyy-MM-dd").alias("period"), F.col(c).alias("ratio"))).alias("data"))
    return events.select(F.to_json(F.struct(F.array(of("high"), of("low")).alias("results"))).alias("json"))


def density(spark, d):
    return shape.density(table(spark, d, "events"), "value", GRID).select("x", F.round("density", 9).alias("density"))


def density_by_group(spark, d):
    """The curves of a violin plot, one an event type."""
    return shape.density(table(spark, d, "events"), "value", GRID, ["event_type"]).select("event_type", "x", F.round("density", 9).alias("density"))


def density_own_range(spark, d):
    """Curves at 200 places of each group's own range."""
    made = shape.density(table(spark, d, "events"), "value", within=["event_type"])
    return made.select("event_type", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


def breakout_backtest(spark, d):
    return series.breakout(_bars(spark, d)).select("day", "open", "high", "low", "close", F.round("target", 6).alias("target"), F.round("factor", 6).alias("factor"))


def _curve(spark, d):
    return series.compounded(series.breakout(_bars(spark, d)))


def drawdown(spark, d):
    return series.drawdown(_curve(spark, d)).select("day", F.round("drawdown", 6).alias("drawdown"))


def compound_return(spark, d):
    df = series.breakout(_bars(spark, d)).withColumn("rate", F.col("factor") - 1)
    return df.agg(F.round(series.total_return(df, "rate"), 6).alias("total_return"), F.count(F.lit(1)).alias("days"))


def lead_lag_corr(spark, d):
    return series.lagged_correlation(_bars(spark, d), "volume", "close", [0, 1, 2, 3]).select("lag", F.round("correlation", 6).alias("correlation"))


def region_shorten(spark, d):
    df = table(spark, d, "nation").select("n_nationkey", F.concat(F.col("n_name"), F.lit(" X")).alias("full"), F.col("n_name"))
    return df.select("n_nationkey", text.shorten_region(F.col("n_name")).alias("name"), text.shorten_region(F.substring("n_name", 1, 4)).alias("short"), text.token(F.col("full"), 1).alias("second"), text.token(F.col("full"), 2).alias("third"))


def marker_projection(spark, d):
    df = table(spark, d, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return content.marker(df, at(0), at(1), F.col("vec_id").cast("string"), F.when(F.col("label") > 2, F.col("label").cast("string")), F.col("label") == 3)


def scatter_points(spark, d):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return content.points(table(spark, d, "embeddings"), at(0), at(1), F.col("label"))


def head_rows(spark, d):
    return relational.head(table(spark, d, "customer"), 5, "c_custkey").select("c_custkey", "c_name")


def range_steps(spark, d):
    return relational.steps(table(spark, d, "nation"), 5)


def unit_conversion(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 64 / 365, 6).alias("per_day"))


def tag_counts(spark, d):
    return content.tag_counts(_tagged(spark, d))


def tag_posts(spark, d):
    return content.tag_posts(_tagged(spark, d), "p_partkey", "p_name")


def sorted_tags(spark, d):
    return content.sorted_tags(_tagged(spark, d))


def post_keywords(spark, d):
    return _tagged(spark, d).select("p_partkey", text.keywords(F.col("tags")).alias("keywords"), text.column_class(F.size("tags")).alias("class"))


def list_entries(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(text.split_list(F.col("p_name"))).alias("place", "entry"))


def row_totals(spark, d):
    df = table(spark, d, "part")
    return df.select("p_partkey", relational.total(F.col("p_size").cast("double"), F.when(F.col("p_size") > 10, F.col("p_retailprice"))).alias("total"))


def reading_time(spark, d):
    """Words of each text, counted once, and the minutes that they take."""
    words = table(spark, d, "documents").select("doc_id", text.word_count(text.strip_html(F.col("text"))).alias("words"))
    return words.select("doc_id", "words", text.minutes_of(F.col("words")).alias("minutes"))


def _posts(spark, d):
    """Documents as posts: those of one language are projects, those of another say that they are none."""
    docs = table(spark, d, "documents").withColumn("project", F.when(F.col("lang") == "fr", True).when(F.col("lang") == "es", False))
    name = F.concat(F.lit("2021-09-"), F.lpad((F.col("doc_id") % 30 + 1).cast("string"), 2, "0"), F.lit("-post.md"))
    date = text.effective_date(F.when(F.col("doc_id") % 2 == 0, F.to_date(F.lit("2021-08-26"))), name)
    return docs.select("doc_id", text.first_text(F.col("source"), F.lit("site")).alias("title"), date.alias("date"), "project")


def post_listing(spark, d):
    posts = content.newest_first(content.listing(_posts(spark, d)), "date", "doc_id")
    return posts.select("doc_id", "title", "date", text.date_text(F.col("date")).alias("shown"))


def project_listing(spark, d):
    return content.newest_first(content.listing(_posts(spark, d), project=True), "date", "doc_id").drop("project")


def url_normalise(spark, d):
    return table(spark, d, "pages").select("page_id", text.canonical_url(F.col("url")).alias("canonical"), text.absolute_url(F.regexp_extract("url", "^https(.*)$", 1), "http://site").alias("absolute"))


def html_elements(spark, d):
    html = F.col("html")
    return table(spark, d, "pages").select("page_id", text.title(html).alias("title"), F.size(text.links(html)).alias("links"), F.length(text.compress_html(text.strip_html(html))).alias("text_length"))


def compressed_html(spark, d):
    """Pages with a <pre> of their own text between: white space inside it stays."""
    html = F.concat(F.col("html"), F.lit("<pre>\n  a  b\n</pre> \n <p>  end"))
    return table(spark, d, "pages").select("page_id", F.md5(text.compress_html(html)).alias("digest"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        regex_brand_count, project_rename_swap, positional_projection, compare_filters, ratio_bands, null_coalesce, inner_join_two_keys,
        index_aligned_copy, union_outer_schema, distinct_rows, append_row, topk_nulls_last, dictionary_recode, patch_rows, count_by_ordered,
        global_mean_max, mean_by_x, mean_interval, every_fifth_year, every_fifth_row, forward_fill_rows, row_drawdown, breakout_by_symbol,
        align_event_series, lead_lag_rows,
        recode_all_cells, upsert_rows, html_table_spans, quartiles_by_group, crosstab, null_profile, column_profile, distinct_values, melt,
        melt_skip_first, fill_mean, align_ffill_normalise, align_by_symbol, json_field, json_series, json_series_groups, density,
        density_by_group, density_own_range, breakout_backtest, drawdown, compound_return,
        lead_lag_corr, region_shorten, marker_projection, scatter_points, head_rows, range_steps, unit_conversion, tag_counts, tag_posts, sorted_tags,
        post_keywords, list_entries, row_totals, reading_time, post_listing, project_listing, url_normalise, html_elements, compressed_html,
    )
}
