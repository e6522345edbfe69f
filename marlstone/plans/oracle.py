"""SQL of the registered queries, written independently of the operators."""

import math

_GAPS = "SELECT event_id, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events"
_BARS = """SELECT CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
arg_max(value, (ts, event_id)) AS close, sum(value) AS volume FROM events GROUP BY 1"""
_SIGNAL = f"""b AS ({_BARS}), t AS (SELECT *, open + 0.5 * (lag(high) OVER (ORDER BY day) - lag(low) OVER (ORDER BY day)) AS target FROM b),
f AS (SELECT *, CASE WHEN high >= target THEN close / target ELSE 1.0 END AS factor FROM t)"""
_TAGS = "SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS tag FROM part"
_STRIP = "regexp_replace({0}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>', '', 'g')"
_WORDS = f"len(regexp_extract_all({_STRIP.format('text')}, '[^ \\t\\n\\r\\f\\x0B]+'))"

_POSTED = "CASE WHEN doc_id % 2 = 0 THEN DATE '2021-08-26' ELSE DATE '2021-09-01' + CAST(doc_id % 30 AS INTEGER) END"


def _unit(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('/', {', '.join(parts)})), 1, 12) AS BIGINT)"


def _poisson(u: str) -> str:
    """How many Poisson steps of mean 1 a number below 16**12 passes."""
    sure = [sum(math.exp(-1) / math.factorial(j) for j in range(k)) for k in range(1, 13)]
    return " + ".join(f"CAST({u} >= {int(s * 16**12)} AS INTEGER)" for s in sure)


ORACLE_SQL = {
    "regex_brand_count": """SELECT p_type, CASE WHEN contains(p_name, 'widget') THEN 'widget' ELSE 'cold' END AS brand, count(*) AS n
FROM part WHERE contains(p_name, 'widget') OR contains(p_name, 'cold') GROUP BY 1, 2""",
    "project_rename_swap": "SELECT c_custkey, c_name AS c_mktsegment, c_mktsegment AS segment FROM customer",
    "positional_projection": "SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS price FROM orders",
    "compare_filters": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 AND l_discount >= CAST(0.05 AS DOUBLE) AND l_tax < CAST(0.03 AS DOUBLE)",
    "ratio_bands": "SELECT CASE WHEN l_tax = 0 OR l_tax IS NULL OR l_discount IS NULL THEN 'none' WHEN l_discount / l_tax * 100 >= 100 THEN 'high' ELSE 'low' END AS band, count(*) AS n FROM lineitem GROUP BY 1",
    "null_coalesce": f"SELECT event_id, coalesce(value, CAST(event_id % 100 AS DOUBLE)) AS value FROM ({_GAPS})",
    "inner_join_two_keys": "SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name, CAST(round(o_totalprice * 100) AS BIGINT) AS price_cents FROM orders JOIN (SELECT DISTINCT c_custkey, c_name FROM customer) ON o_custkey = c_custkey",
    "index_aligned_copy": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice FROM orders",
    "union_outer_schema": "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier",
    "distinct_rows": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
    "append_row": "SELECT r_regionkey, r_name FROM region UNION ALL SELECT CAST(99 AS INTEGER), 'ATLANTIS'",
    "topk_nulls_last": "SELECT p_partkey, p_name FROM part ORDER BY CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END NULLS LAST, p_partkey LIMIT 10",
    "dictionary_recode": "SELECT CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "patch_rows": "SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'THIRD' WHEN 4 THEN 'FOURTH' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 0",
    "count_by_ordered": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END AS position FROM orders WHERE o_orderpriority IN ('5-LOW', '1-URGENT', '3-MEDIUM') GROUP BY 1, 2",
    "global_mean_max": "SELECT round(avg(c_acctbal), 6) AS mean_balance, max(c_acctbal) AS max_balance, count(*) AS n FROM customer",
    "mean_by_x": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 6) AS mean, count(o_totalprice) AS n FROM orders GROUP BY 1",
    "every_fifth_year": "SELECT CAST(y AS INTEGER) AS year FROM (SELECT y, row_number() OVER (ORDER BY y) AS rn FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders)) WHERE (rn - 1) % 5 = 0",
    "quartiles_by_group": "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1",
    "crosstab": "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "null_profile": f"SELECT 'event_id' AS variable, count(*) - count(event_id) AS nulls FROM ({_GAPS}) UNION ALL SELECT 'value', count(*) - count(value) FROM ({_GAPS})",
    "column_profile": " UNION ALL ".join(f"SELECT '{c}' AS variable, '{t}' AS type, count({c}) AS non_null, count(*) AS total FROM ({_GAPS})" for c, t in (("event_id", "bigint"), ("event_type", "string"), ("value", "double"))),
    "distinct_values": "SELECT event_type, min(event_id) AS first_row FROM events GROUP BY 1",
    "melt": "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part",
    "melt_skip_first": "SELECT * FROM (SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part) ORDER BY variable, p_partkey OFFSET 1",
    "fill_mean": f"WITH g AS ({_GAPS}), m AS (SELECT round_even(avg(value), 0) AS m FROM g) SELECT event_id, coalesce(value, m) AS value FROM g, m",
    "align_ffill_normalise": f"""WITH s AS (SELECT CAST(ts AS DATE) AS day, CASE WHEN dayofmonth(CAST(ts AS DATE)) % 3 <> 0 THEN avg(value) END AS ratio FROM events WHERE event_type = 'view' GROUP BY 1),
p AS (SELECT CAST(ts AS DATE) AS trade_day, CASE WHEN dayofmonth(CAST(ts AS DATE)) % 4 <> 0 THEN max(value) END AS close, CASE WHEN dayofmonth(CAST(ts AS DATE)) % 4 <> 0 THEN sum(value) END AS volume FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING CAST(ts AS DATE) BETWEEN DATE '2023-12-01' AND DATE '2024-01-30'),
j AS (SELECT coalesce(day, trade_day) AS key, day, ratio, close, volume FROM s FULL JOIN p ON day = trade_day),
f AS (SELECT key, last_value(day IGNORE NULLS) OVER w AS day, last_value(ratio IGNORE NULLS) OVER w AS ratio, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume FROM j WINDOW w AS (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT key, day, round(ratio, 6) AS ratio, close, round(volume / max(volume) OVER () * 100, 6) AS volume FROM f""",
    "align_by_symbol": f"""WITH s AS (SELECT CAST(ts AS DATE) AS day, user_id % 5 AS symbol, CASE WHEN dayofmonth(CAST(ts AS DATE)) % 3 <> 0 THEN avg(value) END AS ratio FROM events WHERE event_type = 'view' GROUP BY 1, 2),
p AS (SELECT CAST(ts AS DATE) AS day, user_id % 5 AS symbol, CASE WHEN dayofmonth(CAST(ts AS DATE)) % 4 <> 0 THEN max(value) END AS close, CASE WHEN dayofmonth(CAST(ts AS DATE)) % 4 <> 0 THEN sum(value) END AS volume FROM events WHERE event_type = 'purchase' GROUP BY 1, 2 HAVING CAST(ts AS DATE) BETWEEN DATE '2023-12-01' AND DATE '2024-01-30'),
j AS (SELECT symbol, day, ratio, close, volume FROM s FULL JOIN p USING (symbol, day)),
f AS (SELECT symbol, day, last_value(ratio IGNORE NULLS) OVER w AS ratio, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume FROM j WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT symbol, day, round(ratio, 6) AS ratio, close, round(volume / max(volume) OVER (PARTITION BY symbol) * 100, 6) AS volume FROM f""",
    "json_field": "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1",
    "json_series": "SELECT CAST(ts AS DATE) AS period, max(value) AS ratio FROM events GROUP BY 1",
    "density": """WITH s AS (SELECT count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events), g AS (SELECT CAST(unnest(range(0, 501, 25)) AS DOUBLE) AS x)
SELECT x, round(sum(exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM events, s, g GROUP BY x""",
    "json_series_groups": "SELECT CAST(0 AS INTEGER) AS \"group\", CAST(ts AS DATE) AS period, max(value) AS ratio FROM events GROUP BY 2 UNION ALL SELECT 1, CAST(ts AS DATE), min(value) FROM events GROUP BY 2",
    "density_by_group": """WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h FROM events GROUP BY 1), g AS (SELECT CAST(unnest(range(0, 501, 25)) AS DOUBLE) AS x)
SELECT event_type, x, round(sum(exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM events JOIN s USING (event_type), g GROUP BY 1, 2""",
    "breakout_backtest": f"WITH {_SIGNAL} SELECT day, open, high, low, close, round(target, 6) AS target, round(factor, 6) AS factor FROM f",
    "drawdown": f"WITH {_SIGNAL}, e AS (SELECT day, exp(sum(ln(factor)) OVER (ORDER BY day)) AS equity FROM f) SELECT day, round(equity / max(equity) OVER (ORDER BY day) - 1, 6) AS drawdown FROM e",
    "compound_return": f"WITH {_SIGNAL} SELECT round(product(factor) - 1, 6) AS total_return, count(*) AS days FROM f",
    "lead_lag_corr": f"WITH b AS ({_BARS}), l AS (SELECT close, volume, lag(volume, 1) OVER w AS l1, lag(volume, 2) OVER w AS l2, lag(volume, 3) OVER w AS l3 FROM b WINDOW w AS (ORDER BY day)) "
    + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS lag, round(corr(close, {c}), 6) AS correlation FROM l" for k, c in enumerate(("volume", "l1", "l2", "l3"))),
    "region_shorten": "SELECT n_nationkey, CASE WHEN length(n_name) = 4 THEN n_name[1] || n_name[3] ELSE left(n_name, 2) END AS name, CASE WHEN length(left(n_name, 4)) = 4 THEN n_name[1] || n_name[3] ELSE left(n_name, 2) END AS short, 'X' AS second, CAST(NULL AS VARCHAR) AS third FROM nation",
    "marker_projection": "SELECT CAST(embedding[1] AS DOUBLE) AS lat, CAST(embedding[2] AS DOUBLE) AS lon, CAST(vec_id AS VARCHAR) || ' - ' || CASE WHEN label > 2 THEN CAST(label AS VARCHAR) ELSE '' END AS tooltip, CASE WHEN label = 3 THEN 'brown' ELSE 'green' END AS color, CAST(CASE WHEN label = 3 THEN 3 ELSE 2 END AS INTEGER) AS radius FROM embeddings",
    "scatter_points": "SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label AS hue FROM embeddings",
    "head_rows": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5",
    "range_steps": "SELECT CAST(unnest(range(0, (SELECT count(*) FROM nation), 5)) AS BIGINT) AS place",
    "unit_conversion": "SELECT l_orderkey, l_linenumber, round(l_quantity * 64 / 365, 6) AS per_day FROM lineitem",
    "tag_counts": f"SELECT tag, count(*) AS posts FROM ({_TAGS}) GROUP BY 1",
    "tag_posts": f"SELECT tag, p_partkey, p_name FROM ({_TAGS})",
    "reading_time": f"SELECT doc_id, CAST({_WORDS} AS INTEGER) AS words, CAST(greatest(1, round({_WORDS} / 200.0)) AS INTEGER) AS minutes FROM documents",
    "sorted_tags": f"SELECT tag, count(*) AS posts FROM ({_TAGS}) GROUP BY 1 ORDER BY tag",
    "post_keywords": "SELECT p_partkey, nullif(replace(p_name, ' ', ', '), '') AS keywords, CASE len(string_split(p_name, ' ')) WHEN 2 THEN 'half' WHEN 3 THEN 'third' ELSE '' END AS class FROM part",
    "list_entries": "SELECT p_partkey, CAST(unnest(range(len(w))) AS INTEGER) AS place, unnest(w) AS entry FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)",
    "row_totals": "SELECT p_partkey, CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) + p_retailprice END AS total FROM part",
    "post_listing": f"SELECT doc_id, coalesce(nullif(source, ''), 'site') AS title, {_POSTED} AS date, strftime({_POSTED}, '%d %b %Y') AS shown FROM documents WHERE lang IS NULL OR lang NOT IN ('fr', 'es')",
    "project_listing": f"SELECT doc_id, coalesce(nullif(source, ''), 'site') AS title, {_POSTED} AS date FROM documents WHERE lang = 'fr'",
    "url_normalise": "SELECT page_id, rtrim(replace(url, 'index.html', ''), '/') AS canonical, CASE WHEN starts_with(url, 'https') THEN CASE WHEN contains(url[6:], '://') THEN url[6:] ELSE 'http://site' || url[6:] END ELSE 'http://site' END AS absolute FROM pages",
    "html_elements": f"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS INTEGER) AS links,
CAST(length(trim(regexp_replace({_STRIP.format('html')}, '\\s+', ' ', 'g'))) AS INTEGER) AS text_length FROM pages""",
    "compressed_html": """SELECT page_id, md5(ltrim(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '\\s+', ' ', 'g'), ' ') || '<pre>' || chr(10) || '  a  b' || chr(10) || '</pre> <p> end') AS digest FROM pages""",
    "mean_interval": f"""WITH b AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, {_unit('CAST(o_orderkey AS VARCHAR)')} % 1024 AS b, sum(o_totalprice) AS s, count(*) AS n FROM orders GROUP BY 1, 2),
k AS (SELECT *, {_unit('CAST(b AS VARCHAR)', 'CAST(k AS VARCHAR)')} AS u FROM b, range(1, 201) t(k)), w AS (SELECT *, {_poisson('u')} AS w FROM k),
m AS (SELECT year, k, sum(w * s) / sum(w * n) AS mean FROM w GROUP BY 1, 2), q AS (SELECT year, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM m GROUP BY 1)
SELECT year, round(sum(s) / sum(n), 6) AS mean, round(any_value(low), 6) AS low, round(any_value(high), 6) AS high, CAST(sum(n) AS BIGINT) AS n FROM b JOIN q USING (year) GROUP BY 1""",
    "every_fifth_row": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) WHERE rn % 5 = 1",
    "forward_fill_rows": f"SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM (SELECT g.event_id, e.ts, g.value FROM ({_GAPS}) g JOIN events e USING (event_id))",
    "row_drawdown": """WITH e AS (SELECT event_id, user_id, ts, exp(sum(ln(1 + (value - 250) / 10000)) OVER w) AS equity FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT event_id, round(equity, 6) AS equity, round(equity / max(equity) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) AS drawdown FROM e""",
    "breakout_by_symbol": """WITH b AS (SELECT user_id % 5 AS symbol, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY 1, 2),
t AS (SELECT *, open + 0.5 * (lag(high) OVER w - lag(low) OVER w) AS target FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, round(target, 6) AS target, round(CASE WHEN high >= target THEN close / target ELSE 1.0 END, 6) AS factor FROM t""",
    "recode_all_cells": "SELECT CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%L%' THEN reverse(p_brand) ELSE p_brand END AS p_brand, CASE WHEN p_type LIKE '%1' OR p_type LIKE '%L%' THEN reverse(p_type) ELSE p_type END AS p_type, count(*) AS n FROM part GROUP BY 1, 2",
    "upsert_rows": "SELECT c_custkey, c_name, c_nationkey, round(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 100000000, c_name, NULL, NULL, NULL FROM customer WHERE c_custkey % 10 = 0",
    "html_table_spans": """WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS id, trim(regexp_replace(regexp_replace(coalesce(url, ''), '[<>&]', '', 'g'), '\\s+', ' ', 'g')) AS u, length(regexp_replace(coalesce(url, ''), '[<>&]', '', 'g')) AS n FROM pages)
SELECT page_id, CAST(k AS INTEGER) AS row_no, CAST(3 AS INTEGER) AS n_cells, CASE k WHEN 0 THEN 'page|url|url' WHEN 1 THEN 'page|text|length' WHEN 2 THEN id || '|' || u || '|' || n WHEN 3 THEN id || '|none|none' END AS cells FROM p, range(4) t(k)
UNION ALL SELECT page_id, 4, 1, id FROM p""",
    "density_own_range": """WITH s AS (SELECT event_type, count(value) AS n, stddev_samp(value) * pow(count(value), -0.2) AS h, min(value) AS low, max(value) AS high FROM events GROUP BY 1),
g AS (SELECT *, (low - 3 * h) + ((high + 3 * h) - (low - 3 * h)) * i / 199 AS x FROM s, range(200) t(i))
SELECT event_type, round(x, 6) AS x, round(sum(exp(-pow((x - value) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM events JOIN g USING (event_type) GROUP BY event_type, x""",
    "align_event_series": """WITH s AS (SELECT event_id AS day, CASE WHEN event_id % 3 <> 0 THEN value END AS ratio FROM events WHERE event_type = 'view'),
p AS (SELECT event_id AS trade_day, CASE WHEN event_id % 4 <> 0 THEN value END AS close FROM events WHERE event_type = 'purchase'),
j AS (SELECT coalesce(day, trade_day) AS key, day, ratio, close FROM s FULL JOIN p ON day = trade_day)
SELECT key, last_value(day IGNORE NULLS) OVER w AS day, last_value(ratio IGNORE NULLS) OVER w AS ratio, last_value(close IGNORE NULLS) OVER w AS close FROM j WINDOW w AS (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "lead_lag_rows": "WITH l AS (SELECT value AS y, value AS l0, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, lag(value, 3) OVER w AS l3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id)) "
    + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS lag, round(corr(y, l{k}), 6) AS correlation FROM l" for k in range(4)),
}
