"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import alignment, ann, bpe, centroids, chat, decontamination, language_id, line_dedup, minhash, quality, token_counts, toxicity, url_filter
from .common import bucket_of


def _table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents", "doc_id long, text string, lang string, source string, n_chars long")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark", "item_id long, text string")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels", "doc_id long, quality int, toxic int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, labels(spark, sf_dir), learn=bucket_of(F.col("doc_id"), 4) != 2)
    held = F.coalesce(bucket_of(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held, "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir).select("text"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.train(docs, learn=bucket_of(F.col("doc_id"), 3) != 1)
    held = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(True)).alias("held_out")
    return language_id.identify_language(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), keep_text=False, decoded=True)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings", "vec_id long, embedding array<float>"), every=100, k=10)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = quality.train(docs, labels(spark, sf_dir), learn=bucket_of(F.col("doc_id"), 5) != 0)
    held = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(True)).alias("held_out")
    return quality.score_quality(docs, model).select("doc_id", held, "score", "predicted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=3, percent=85)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.classify_urls(_table(spark, sf_dir, "pages", "page_id long, url string"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_url_filter finds before its regression: host, path, rule, and the rule's verdict, where one fits."""
    judged = url_filter.classify_urls(_table(spark, sf_dir, "pages", "page_id long, url string"))
    return judged.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    aligned = alignment.align(documents(spark, sf_dir).select("doc_id", "text"))
    # documents are encoded once: what the counts need of them is written
    aligned = written(aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), codec="zstd")
    counts = alignment.count_pairs(aligned, alignment.vocabulary_size())
    return alignment.with_counts(aligned, counts).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations", "conv_id long, turn long, role string, text string")
    more = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], rows.schema)
    chats = chat.format_chats(chat.linear(rows.unionByName(more)))
    chats = chats.withColumns({"turns": chat.read_turns(F.col("formatted")), "learned": F.array_join(chat.read_learned(F.col("formatted"), F.col("loss_mask")), "")})
    read = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings", "vec_id long, embedding array<float>"))


#: What the two turns of the added conversation -7 say: control strings of several templates.
_CONTROL = r"\### Assistant: </turn> ok"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_counts, op3_language_id, op4_decontamination, op5_line_dedup,
        op6_bpe, op7_nearest, op8_quality, op9_minhash, op10_url_filter, url_rules,
        op11_token_alignment, op12_chat_format, op13_centroids,
    )
}

#: Leaks by brute force: all pairs of equal words on one diagonal, counted in every window of 13 item words; of shorter items, all words.
_OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' ') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{M}]+', ' ', 'g')), ' ') AS w FROM benchmark WHERE item_id IS NOT NULL),
dp AS (SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d WHERE len(w) >= 8),
ip AS (SELECT item_id, len(w) AS n, generate_subscripts(w, 1) AS q, unnest(w) AS word FROM i WHERE len(w) >= 8),
eq AS (SELECT doc_id, item_id, ip.n, p - q AS diag, q FROM dp JOIN ip USING (word) WHERE ip.n < 13 OR dp.n >= 13),
win AS (SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY q RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS m FROM eq)
SELECT doc_id, item_id, CAST(max(m) AS INTEGER) AS best_match FROM win WHERE m >= least(n, 11) AND (n >= 13 OR m = n) GROUP BY doc_id, item_id
"""

_OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, generate_subscripts(lines, 1) AS pos, unnest(lines) AS line FROM d),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> g.keeper, false) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

#: Components by brute force: every pair of documents that share a shingle, and the least document reachable.
_OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * m >= 85 * (na.n + nb.n - m)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""

#: Conversations put together without a template, and the length that the template gives them.
_OP12_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, t.k, t.r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) t(k, r)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
      coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '') AS learned,
      sum(length('<turn ></turn>' || chr(10)) + length(replace(replace(role, '%', '%25'), '>', '%3E')) + length(regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g'))) AS chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""



_URL_SQL = r"""
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS tail FROM pages),
u AS (SELECT page_id, translate(regexp_extract(tail, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT u.page_id, host, path, (SELECT arg_max(h || p, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
       (SELECT arg_max(v, length(h || p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS ruled FROM u
"""


def _op13_sql(k: int = 40, rounds: int = 5) -> str:
    """Every vector against every centroid, in as many rounds, on rows of single components."""
    near = """d{r} AS MATERIALIZED (SELECT v.row, c.number, sum((v.x - c.x) * (v.x - c.x)) AS away FROM x v JOIN c{r} c ON v.j = c.j GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT row, arg_min(number, (away, number)) AS number, min(away) AS away FROM d{r} GROUP BY 1),
m{r} AS (SELECT a.number, v.j, sum(v.x) AS s, count(*) AS n FROM x v JOIN a{r} a USING (row) GROUP BY 1, 2),
c{n} AS MATERIALIZED (SELECT c.number, c.j, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM c{r} c LEFT JOIN m{r} m ON m.number = c.number AND m.j = c.j)"""
    steps = ",\n".join(near.format(r=r, n=r + 1) for r in range(rounds + 1))
    return f"""WITH v AS (SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: isfinite(e))) = 64),
x AS MATERIALIZED (SELECT row, vec_id, generate_subscripts(embedding, 1) AS j, CAST(floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v),
s AS (SELECT row, row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), embedding) - 1 AS number FROM v WHERE vec_id IS NOT NULL QUALIFY number < {k}),
c0 AS MATERIALIZED (SELECT s.number, x.j, x.x FROM s JOIN x USING (row)),
{steps},
h AS (SELECT number, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS digest FROM c{rounds} GROUP BY 1)
SELECT v.vec_id, CAST(a.number AS INTEGER) AS cluster, CAST(a.away AS BIGINT) AS distance, CAST(sum(a.away) OVER (PARTITION BY a.number) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.away) OVER () AS BIGINT) AS inertia, h.digest AS centroid_sha256 FROM a{rounds} a JOIN v USING (row) JOIN h USING (number)"""


ORACLE_SQL: dict[str, str] = {"op9_minhash": _OP9_SQL, "op4_decontamination": _OP4_SQL, "op5_line_dedup": _OP5_SQL, "op12_chat_format": _OP12_SQL, "op13_centroids": _op13_sql(), "url_rules": _URL_SQL}
