"""Scalar functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..operators import score
from . import views as V
from .registry import query

FOLD = "replace(lower({0}), 'ß', 'ss')"


@query("canonical_urls", V.sql(select=f"SELECT page_id, {V.URL_SQL} AS canonical_url FROM pages"))
def canonical_urls(spark, sf_dir):
    return V.table(spark, sf_dir, "pages").select(
        "page_id", urls.canonical_url(urls.folded_url("url")).alias("canonical_url")
    )


@query("url_origins", r"""
SELECT split_part(lower(url), '://', 1) || '|' || regexp_extract(lower(url), '://([^/?#]*)', 1) || '|' AS origin,
  count(*) AS pages, count(DISTINCT regexp_extract(lower(url), '://([^/?#]*)', 1)) AS hosts,
  bool_and(lower(url) LIKE 'http%') AS all_public
FROM pages GROUP BY 1""")
def url_origins(spark, sf_dir):
    folded = urls.folded_url("url")
    return (
        V.table(spark, sf_dir, "pages")
        .groupBy(urls.origin_key(folded).alias("origin"))
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.countDistinct(F.split_part(urls.origin_key(folded), F.lit("|"), F.lit(2))).alias("hosts"),
            F.bool_and(urls.is_public_url(folded)).alias("all_public"),
        )
    )


@query("resolved_links", r"""
SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/feeds/' || page_id AS absolute,
  CASE WHEN regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) LIKE '%/%'
    THEN regexp_extract(url, '^(https?://[^?#]*/)', 1) ELSE url || '/' END || 'item-' || page_id AS sibling
FROM pages""")
def resolved_links(spark, sf_dir):
    key = F.col("page_id").cast("string")
    return V.table(spark, sf_dir, "pages").select(
        "page_id",
        urls.resolve_link("url", F.concat(F.lit("/feeds/x/../"), key)).alias("absolute"),
        urls.resolve_link("url", F.concat(F.lit("./item-"), key)).alias("sibling"),
    )


@query("canonical_numbers", r"""
SELECT o_orderkey,
  CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
    ELSE rtrim(printf('%.2f', o_totalprice), '0') END AS price,
  CAST(o_orderkey AS VARCHAR) AS padded
FROM orders""")
def canonical_numbers(spark, sf_dir):
    grouped = F.format_number("o_totalprice", 2)
    padded = F.concat(F.lit("+"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".000"))
    return V.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.canonical_number(grouped).alias("price"), text.canonical_number(padded).alias("padded")
    )


@query("title_identities", V.sql(V.ARTICLES, V.TITLED, select=r"""
SELECT article_id, regexp_replace(f_title, '[\s\-]+', ' ', 'g') AS searchable, norm_title, length(norm_title) AS norm_length
FROM titled"""))
def title_identities(spark, sf_dir):
    df = V.articles(spark, sf_dir).withColumn("folded", text.folded_title("title"))
    return df.select(
        "article_id", text.searchable_text("title").alias("searchable"), text.normalize_title("folded").alias("norm_title")
    ).withColumn("norm_length", F.length("norm_title").cast("bigint"))


@query("title_numbers", V.sql(V.ARTICLES, V.TITLED, select="""
SELECT article_id, len(numbers) AS n_numbers, array_to_string(numbers, ' ') AS numbers FROM titled"""))
def title_numbers(spark, sf_dir):
    df = V.articles(spark, sf_dir).select("article_id", text.number_signature(text.folded_title("title")).alias("n"))
    shown = F.transform("n", lambda n: F.concat_ws("|", n["value"], n["unit"]))
    return df.select("article_id", F.size("n").cast("bigint").alias("n_numbers"), F.array_join(shown, " ").alias("numbers"))


@query("material_groups", V.sql(V.ARTICLES, V.TITLED, select="""
SELECT norm_title, count(*) AS articles, count(DISTINCT material) AS variants FROM titled GROUP BY norm_title"""))
def material_groups(spark, sf_dir):
    """How many materially different versions each title identity has."""
    return V.fingerprints(V.articles(spark, sf_dir)).groupBy("norm_title").agg(
        F.count(F.lit(1)).alias("articles"), F.countDistinct("material").alias("variants")
    )


@query("stage_and_calendar_terms", V.sql(V.ARTICLES, select=r"""
SELECT article_id,
  CAST(regexp_matches(f_full, '(^|[^a-z])may($|[^a-z])') AS INTEGER) AS has_may,
  CAST(regexp_matches(f_full, '(^|[^a-z])draft($|[^a-z])') AS INTEGER) AS has_draft,
  CAST(regexp_matches(f_full, '(^|[^a-z])(today|tomorrow|yesterday)($|[^a-z])') AS INTEGER) AS has_day
FROM articles"""))
def stage_and_calendar_terms(spark, sf_dir):
    df = V.articles(spark, sf_dir).withColumn("folded", text.folded_title("full_text"))
    calendar = text.calendar_signature("folded")
    stages = text.stage_signature("folded")
    days = F.array(F.lit("today"), F.lit("tomorrow"), F.lit("yesterday"))
    return df.select(
        "article_id",
        F.array_contains(calendar, "month-5").cast("int").alias("has_may"),
        F.array_contains(stages, "draft").cast("int").alias("has_draft"),
        F.arrays_overlap(calendar, days).cast("int").alias("has_day"),
    )


@query("char_grams", V.sql(V.ARTICLES, select=f"""
SELECT gram, count(*) AS titles FROM (
  SELECT DISTINCT article_id, substr(t, i, 3) AS gram FROM (
    SELECT article_id, t, unnest(generate_series(1, greatest(1, length(t) - 2))) AS i
    FROM (SELECT article_id, f_title AS t FROM articles WHERE f_title <> '')))
GROUP BY gram"""))
def char_grams(spark, sf_dir):
    df = V.articles(spark, sf_dir).select("article_id", text.fold("title").alias("t"))
    return df.select(F.explode(text.char_grams("t", 3)).alias("gram")).groupBy("gram").agg(
        F.count(F.lit(1)).alias("titles")
    )


@query("plain_text", r"""
SELECT conv_id, turn, substr(trim(regexp_replace(regexp_replace(text, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 1, 4000) AS body
FROM (SELECT conv_id, turn, replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&') AS text
      FROM conversations)""")
def plain_text(spark, sf_dir):
    marked = F.concat(F.lit("<p>"), F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("</p>\n<br/>"))
    return V.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.plain_text(marked, 4000).alias("body")
    )


@query("parse_keyword_lists", r"""
WITH words AS (
  SELECT conv_id, turn, pos, trim(regexp_replace(w, '\s+', ' ', 'g')) AS w,
    replace(lower(trim(regexp_replace(w, '\s+', ' ', 'g'))), 'ß', 'ss') AS k
  FROM (SELECT conv_id, turn, unnest(parts) AS w, generate_subscripts(parts, 1) AS pos
        FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[,;\r\n]+') AS parts FROM conversations)))
SELECT conv_id, turn, count(*) AS n_keywords, string_agg(w, '|' ORDER BY pos) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn, k ORDER BY pos) AS rn FROM words WHERE w <> '')
WHERE rn = 1 GROUP BY ALL""")
def parse_keyword_lists(spark, sf_dir):
    words = text.parse_keywords("text")
    return V.table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w")).where(
        "size(w) > 0"
    ).select(
        "conv_id", "turn", F.size("w").cast("bigint").alias("n_keywords"), F.array_join("w", "|").alias("keywords")
    )


@query("published_parse", V.sql(V.ARTICLES, select="""
SELECT article_id, date_kind, CAST(epoch(published) AS BIGINT) AS published_epoch,
  CAST(coalesce(epoch(published), 0) AS BIGINT) AS published_rank FROM articles"""))
def published_parse(spark, sf_dir):
    ts = dates.published_timestamp("published_at")
    kind = F.when(F.col("published_at").isNull(), "missing").when(ts.isNull(), "invalid").otherwise("dated")
    return V.articles(spark, sf_dir).select(
        "article_id", kind.alias("date_kind"), F.unix_seconds(ts).alias("published_epoch"),
        dates.published_rank(ts).cast("bigint").alias("published_rank"),
    )


_REASON = f"""CASE WHEN date_kind = 'missing' THEN 'date_missing' WHEN date_kind = 'invalid' THEN 'date_invalid'
  WHEN published > TIMESTAMP '{V.AS_OF}' + INTERVAL 1 DAY THEN 'date_future'
  WHEN published < TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY THEN 'date_stale' END"""


@query("freshness_reasons", V.sql(V.ARTICLES, select=f"""
SELECT article_id, coalesce({_REASON}, 'fresh') AS verdict FROM articles"""))
def freshness_reasons(spark, sf_dir):
    return V.dated_articles(spark, sf_dir).select(
        "article_id", F.coalesce("date_reason", F.lit("fresh")).alias("verdict")
    )


@query("freshness_windows", V.sql(V.ARTICLES, select=f"""
SELECT days, count(*) FILTER (date_kind = 'dated' AND published <= TIMESTAMP '{V.AS_OF}' + INTERVAL 1 DAY
    AND published >= TIMESTAMP '{V.AS_OF}' - days * INTERVAL 1 DAY) AS fresh
FROM articles, (VALUES (1), (3), (7), (14), (30)) w(days) GROUP BY days"""))
def freshness_windows(spark, sf_dir):
    df = V.articles(spark, sf_dir).withColumn("ts", dates.published_timestamp("published_at"))
    passed = [
        F.count_if(dates.date_reason("published_at", "ts", V.as_of(), d).isNull()).alias(str(d))
        for d in dates.FRESHNESS_WINDOWS
    ]
    return df.agg(*passed).unpivot([], [str(d) for d in dates.FRESHNESS_WINDOWS], "days", "fresh").select(
        F.col("days").cast("int").alias("days"), "fresh"
    )


@query("content_hashes", V.sql(V.ARTICLES, V.TITLED, select="""
SELECT article_id, sha256(canonical_url || chr(10) || norm_title) AS content_hash FROM titled"""))
def content_hashes(spark, sf_dir):
    return V.fingerprints(V.articles(spark, sf_dir)).select("article_id", score.content_hash().alias("content_hash"))


@query("analysis_fingerprints", V.sql(V.ARTICLES, V.TITLED, select="""
SELECT article_id, sha256(canonical_url || chr(1) || norm_title || chr(1) || excerpt || chr(1) || full_text || chr(1)
  || CAST(CAST(coalesce(epoch(published), 0) AS BIGINT) AS VARCHAR)) AS fingerprint FROM titled"""))
def analysis_fingerprints(spark, sf_dir):
    # DuckDB strings cannot hold NUL, so both sides of this check use \x01 as separator
    epoch = F.coalesce(F.unix_seconds(dates.published_timestamp("published_at")), F.lit(0)).cast("string")
    parts = ["canonical_url", "norm_title", "excerpt", "full_text", epoch]
    return V.fingerprints(V.articles(spark, sf_dir)).select(
        "article_id", F.sha2(F.concat_ws("\x01", *parts), 256).alias("fingerprint")
    )


@query("safe_run_ids", r"""
SELECT o_orderkey, rid, regexp_matches(rid, '^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$')
  AND NOT (split_part(lower(rid), '.', 1) IN ('aux', 'con', 'nul', 'prn') OR regexp_matches(lower(rid), '^(com|lpt)[1-9](\.|$)')) AS safe
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'com' || (o_orderkey % 12) || '.x'
  WHEN 'O' THEN o_orderpriority || o_orderkey ELSE 'run-' || o_orderkey END AS rid FROM orders)""")
def safe_run_ids(spark, sf_dir):
    from ..operators.validate import is_safe_id

    key = F.col("o_orderkey")
    rid = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("com"), (key % 12).cast("string"), F.lit(".x")))
        .when(F.col("o_orderstatus") == "O", F.concat("o_orderpriority", key.cast("string")))
        .otherwise(F.concat(F.lit("run-"), key.cast("string")))
    )
    return V.table(spark, sf_dir, "orders").select("o_orderkey", rid.alias("rid"), is_safe_id(rid).alias("safe"))


@query("source_scope", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, select="""
SELECT t.topic_id, s.source_id, count(*) AS articles FROM articles a
JOIN sources s ON s.source_id = a.source_id AND s.enabled AND NOT s.archived
JOIN topics t ON NOT t.archived AND (len(t.source_ids) = 0 OR list_contains(t.source_ids, a.source_id))
GROUP BY ALL"""))
def source_scope(spark, sf_dir):
    from ..plans.digest import topic_scope

    live_topics = V.topics(spark).where("NOT archived")
    scope = topic_scope(live_topics, V.sources(spark, sf_dir)).select("topic_id", "source_id")
    counted = V.articles(spark, sf_dir).groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
    return counted.join(scope, "source_id").select("topic_id", "source_id", "articles")


@query("scan_union", V.sql(V.TOPICS, V.SOURCES, select="""
SELECT DISTINCT s.source_id, s.name FROM sources s JOIN topics t ON t.enabled AND NOT t.archived
  AND (len(t.source_ids) = 0 OR list_contains(t.source_ids, s.source_id))
WHERE s.enabled AND NOT s.archived"""))
def scan_union(spark, sf_dir):
    """Sources that any active topic reads, each once."""
    from ..operators.match import active_topics
    from ..plans.digest import topic_scope

    srcs = V.sources(spark, sf_dir)
    scope = topic_scope(active_topics(V.topics(spark)), srcs).select("source_id").distinct()
    return srcs.join(scope, "source_id", "left_semi").select("source_id", "name")


@query("effective_settings", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, select="""
SELECT t.topic_id, a.lang, coalesce(t.threshold, 60) AS threshold,
  least(coalesce(t.threshold, 60), greatest(40, coalesce(t.threshold, 60) - 15)) AS supplement_threshold,
  coalesce(t.article_limit, 20) AS article_limit, count(*) AS articles
FROM articles a JOIN topics t ON len(t.source_ids) = 0 OR list_contains(t.source_ids, a.source_id)
GROUP BY ALL"""))
def effective_settings(spark, sf_dir):
    from ..plans.digest import settings

    topics = V.topics(spark)
    per_source = V.articles(spark, sf_dir).groupBy("lang", "source_id").agg(F.count(F.lit(1)).alias("n"))
    ids = [(r.topic_id, list(r.source_ids)) for r in topics.collect()]
    scoped = per_source.select(
        "lang", "n", F.explode(F.array_compact(F.array(*[
            F.when(F.col("source_id").isin(only) if only else F.lit(True), F.lit(t)) for t, only in ids
        ]))).alias("topic_id"),
    )
    return (
        scoped.groupBy("topic_id", "lang").agg(F.sum("n").alias("articles"))
        .join(settings(topics), "topic_id")
        .select("topic_id", "lang", "threshold", "supplement_threshold", "article_limit", "articles")
    )
