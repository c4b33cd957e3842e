"""Rules of topics, sources, cache keys, imports and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import catalog, funnel, history, match, merge, rank, score
from ..session import shared_folder
from ..sources import files
from ..streaming import jobs
from . import views as V
from .bundles import _SIDES, _maps, runs_of
from .intake import _drain, _events
from .matching import matches
from .registry import query


@query("requested_topic_hits", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, V.MATCHES, select="""
SELECT topic_id, count(*) AS hits FROM verdict WHERE topic_id IN ('t2', 't4') AND n_in > 0 AND n_ex = 0 GROUP BY 1"""))
def requested_topic_hits(spark, sf_dir):
    """A run for some of the topics only."""
    wanted = match.active_topics(V.topics(spark), ["t4", "t2"]).select("topic_id")
    return matches(spark, sf_dir).where("matched").join(wanted, "topic_id").groupBy("topic_id").agg(F.count(F.lit(1)).alias("hits"))


_SEPARATED = " || '\\x00'::BLOB || "


@query("score_cache_keys", V.sql(V.ARTICLES, V.TITLED, V.TOPICS, f"""
prints AS (SELECT article_id, sha256({_SEPARATED.join(f"encode({c})" for c in (
    "canonical_url", "norm_title", "coalesce(excerpt, '')", "coalesce(full_text, '')", "coalesce(strftime(created_at, '%Y-%m-%d'), '')"))}) AS fingerprint FROM titled),
configs AS (SELECT topic_id, sha256(to_json(struct_pack(exclusion_keywords := exclusion_keywords,
    keywords := CASE WHEN len(keywords) > 0 THEN keywords ELSE [name] END, name := name, scoring_policy_version := 2))::VARCHAR) AS config
  FROM topics WHERE enabled AND NOT archived)""", select=f"""
SELECT topic_id, article_id, fingerprint, sha256(encode(fingerprint){_SEPARATED}encode(config){_SEPARATED}encode('sample')) AS cache_key
FROM prints, configs"""))
def score_cache_keys(spark, sf_dir):
    """Identity of a scored text, and its key in the score cache for each topic and the model."""
    rows = V.fingerprints(V.articles(spark, sf_dir).withColumn("published_at", F.date_format("created_at", "yyyy-MM-dd")))
    rows = rows.select("article_id", score.analysis_fingerprint().alias("fingerprint"))
    topics = match.active_topics(V.topics(spark)).select("topic_id", score.topic_config().alias("config")).collect()      # configuration
    keys = F.explode(F.array(*[F.struct(F.lit(t.topic_id).alias("topic_id"), F.lit(t.config).alias("config")) for t in topics]))
    return rows.withColumn("t", keys).select(
        "t.topic_id", "article_id", "fingerprint", score.cache_key(F.col("fingerprint"), F.col("t.config"), F.lit("sample")).alias("cache_key"))


@query("import_hashes", V.sql(V.ARTICLES, V.TITLED, select="""
SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'given-' || article_id ELSE sha256(canonical_url || chr(10) || norm_title) END AS content_hash FROM titled"""))
def import_hashes(spark, sf_dir):
    """The hash that a bundle supplies, else the one that a run would compute; blank ones do not count."""
    n = F.col("article_id")
    supplied = F.when(n % 3 == 0, F.concat(F.lit(" given-"), n.cast("string"), F.lit(" "))).when(n % 3 == 1, "  ")
    return V.fingerprints(V.articles(spark, sf_dir)).select("article_id", merge.import_hash(supplied).alias("content_hash"))


@query("latest_imported_run", V.sql(V.ARTICLES, V.TITLED, _SIDES, """
got AS (SELECT DISTINCT run_id FROM inc i JOIN run_map m USING (run_id) WHERE NOT EXISTS (SELECT 1 FROM loc l WHERE m.state <> 'remapped'
    AND l.run_id = i.run_id AND l.topic_id = i.topic_id AND l.content_hash = i.content_hash))""", select="""
SELECT b AS finished_at, a AS started_at FROM inc_runs SEMI JOIN got USING (run_id) ORDER BY b DESC, a DESC, run_id DESC LIMIT 1"""))
def latest_imported_run(spark, sf_dir):
    """The newest imported run that brought new articles."""
    loc, inc, run_map, mapped = _maps(spark, sf_dir)
    runs = runs_of(inc).withColumn("ordinal", F.col("run_id")).join(run_map.select("run_id", "local_id"), "run_id").drop("run_id").withColumnRenamed(
        "local_id", "run_id")
    newest = merge.latest_imported(runs, merge.merge_articles(mapped, loc))
    return runs.join(newest, "run_id").select("finished_at", "started_at")


@query("source_outcomes", """
SELECT lang AS run_id, count(*) FILTER (ok) AS source_success, count(*) FILTER (NOT ok) AS source_failure, NOT bool_or(ok) AS run_failed
FROM (SELECT lang, source, lang <> 'es' AND sum(n_chars) % 3 > 0 AS ok FROM documents GROUP BY lang, source) GROUP BY lang""")
def source_outcomes(spark, sf_dir):
    """Sources that a run could read; a run without any has failed."""
    docs = V.table(spark, sf_dir, "documents")
    fetched = docs.groupBy(F.col("lang").alias("run_id"), "source").agg(((F.col("run_id") != "es") & (F.sum("n_chars") % 3 > 0)).alias("ok"))
    return funnel.source_outcome(fetched)


@query("dashboard", V.sql(V.TOPICS, V.SOURCES, select="""
SELECT 'enabled_topics' AS metric, count(*) FILTER (enabled) AS value FROM topics WHERE NOT archived UNION ALL
SELECT 'topics', count(*) FROM topics WHERE NOT archived UNION ALL
SELECT 'enabled_sources', count(*) FILTER (enabled) FROM sources WHERE NOT archived"""))
def dashboard(spark, sf_dir):
    return catalog.dashboard(V.topics(spark), V.sources(spark, sf_dir))


@query("stream_counters", """
SELECT source_id, counter, count(*) AS value FROM (SELECT event_type AS source_id,
  unnest(CASE WHEN value >= 20 THEN ['feed_items', 'fresh'] ELSE ['feed_items', 'date_rejected', 'date_stale'] END) AS counter FROM events) GROUP BY ALL""")
def stream_counters(spark, sf_dir):
    """Running item counters of a stream, as they stand when all rows have arrived."""
    items = _events(spark, sf_dir).select(F.col("event_type").alias("source_id"), F.when(F.col("value") < 20, "date_stale").alias("date_reason"))
    return _drain(jobs.counter_stream(items), "complete")


@query("topic_admission", """
WITH asked AS (SELECT o_custkey AS owner, o_orderkey AS topic_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth
  FROM orders WHERE o_orderstatus <> 'F'),
held AS (SELECT o_custkey AS owner, count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT owner, topic_id, nth + coalesce(n, 0) <= 10 AS admitted FROM asked LEFT JOIN held USING (owner)""")
def topic_admission(spark, sf_dir):
    """Requests for new topics, at most ten topics an owner; archived topics do not count."""
    orders = V.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("topic_id"), "o_orderdate", "o_orderstatus", (F.col("o_orderpriority") == "5-LOW").alias("archived"))
    asked = orders.where("o_orderstatus <> 'F'")
    return catalog.admit_topics(asked, orders.where("o_orderstatus = 'F'"), "owner", [F.col("o_orderdate"), F.col("topic_id")]).select("owner", "topic_id", "admitted")


@query("source_audit", """
WITH s AS (SELECT source, count(*) % 7 = 0 AS bad, CASE WHEN CAST(substr(source, 4) AS INTEGER) < 4 THEN 'central_bank'
    WHEN CAST(substr(source, 4) AS INTEGER) < 8 THEN 'banking' WHEN CAST(substr(source, 4) AS INTEGER) < 14 THEN 'general' ELSE 'science' END AS category
  FROM documents GROUP BY source)
SELECT category, count(*) AS checked, count(*) FILTER (bad) AS failed, CASE WHEN bool_or(bad) THEN 1 ELSE 0 END AS exit_status,
  CASE WHEN (SELECT bool_or(bad) FROM s) THEN 1 ELSE 0 END AS whole FROM s GROUP BY category""")
def source_audit(spark, sf_dir):
    """An audit of all sources written as a report, with its exit status and that of each category."""
    checks = V.sources(spark, sf_dir).select("source_id", "category", (F.col("n_docs") % 7 != 0).alias("ok"), F.col("last_status").alias("errors"))
    status = files.write_audit(checks, f"{shared_folder(spark).rstrip('/')}/audit-{uuid.uuid4().hex}")
    return catalog.audit_report(checks, ["category"]).withColumn("whole", F.lit(status))


@query("report_order", V.sql(V.ARTICLES, select="""
SELECT source_id AS run_id, article_id, row_number() OVER (PARTITION BY source_id ORDER BY length(title) % 50 DESC, created_at DESC, CAST(article_id AS VARCHAR)) AS place
FROM articles WHERE created_at IS NOT NULL"""))
def report_order(spark, sf_dir):
    """The places of all articles in the reports of their runs."""
    rows = V.articles(spark, sf_dir).where("created_at IS NOT NULL").select(
        F.col("source_id").alias("run_id"), "article_id", F.col("article_id").cast("string").alias("id"), (F.length("title") % 50).alias("score"), "created_at")
    return rank.distributed_position(rows, ["run_id"], history.report_order(), "place").select("run_id", "article_id", "place")
