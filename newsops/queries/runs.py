"""Runs, reports, stored history, search and retention."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import funnel, history, score
from ..session import shared_folder
from ..sources import store
from . import views as V
from .registry import query


# Runs: one per order.  The customer owns the run, its lines are the stored articles.
def runs(spark, sf_dir):
    started = F.col("o_orderdate").cast("timestamp")
    open_run = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return V.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.col("o_custkey").alias("owner"),
        F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "degraded")
        .when(open_run, "running").otherwise("failed").alias("status"),
        F.when(open_run, "fetching").otherwise("finished").alias("phase"),
        F.when(F.col("o_orderstatus") == "F", "complete").alias("outcome"),
        started.alias("started_at"),
        F.when(~open_run & (F.col("o_orderpriority") != "5-LOW"),
               F.timestamp_seconds(F.unix_seconds(started) + F.floor("o_totalprice"))).alias("finished_at"),
        F.col("o_orderkey").alias("ordinal"),
        (F.col("o_orderpriority") == "4-NOT SPECIFIED").alias("history_only"),
        F.col("o_totalprice").alias("size"),
    )


def run_articles(spark, sf_dir):
    return V.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("run_id"), "l_linenumber", "l_returnflag", "l_quantity"
    )


RUNS = """
runs AS (
  SELECT 'r' || o_orderkey AS run_id, o_custkey AS owner,
    CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'degraded'
      WHEN o_orderpriority = '1-URGENT' THEN 'running' ELSE 'failed' END AS status,
    CAST(o_orderdate AS TIMESTAMP) AS started_at,
    CASE WHEN NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AND o_orderpriority <> '5-LOW'
      THEN CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) END AS finished_at,
    o_orderkey AS ordinal, o_orderpriority = '4-NOT SPECIFIED' AS history_only, o_totalprice AS size
  FROM orders),
lines AS (SELECT 'r' || l_orderkey AS run_id, l_returnflag, l_quantity FROM lineitem),
usable AS (SELECT * FROM runs WHERE status IN ('complete', 'degraded') AND NOT history_only
  AND run_id IN (SELECT run_id FROM lines)),
checks AS (SELECT owner, run_id AS checkpoint FROM (SELECT *, row_number() OVER (PARTITION BY owner
    ORDER BY coalesce(finished_at, started_at) DESC, started_at DESC, ordinal DESC) AS rn
  FROM runs WHERE status = 'complete' AND run_id IN (SELECT run_id FROM lines)) WHERE rn = 1),
current_runs AS (SELECT owner, run_id FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY started_at DESC, ordinal DESC) AS rn
  FROM runs WHERE NOT history_only) WHERE rn = 1)"""


@query("latest_run", V.sql(RUNS, select="""
SELECT owner, run_id FROM (SELECT *, row_number() OVER (PARTITION BY owner
  ORDER BY coalesce(finished_at, started_at) DESC, started_at DESC, ordinal DESC) AS rn FROM usable) WHERE rn = 1"""))
def latest_run(spark, sf_dir):
    return history.latest_usable(runs(spark, sf_dir), run_articles(spark, sf_dir), ["owner"])


@query("current_run", V.sql(RUNS, select="SELECT * FROM current_runs"))
def current_run(spark, sf_dir):
    return history.current_run(runs(spark, sf_dir), ["owner"])


@query("checkpoint_run", V.sql(RUNS, select="SELECT owner, checkpoint AS run_id FROM checks"))
def checkpoint_run(spark, sf_dir):
    return history.checkpoint_run(runs(spark, sf_dir), run_articles(spark, sf_dir), ["owner"])


@query("latest_report", V.sql(RUNS, """
proven AS (SELECT DISTINCT run_id FROM lines WHERE l_returnflag = 'R' AND l_quantity > 25),
marked AS (SELECT u.*, p.run_id IS NOT NULL AS committed, c.checkpoint, row_number() OVER (PARTITION BY u.owner
    ORDER BY coalesce(finished_at, started_at) DESC, started_at DESC, ordinal DESC) AS pos
  FROM usable u LEFT JOIN proven p USING (run_id) LEFT JOIN checks c USING (owner)),
stops AS (SELECT owner, min(pos) FILTER (committed OR run_id = checkpoint) AS stop FROM marked GROUP BY owner),
shown AS (
  SELECT m.owner, coalesce(max(m.run_id) FILTER (m.pos = s.stop), any_value(m.checkpoint), max(m.run_id) FILTER (m.pos = 1)) AS run_id,
    coalesce(bool_or(m.committed) FILTER (m.pos = s.stop), FALSE) AS committed, any_value(m.checkpoint) AS checkpoint
  FROM marked m JOIN stops s USING (owner) GROUP BY m.owner)""", select="""
SELECT s.owner, s.run_id, CASE WHEN s.checkpoint IS NULL AND NOT s.committed THEN 'degraded' ELSE r.status END AS status,
  s.committed, s.run_id <> c.run_id AS is_retained
FROM shown s JOIN runs r USING (run_id) LEFT JOIN current_runs c ON c.owner = s.owner"""))
def latest_report(spark, sf_dir):
    lines = run_articles(spark, sf_dir)
    artifacts = lines.where("l_returnflag = 'R' AND l_quantity > 25").select("run_id", F.lit("complete").alias("status")).distinct()
    return history.latest_report(runs(spark, sf_dir), lines, artifacts, ["owner"])


@query("sweep_interrupted", V.sql(RUNS, select=f"""
SELECT CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status,
  CASE WHEN status = 'running' THEN 'interrupted' WHEN status = 'complete' THEN 'complete' END AS outcome,
  count(*) AS runs, count(CASE WHEN status = 'running' THEN TIMESTAMP '{V.AS_OF}' ELSE finished_at END) AS finished
FROM runs GROUP BY 1, 2"""))
def sweep_interrupted(spark, sf_dir):
    swept = history.sweep_interrupted(runs(spark, sf_dir), V.as_of())
    return swept.groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("runs"), F.count("finished_at").alias("finished"))


@query("run_export", V.sql(RUNS, select="""
SELECT run_id, owner, status, coalesce(finished_at, started_at) AS shown_at, ordinal FROM runs"""))
def run_export(spark, sf_dir):
    return history.export_runs(runs(spark, sf_dir)).select(
        "run_id", "owner", "status", history.display_time("finished_at", "started_at").alias("shown_at"), "ordinal"
    )


@query("runs_without_articles", V.sql(RUNS, select="""
SELECT status, history_only, count(*) AS runs, count(*) FILTER (run_id NOT IN (SELECT run_id FROM lines)) AS empty
FROM runs GROUP BY ALL"""))
def runs_without_articles(spark, sf_dir):
    df, ids = runs(spark, sf_dir), run_articles(spark, sf_dir).select("run_id").distinct()
    empty = df.join(ids, "run_id", "left_anti").groupBy("status", "history_only").agg(F.count(F.lit(1)).alias("empty"))
    every = df.groupBy("status", "history_only").agg(F.count(F.lit(1)).alias("runs"))
    return every.join(empty, ["status", "history_only"], "left").select(
        "status", "history_only", "runs", F.coalesce("empty", F.lit(0)).alias("empty")
    )


@query("run_counters", r"""
SELECT event_id, coalesce(k, v) AS selected, CASE WHEN event_type = 'click' THEN k WHEN event_type = 'error' THEN coalesce(k, 0) + coalesce(v, 0) END AS duplicates
FROM (SELECT event_id, event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, round(value) AS v FROM events)""")
def run_counters(spark, sf_dir):
    """Numbers read from loosely typed counter maps under alternative names."""
    df = V.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    v = F.round("value").cast("string")
    record = F.create_map(
        F.lit("kept"), k, F.lit("stored_count"), v,
        F.lit("duplicate_count"), F.when(F.col("event_type") == "click", k),
        F.lit("history_duplicates"), F.when(F.col("event_type") == "error", k),
        F.lit("run_duplicates"), F.when(F.col("event_type") == "error", v),
    )
    return df.select("event_id", record.alias("r")).select(
        "event_id", funnel.first_numeric(F.col("r"), "selected", "kept", "stored_count").alias("selected"),
        funnel.duplicate_total(F.col("r")).alias("duplicates"),
    )


# Stored history: every document once, topic by language, run by source and day.
_TOPIC_OF = {"en": "t1", "de": "t2", "fr": "t3", "es": "t4"}


def stored(spark, sf_dir):
    df = V.articles(spark, sf_dir)
    topic_id = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in _TOPIC_OF.items()], F.lit("t1"))
    labels = V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id"), (F.col("quality") == 1).alias("favorite"))
    return df.join(labels, "article_id", "left").select(
        F.col("article_id").alias("id"), F.concat_ws("-", "source_id", F.date_format("created_at", "yyyyMMdd")).alias("run_id"),
        topic_id.alias("topic_id"), "source_id", "source_name", "title", "url", "excerpt", "full_text", F.lit("").alias("analysis"),
        F.split_part("full_text", F.lit("\n"), F.lit(3)).alias("summary"), (F.length("full_text") % 101).alias("score"),
        "created_at", F.coalesce("favorite", F.lit(False)).alias("favorite"),
    )


STORED = """
stored AS (
  SELECT article_id AS id, source_id || '-' || strftime(created_at, '%Y%m%d') AS run_id,
    CASE lang WHEN 'en' THEN 't1' WHEN 'de' THEN 't2' WHEN 'fr' THEN 't3' WHEN 'es' THEN 't4' ELSE 't1' END AS topic_id,
    source_id, source_name, title, url, excerpt, full_text, '' AS analysis, split_part(full_text, chr(10), 3) AS summary,
    length(full_text) % 101 AS score, created_at, coalesce(l.quality = 1, FALSE) AS favorite
  FROM articles a LEFT JOIN labels l ON l.doc_id = a.article_id)"""
_FIND = "(lower(title) LIKE '%the%and%' OR lower(excerpt) LIKE '%the%and%' OR lower(summary) LIKE '%the%and%' OR analysis LIKE '%the%and%')"


def _dims(spark, sf_dir):
    return V.topics(spark), V.sources(spark, sf_dir)


@query("history_search", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, STORED, select=f"""
SELECT a.id, a.title, t.name AS topic_name, s.name AS source_name, a.score FROM stored a JOIN topics t USING (topic_id)
JOIN sources s USING (source_id) WHERE {_FIND} ORDER BY a.created_at DESC, a.score DESC, a.id LIMIT 200"""))
def history_search(spark, sf_dir):
    found = history.search(stored(spark, sf_dir), *_dims(spark, sf_dir), query=" The%AND ", limit=500)
    return found.select("id", "title", "topic_name", "source_name", "score")


@query("history_count", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, STORED, select=f"""
SELECT count(*) AS total FROM stored a JOIN topics t USING (topic_id) JOIN sources s USING (source_id) WHERE {_FIND}"""))
def history_count(spark, sf_dir):
    return history.count_found(stored(spark, sf_dir), *_dims(spark, sf_dir), query="the%and")


@query("history_page", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, STORED, select="""
SELECT a.id, a.score, a.favorite FROM stored a JOIN topics t USING (topic_id) JOIN sources s USING (source_id)
WHERE topic_id = 't1' AND favorite ORDER BY a.created_at DESC, a.score DESC, a.id LIMIT 20 OFFSET 40"""))
def history_page(spark, sf_dir):
    page = history.search(stored(spark, sf_dir), *_dims(spark, sf_dir), topic_id="t1", favorite=True, limit=20, offset=40)
    return page.select("id", "score", "favorite")


@query("report_view", V.sql(V.ARTICLES, STORED, select="""
SELECT run_id, count(*) AS favorites, max(score) AS best FROM stored WHERE topic_id = 't2' AND favorite GROUP BY run_id"""))
def report_view(spark, sf_dir):
    return history.report_view(stored(spark, sf_dir), "t2", favorites_only=True).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("favorites"), F.max("score").alias("best")
    )


@query("history_export", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, STORED, select="""
SELECT a.id, a.created_at, a.url, t.name AS topic_name, s.name AS source_name
FROM stored a JOIN topics t USING (topic_id) JOIN sources s USING (source_id)"""))
def history_export(spark, sf_dir):
    return history.export_articles(stored(spark, sf_dir), *_dims(spark, sf_dir)).select(
        "id", "created_at", "url", "topic_name", "source_name"
    )


@query("retention_blank", V.sql(V.ARTICLES, STORED, select=f"""
SELECT source_id, count(*) FILTER (created_at < TIMESTAMP '{V.AS_OF}' - INTERVAL 14 DAY) AS blanked,
  sum(CASE WHEN created_at < TIMESTAMP '{V.AS_OF}' - INTERVAL 14 DAY THEN 0 ELSE length(full_text) END) AS kept_chars
FROM stored GROUP BY source_id"""))
def retention_blank(spark, sf_dir):
    kept = history.blank_expired_text(stored(spark, sf_dir), V.as_of(), 14)
    return kept.groupBy("source_id").agg(
        F.count_if(F.col("full_text") == "").alias("blanked"), F.sum(F.length("full_text")).alias("kept_chars")
    )


@query("insert_new_articles", V.sql(V.ARTICLES, V.TITLED, select="""
SELECT article_id FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, canonical_url, norm_title ORDER BY created_at, article_id) AS rn
  FROM titled n WHERE lang <> 'en' AND NOT EXISTS (SELECT 1 FROM titled e WHERE e.lang = 'en' AND e.source_id = n.source_id
    AND e.canonical_url = n.canonical_url AND e.norm_title = n.norm_title)) WHERE rn = 1"""))
def insert_new_articles(spark, sf_dir):
    """Append with keep-existing on the key (run, topic, content hash)."""
    df = V.fingerprints(V.articles(spark, sf_dir).drop("full_text", "excerpt")).select(
        "article_id", "lang", F.col("source_id").alias("run_id"), F.lit("t").alias("topic_id"),
        score.content_hash().alias("content_hash"), "created_at",
    )
    return history.insert_new(df.where("lang = 'en'"), df.where("lang <> 'en'"), [F.col("created_at"), F.col("article_id")]).select(
        "article_id"
    )


@query("threshold_snapshots", V.sql(V.ARTICLES, V.TOPICS, STORED, """
snap AS (
  SELECT run_id, CASE WHEN length(run_id) % 2 = 0 THEN 'x-' || topic_id ELSE topic_id END AS topic_id, upper(name) AS name,
    50 + count(*) % 40 AS core, 40 AS supp FROM stored JOIN topics USING (topic_id) GROUP BY ALL)""", select="""
SELECT tier, count(*) AS articles FROM (
  SELECT CASE WHEN coalesce(a.core, b.core) IS NULL OR s.score >= coalesce(a.core, b.core) THEN 'core' ELSE 'supplement' END AS tier
  FROM stored s JOIN topics t USING (topic_id) LEFT JOIN snap a ON a.run_id = s.run_id AND a.topic_id = s.topic_id
  LEFT JOIN snap b ON b.run_id = s.run_id AND lower(b.name) = lower(t.name)) GROUP BY tier"""))
def threshold_snapshots(spark, sf_dir):
    topics = V.topics(spark).select("topic_id", F.col("name").alias("topic_name"))
    df = stored(spark, sf_dir).drop("full_text", "excerpt").join(topics, "topic_id")
    snaps = df.groupBy("run_id", "topic_id", "topic_name").agg(F.count(F.lit(1)).alias("n")).select(
        "run_id", F.when(F.length("run_id") % 2 == 0, F.concat(F.lit("x-"), "topic_id")).otherwise(F.col("topic_id")).alias("topic_id"),
        F.upper("topic_name").alias("name"), (50 + F.col("n") % 40).alias("core_threshold"), F.lit(40).alias("supplement_threshold"),
    )
    tiered = history.with_threshold_snapshot(df, snaps)
    tier = score.selection_tier(F.col("score"), F.col("snapshot.core_threshold"), F.col("snapshot.supplement_threshold"))
    return tiered.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("articles"))


@query("source_error_names", V.sql(RUNS, select="""
SELECT r.run_id, r.owner AS source_id, 'HTTP ' || r.ordinal AS error, nullif(trim(c.c_name), '') AS source_name
FROM runs r LEFT JOIN customer c ON c.c_custkey = r.owner AND c.c_acctbal > 0 WHERE r.status = 'failed'"""))
def source_error_names(spark, sf_dir):
    df = runs(spark, sf_dir)
    errors = df.select(
        "run_id", F.col("owner").alias("source_id"), F.when(F.col("status") == "failed", F.concat(F.lit("HTTP "), F.col("ordinal").cast("string"))).alias("error")
    )
    names = V.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("name"))
    snapshots = df.select("run_id", "owner").join(names, "owner").select("run_id", F.col("owner").alias("source_id"), "name")
    return history.source_error_names(errors, snapshots)


@query("unified_search", V.sql(V.ARTICLES, V.TOPICS, V.SOURCES, STORED, """
everything AS (
  SELECT 1 AS group_no, 'topic' AS kind, name AS title, array_to_string(keywords, ' · ') AS subtitle, topic_id AS key FROM topics
  UNION ALL SELECT 2, 'source', name, url, source_id FROM sources
  UNION ALL SELECT 3, 'article', title, source_name, CAST(id AS VARCHAR) FROM stored)""", select="""
SELECT kind, title, key FROM everything WHERE contains(lower(title || ' ' || subtitle || ' ' || kind), 'src1')
ORDER BY group_no, key LIMIT 30"""))
def unified_search(spark, sf_dir):
    return history.unified_search(*_dims(spark, sf_dir), stored(spark, sf_dir), " SRC1 ").select("kind", "title", "key")


@query("catalog_facets", V.sql(V.SOURCES, select="""
SELECT count(*) FILTER (category IN ('central_bank', 'bank_regulation', 'banking', 'fintech') AND contains(lower(name || ' ' || url), 'src')) AS shown,
  count(*) AS total, count(*) FILTER (enabled) AS enabled, count(DISTINCT category) AS categories,
  count(*) FILTER (last_status = 'ok') AS ok, count(*) FILTER (last_status = 'error') AS failing,
  count(*) FILTER (last_status IS NULL) AS unchecked FROM sources"""))
def catalog_facets(spark, sf_dir):
    from ..operators import catalog

    return catalog.facets(V.sources(spark, sf_dir), category="banking_all", text="SRC")


@query("catalog_sync", V.sql(V.SOURCES, """
presets AS (SELECT 'preset-' || source AS id, 'Preset ' || source AS name,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) >= 15 THEN 'https://' || source || '.example.com/feed' ELSE 'https://new.example.com/' || source END AS url,
    min(lang) AS language, count(*) AS n FROM documents GROUP BY source
  UNION ALL SELECT 'preset-new-' || lang, 'New ' || lang, 'https://new.example.com/' || lang, lang, count(*) FROM documents GROUP BY lang)""", select="""
SELECT coalesce(s.source_id, p.id) AS source_id, CASE WHEN s.source_id IS NULL THEN 'inserted' WHEN s.user_modified THEN 'kept' ELSE 'updated' END AS action,
  CASE WHEN s.source_id IS NOT NULL AND s.user_modified THEN s.name ELSE p.name END AS name, coalesce(s.preset_id, p.id) AS preset_id
FROM presets p LEFT JOIN sources s ON s.preset_id = p.id OR (s.preset_id IS NULL AND s.url = p.url)"""))
def catalog_sync(spark, sf_dir):
    from ..operators import catalog

    docs = V.table(spark, sf_dir, "documents")
    number = F.substring("source", 4, 10).cast("int")
    by_source = docs.groupBy("source").agg(F.min("lang").alias("language")).select(
        F.concat(F.lit("preset-"), "source").alias("id"), F.concat(F.lit("Preset "), "source").alias("name"),
        F.when(number >= 15, F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")))
        .otherwise(F.concat(F.lit("https://new.example.com/"), "source")).alias("url"), "language",
    )
    by_lang = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("preset-new-"), "lang").alias("id"), F.concat(F.lit("New "), "lang").alias("name"),
        F.concat(F.lit("https://new.example.com/"), "lang").alias("url"), F.col("lang").alias("language"),
    )
    synced = catalog.sync_presets(V.sources(spark, sf_dir), by_source.unionByName(by_lang), version=3)
    return synced.where("action <> 'untouched'").select("source_id", "action", "name", "preset_id")


# -- the stored history: two inserts that overlap, then retention ---------------------------------
@query("history_store", V.sql(V.ARTICLES, f"""
keyed AS (SELECT source_id || '-' || strftime(created_at, '%Y%m%d') AS run_id, lang, coalesce(full_text, '') AS t, CAST(created_at AS DATE) AS day,
  bool_or(article_id % 3 <> 0 AND created_at < TIMESTAMP '{V.AS_OF}' - INTERVAL 3 DAY) AS early, bool_or(created_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 10 DAY) AS late
  FROM articles WHERE created_at IS NOT NULL GROUP BY ALL),
kept AS (SELECT *, day < CAST(TIMESTAMP '{V.AS_OF}' - INTERVAL 14 DAY AS DATE) AS old FROM keyed WHERE early OR late)""", select=f"""
SELECT day, count(*) AS rows, count(*) FILTER (NOT old AND t <> '') AS texts,
  CASE WHEN day <= CAST(TIMESTAMP '{V.AS_OF}' - INTERVAL 14 DAY AS DATE) AND bool_or(t <> '') THEN 1
    ELSE bool_or(early)::BIGINT + bool_or(late AND NOT early)::BIGINT END AS folders FROM kept GROUP BY day"""))
def history_store(spark, sf_dir):
    """Rows, texts and live folders of each day: what is stored stays, old days alone are written again."""
    rows = V.articles(spark, sf_dir).where("created_at IS NOT NULL").select(
        F.col("article_id").cast("string").alias("id"), F.concat_ws("-", "source_id", F.date_format("created_at", "yyyyMMdd")).alias("run_id"),
        F.col("lang").alias("topic_id"), F.sha2(F.coalesce("full_text", F.lit("")), 256).alias("content_hash"), "full_text", "created_at")
    table = _new_store(spark, {"articles": "id string, run_id string, topic_id string, content_hash string, full_text string, created_at timestamp"})
    order = [F.col("id").cast("bigint")]
    ago = lambda days: V.as_of() - F.make_interval(days=F.lit(days))
    store.insert_articles(table, rows.where((F.col("id").cast("bigint") % 3 != 0) & (F.col("created_at") < ago(3))), order)
    store.insert_articles(table, rows.where(F.col("created_at") >= ago(10)), order)
    store.blank_texts(table, dt.datetime.fromisoformat(V.AS_OF), 14)
    folders = table.log().join(spark.createDataFrame([(r.day, r.version) for r in table.live("articles")], "day date, version string"), ["day", "version"])
    return table.read("articles").groupBy(F.to_date("created_at").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("full_text") != "").alias("texts")
    ).join(folders.groupBy("day").agg(F.count(F.lit(1)).alias("folders")), "day")


def _new_store(spark, schemas):
    root = f"{shared_folder(spark).rstrip('/')}/newsops-store-{uuid.uuid4().hex}"
    return store.Store(spark, root, schemas, {"articles": "created_at"})


@query("stream_committed_runs", """
SELECT event_type AS source_id, count(*) FILTER (value >= 20) AS articles, count(*) FILTER (value < 20) AS rejected FROM events GROUP BY 1""")
def stream_committed_runs(spark, sf_dir):
    """A stream whose batches become runs of a store, each with one log entry; counts per source as readers see them."""
    from ..streaming import jobs

    table = _new_store(spark, {
        "articles": "article_id bigint, run_id string, source_id string, created_at timestamp",
        "errors": "run_id string, source_id string, error string, rows bigint",
        "runs": "run_id string, status string, started_at timestamp, finished_at timestamp, article_count bigint"})
    events = spark.readStream.schema(V.table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(
        F.col("event_id").alias("article_id"), F.col("event_type").alias("source_id"), F.when(F.col("value") < 20, "date_stale").alias("date_reason"))
    checkpoint = f"{table.root}-checkpoint"
    jobs.publish_batches(rows, table, checkpoint, V.as_of()).awaitTermination()
    jobs.publish_batches(rows, table, checkpoint, V.as_of()).awaitTermination()             # nothing new: no run is added
    ended = table.read("runs").where("status = 'complete'")
    good = table.read("articles").join(ended.select("run_id"), "run_id", "left_semi").groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
    bad = table.read("errors").groupBy("source_id").agg(F.sum("rows").alias("rejected"))
    return good.join(bad, "source_id", "full_outer").select(
        "source_id", F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("rejected", F.lit(0)).alias("rejected"))
