"""Queries over the accumulated history and its runs: search, reports, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import top_per_group

# Memory, retention and page sizes.
HISTORY_DAYS, FULL_TEXT_DAYS = 7, 30
PAGE_MIN, PAGE_MAX = 1, 200
USABLE = ("complete", "degraded")


# -- stored articles -----------------------------------------------------------
def recent_fingerprints(articles: DataFrame, runs: DataFrame, as_of: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """Rows stored in the last ``days`` days by runs that ended complete or degraded."""
    usable = runs.where(F.col("status").isin(*USABLE)).select("run_id")
    recent = articles.where(F.col("created_at") >= as_of - F.make_interval(days=F.lit(days)))
    return recent.join(usable, "run_id", "left_semi")


def insert_new(existing: DataFrame, rows: DataFrame, order: list[Column]) -> DataFrame:
    """Rows to append: one per (run, topic, content hash), and only keys not stored yet."""
    key = ["run_id", "topic_id", "content_hash"]
    return top_per_group(rows, key, order, 1, "_rn").drop("_rn").join(existing.select(*key), key, "left_anti")


def with_names(articles: DataFrame, topics: DataFrame, sources: DataFrame) -> DataFrame:
    """Inner joins to the topic and source names."""
    bare = articles.drop("topic_name", "source_name")
    return bare.join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id").join(
        sources.select("source_id", F.col("name").alias("source_name")), "source_id"
    )


def _like(query: str) -> str:
    # % and _ act as wildcards, as they do in the search box; only \\ is literal
    return f"%{query.strip()}%".replace("\\", "\\\\")


def search_filter(query: str = "", topic_id: str | None = None, favorite: bool | None = None) -> Column:
    """Substring in title, excerpt, summary or analysis, plus the optional exact filters.

    Case is ignored for ASCII letters only.
    """
    condition = F.lit(True)
    if query.strip():
        ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        pattern = _like(query.translate(ascii_lower))
        any_field = F.lit(False)
        for field in ("title", "excerpt", "summary", "analysis"):
            low = F.translate(field, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            any_field = any_field | low.like(pattern)
        condition = condition & any_field
    if topic_id:
        condition = condition & (F.col("topic_id") == topic_id)
    if favorite is not None:
        condition = condition & (F.col("favorite") == favorite)
    return condition


def search(articles, topics, sources, query="", topic_id=None, favorite=None, limit=50, offset=0) -> DataFrame:
    """One page of the history, newest first; ``id`` breaks ties."""
    found = with_names(articles.where(search_filter(query, topic_id, favorite)), topics, sources)
    size = max(PAGE_MIN, min(limit, PAGE_MAX))
    return found.orderBy(F.desc("created_at"), F.desc("score"), "id").offset(max(0, offset)).limit(size)


def search_after(articles, topics, sources, last: tuple | None, query="", topic_id=None, favorite=None, limit=50) -> DataFrame:
    """Next page after the row ``last`` = (created_at, score, id): cost does not grow with depth."""
    found = articles.where(search_filter(query, topic_id, favorite))
    if last is not None:
        created, score, row_id = (F.lit(v) for v in last)
        found = found.where(
            (F.col("created_at") < created)
            | ((F.col("created_at") == created) & (F.col("score") < score))
            | ((F.col("created_at") == created) & (F.col("score") == score) & (F.col("id") > row_id))
        )
    size = max(PAGE_MIN, min(limit, PAGE_MAX))
    return with_names(found, topics, sources).orderBy(F.desc("created_at"), F.desc("score"), "id").limit(size)


def count_found(articles, topics, sources, query="", topic_id=None, favorite=None) -> DataFrame:
    found = with_names(articles.where(search_filter(query, topic_id, favorite)), topics, sources)
    return found.agg(F.count(F.lit(1)).alias("total"))


def report_view(articles: DataFrame, topic_id: str | None = None, favorites_only: bool = False) -> DataFrame:
    """The rows of a report a reader sees: one topic, or favourites only."""
    return articles.where(search_filter("", topic_id, True if favorites_only else None))


def report_order() -> list[Column]:
    """The order of a report's articles: best score, then newest; the id decides where both are equal."""
    return [F.desc("score"), F.desc("created_at"), F.col("id")]


def export_articles(articles, topics, sources) -> DataFrame:
    """Everything retained, oldest first, without the cached full texts."""
    return with_names(articles, topics, sources).drop("full_text").orderBy("created_at", "id")


def blank_expired_text(articles: DataFrame, as_of: Column, days: int = FULL_TEXT_DAYS) -> DataFrame:
    """Full texts older than the retention period become empty."""
    old = (F.col("created_at") < as_of - F.make_interval(days=F.lit(days))) & (F.col("full_text") != "")
    return articles.withColumn("full_text", F.when(old, F.lit("")).otherwise(F.col("full_text")))


def live_cache(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("expires_at") > as_of)


def unified_search(topics, sources, articles, query: str) -> DataFrame:
    """Topics, sources and articles in one list; 8 rows without a query, 30 with one."""
    def rows(df, rank_no, kind, title, subtitle, key):
        return df.select(
            F.lit(rank_no).alias("group_no"), F.lit(kind).alias("kind"), title.alias("title"), subtitle.alias("subtitle"),
            key.cast("string").alias("key"),
        )

    text = query.strip()
    wanted = F.contains(F.lower(F.concat_ws(" ", "title", "subtitle", "kind")), F.lower(F.lit(text))) if text else F.lit(True)
    key = F.coalesce(F.col("id").cast("string"), F.col("url"))
    # narrow and filtered first, so that repeats are folded over few short rows
    found = rows(articles, 3, "article", F.col("title"), F.coalesce("source_name", "excerpt"), key).where(wanted).dropDuplicates(["key"])
    every = (
        rows(topics, 1, "topic", F.col("name"), F.array_join("keywords", " · "), F.col("topic_id"))
        .unionByName(rows(sources, 2, "source", F.col("name"), F.col("url"), F.col("source_id"))).where(wanted)
        .unionByName(found)
    )
    return every.orderBy("group_no", "key").limit(30 if text else 8)


# -- runs -------------------------------------------------------------------------
def usable_runs(runs: DataFrame, articles: DataFrame) -> DataFrame:
    """Runs a report can show: ended well, have articles, not imported as history only."""
    ended = runs.where(F.col("status").isin(*USABLE) & ~F.coalesce("history_only", F.lit(False)))
    return ended.join(articles.select("run_id"), "run_id", "left_semi")


def _recency() -> Column:
    return F.struct(F.coalesce("finished_at", "started_at"), "started_at", "ordinal")


def latest_usable(runs: DataFrame, articles: DataFrame, by: list[str]) -> DataFrame:
    """Newest usable run per owner, from one aggregation with map-side combine."""
    return usable_runs(runs, articles).groupBy(*by).agg(F.max_by("run_id", _recency()).alias("run_id"))


def current_run(runs: DataFrame, by: list[str]) -> DataFrame:
    """Most recently started run that was not imported as history only."""
    shown = runs.where(~F.coalesce("history_only", F.lit(False)))
    return shown.groupBy(*by).agg(F.max_by("run_id", F.struct("started_at", "ordinal")).alias("run_id"))


def checkpoint_run(runs: DataFrame, articles: DataFrame, by: list[str]) -> DataFrame:
    """Newest complete run with articles."""
    done = runs.where("status = 'complete'").join(articles.select("run_id"), "run_id", "left_semi")
    return done.groupBy(*by).agg(F.max_by("run_id", _recency()).alias("run_id"))


def latest_report(runs: DataFrame, articles: DataFrame, artifacts: DataFrame, by: list[str]) -> DataFrame:
    """The run whose report is shown, and whether a newer run exists.

    Going back from the newest usable run, the first one with a committed artifact is shown;
    the walk stops at the newest complete run, which can be rebuilt from its rows.  Without
    either, the newest usable run is shown as degraded.
    ``artifacts``: run_id, status (status as written in the artifact).
    """
    usable = usable_runs(runs, articles).withColumn("_at", _recency())
    proven = artifacts.where(F.col("status").isin(*USABLE)).select("run_id", F.lit(True).alias("committed"))
    marked = usable.join(proven, "run_id", "left").withColumn("committed", F.coalesce("committed", F.lit(False)))
    check = checkpoint_run(runs, articles, by).withColumnRenamed("run_id", "checkpoint")
    known = marked.join(check, by, "left").withColumn(
        "stop", F.col("committed") | F.col("run_id").eqNullSafe(F.col("checkpoint"))
    )
    picked = known.groupBy(*by).agg(
        F.max_by("run_id", F.when(F.col("stop"), F.col("_at"))).alias("_stop"),
        F.max_by("committed", F.when(F.col("stop"), F.col("_at"))).alias("_stop_committed"),
        F.max_by("run_id", "_at").alias("_newest"), F.first("checkpoint").alias("checkpoint"),
    )
    shown = picked.select(
        *by, F.coalesce("_stop", "checkpoint", "_newest").alias("run_id"),
        F.coalesce(F.when(F.col("_stop").isNotNull(), F.col("_stop_committed")), F.lit(False)).alias("committed"), "checkpoint",
    )
    current = current_run(runs, by).withColumnRenamed("run_id", "current_run")
    status = runs.select("run_id", F.col("status").alias("run_status"))
    return shown.join(current, by, "left").join(status, "run_id").select(
        *by, "run_id",
        F.when(F.col("checkpoint").isNull() & ~F.col("committed"), "degraded").otherwise(F.col("run_status")).alias("status"),
        "committed", (F.col("run_id") != F.col("current_run")).alias("is_retained"),
    )


def sweep_interrupted(runs: DataFrame, as_of: Column) -> DataFrame:
    """Queued or running rows of an earlier process become failed and interrupted."""
    stuck = F.col("status").isin("queued", "running")
    return runs.withColumns({
        "outcome": F.when(stuck, "interrupted").otherwise(F.col("outcome")),
        "phase": F.when(stuck, "finished").otherwise(F.col("phase")),
        "finished_at": F.when(stuck, as_of).otherwise(F.col("finished_at")),
        "status": F.when(stuck, "failed").otherwise(F.col("status")),
    })


def export_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy("started_at", "ordinal")


def display_time(*columns: str) -> Column:
    """First known of finished, completed, started and created."""
    return F.coalesce(*[F.col(c) for c in columns])


def with_threshold_snapshot(articles: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Thresholds a run froze: by topic id, else by a topic name that is unique in the run.

    ``snapshots``: run_id, topic_id, name, core_threshold, supplement_threshold.
    """
    by_id = snapshots.select("run_id", "topic_id", F.struct("core_threshold", "supplement_threshold").alias("_by_id"))
    by_name = (
        snapshots.withColumn("_name", F.lower(F.trim("name"))).groupBy("run_id", "_name")
        .agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("core_threshold", "supplement_threshold")).alias("_by_name"))
        .where("_n = 1").drop("_n")
    )
    joined = articles.withColumn("_name", F.lower(F.trim("topic_name"))).join(by_id, ["run_id", "topic_id"], "left").join(
        by_name, ["run_id", "_name"], "left"
    )
    return joined.withColumn("snapshot", F.coalesce("_by_id", "_by_name")).drop("_by_id", "_by_name", "_name")


def source_error_names(errors: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Name the sources of a run's errors from the labels the run froze."""
    names = snapshots.select("run_id", "source_id", F.substring(F.trim("name"), 1, 200).alias("source_name"))
    return errors.where("error IS NOT NULL AND error <> ''").withColumn("error", F.substring("error", 1, 500)).join(
        names.where("source_name <> ''"), ["run_id", "source_id"], "left"
    )


def source_health(last_status) -> Column:
    return F.when(last_status == "ok", "ok").when(last_status == "error", "error").otherwise("unchecked")
