"""The merge of another installation's history as one job over a :class:`Store`.

Identity maps are made in the order in which tables depend on each other (sources and topics, runs, articles);
a conflict in any of them ends the job before anything is written.  What changes is written as new
folders and becomes live with one log entry, so a job that dies leaves the old history.  Articles are added to
their days, and only days on which a local article becomes a favourite are written anew.  The same bundle a second
time changes nothing and writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, merge
from ..session import cut
from ..sources.store import Change, Store


@dataclass
class Merged:
    """What a merge did: counts for each table, the log entry (None if nothing changed), and the newest imported run."""

    preview: DataFrame
    entry: int | None
    latest_run: str | None


def keeps_local_report(runs: DataFrame, articles: DataFrame) -> bool:
    """Whether a usable local report exists; imported runs are then history only."""
    return not history.usable_runs(runs, articles).isEmpty()


def _sources(incoming: DataFrame, local: DataFrame, mapping: DataFrame) -> DataFrame:
    merged = merge.merge_sources(incoming, local, mapping)
    rest = [c for c in local.columns if c not in merged.columns]
    new = incoming.join(mapping.where("state = 'new'").select("source_id", "local_id"), "source_id").drop("source_id").withColumnRenamed(
        "local_id", "source_id")
    details = local.select("source_id", *rest).unionByName(new.select("source_id", *rest))
    return merged.join(details, "source_id").select(*local.columns)


def merge_history(store: Store, bundle: dict[str, DataFrame]) -> Merged:
    """Merge ``bundle`` (sources, topics, runs, articles with the store's columns) into the store.

    Sources need canonical_url, runs history_only; a topic is the local one of the same name.
    """
    local = {t: cut(store.read(t)) for t in ("sources", "topics", "runs")}
    stored = store.read("articles").select("id", "run_id", "topic_id", "content_hash", "favorite", "created_at")
    maps = {
        "source": cut(merge.match_sources(bundle["sources"], local["sources"])),
        "topic": cut(merge.match_names(bundle["topics"], local["topics"], "topic_id")),
        "run": cut(merge.match_runs(bundle["runs"].drop("history_only"), local["runs"].drop("history_only"))),
    }
    for name, mapping in maps.items():
        wrong = mapping.where("conflict IS NOT NULL").select(f"{name}_id", "conflict").take(5)
        if wrong:
            raise ValueError(f"{name}s in conflict: {[tuple(r) for r in wrong]}")

    mapped = cut(merge.map_articles(bundle["articles"], maps["run"], maps["topic"], maps["source"]))
    fresh, flips = [cut(x) for x in merge.article_changes(mapped, stored)]
    article_map = mapped.groupBy("run_id", "topic_id", "content_hash").count().join(
        fresh.select("run_id", "topic_id", "content_hash", F.lit("new").alias("state")), ["run_id", "topic_id", "content_hash"], "left"
    ).select(F.coalesce("state", F.lit("matched")).alias("state"), F.lit(None).cast("string").alias("conflict"))
    preview = None
    for name, mapping in (*maps.items(), ("article", article_map)):
        counted = merge.preview(name, mapping)
        preview = counted if preview is None else preview.unionByName(counted)
    preview = cut(preview)

    changes: dict[str, Change | list[Change]] = {}
    new_runs = bundle["runs"].join(maps["run"].where("state <> 'matched'").select("run_id", "local_id"), "run_id").drop("run_id").withColumnRenamed(
        "local_id", "run_id").withColumn("history_only", F.lit(keeps_local_report(local["runs"], stored)))
    runs = local["runs"].unionByName(new_runs.select(*local["runs"].columns))
    latest = None
    if not fresh.isEmpty() or not new_runs.isEmpty():
        after = stored.select("run_id").unionByName(fresh.select("run_id"))
        touched = maps["run"].select(F.col("local_id").alias("run_id")).distinct()
        counted = after.join(touched, "run_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
        recounted = runs.join(touched.withColumn("_touched", F.lit(True)), "run_id", "left").join(counted, "run_id", "left").withColumn(
            "article_count", F.when(F.col("_touched"), F.coalesce("_n", F.lit(0))).otherwise(F.col("article_count")))
        changes["runs"] = Change(recounted.drop("_touched", "_n"), replaces=True)
        latest = merge.latest_imported(runs.join(touched, "run_id", "left_semi"), fresh.withColumn("state", F.lit("new"))).first()[0]
    for name, table, made in (
        ("topic", "topics", lambda m: local["topics"].unionByName(bundle["topics"].join(
            m.where("state = 'new'").select("topic_id", "local_id"), "topic_id").drop("topic_id").withColumnRenamed("local_id", "topic_id").select(
                *local["topics"].columns))),
        ("source", "sources", lambda m: _sources(bundle["sources"], local["sources"], m)),
    ):
        rows = cut(made(maps[name]))
        if not rows.exceptAll(local[table]).isEmpty():
            changes[table] = Change(rows, replaces=True)
    articles = []
    if not fresh.isEmpty():
        articles.append(Change(fresh))
    days = store.days_of("articles", flips)
    if days:
        marked = store.read("articles", days=days).join(flips.select("id", F.lit(True).alias("_flipped")), "id", "left").withColumn(
            "favorite", F.col("favorite") | F.coalesce("_flipped", F.lit(False))).drop("_flipped")
        articles.append(Change(marked, replaces=True, days=days))
    if articles:
        changes["articles"] = articles
    return Merged(preview, store.commit(changes) if changes else None, latest)
