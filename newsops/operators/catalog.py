"""Source catalogue: filters, facet counts and synchronisation with a preset list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import source_health
from .rank import top_per_group

# Topics that may exist at a time, and the categories behind the group filter.
MAX_TOPICS = 10
CATEGORY_GROUPS = {"banking_all": ("central_bank", "bank_regulation", "banking", "fintech")}


def catalog_filter(category: str | None = None, text: str = "") -> Column:
    """One category or a category group, and a substring of name, URL, category or language."""
    condition = F.lit(True)
    if category:
        condition = F.coalesce("category", F.lit("general")).isin(*CATEGORY_GROUPS.get(category, (category,)))
    if text.strip():
        shown = F.concat_ws(" ", "name", "url", "category", "language")
        condition = condition & F.contains(F.lower(shown), F.lower(F.lit(text.strip())))
    return condition


def select_sources(sources: DataFrame, ids: list[str] | None = None, category: str | None = None) -> DataFrame:
    """Sources by id and category; an unknown id, or an empty result, is an error."""
    chosen = sources
    if ids:
        wanted = sources.sparkSession.createDataFrame([(i,) for i in ids], "source_id string")
        unknown = [r.source_id for r in wanted.join(sources, "source_id", "left_anti").take(5)]
        if unknown:
            raise ValueError(f"unknown source ids: {unknown}")
        chosen = chosen.join(wanted, "source_id", "left_semi")
    chosen = chosen.where(catalog_filter(category))
    if chosen.isEmpty():
        raise ValueError("no source matches the filters")
    return chosen


def facets(sources: DataFrame, category: str | None = None, text: str = "") -> DataFrame:
    health = source_health(F.col("last_status"))
    return sources.agg(
        F.count_if(catalog_filter(category, text)).alias("shown"), F.count(F.lit(1)).alias("total"),
        F.count_if("enabled").alias("enabled"), F.countDistinct(F.coalesce("category", F.lit("general"))).alias("categories"),
        F.count_if(health == "ok").alias("ok"), F.count_if(health == "error").alias("failing"),
        F.count_if(health == "unchecked").alias("unchecked"),
    )


def dashboard(topics: DataFrame, sources: DataFrame) -> DataFrame:
    """(metric, value): enabled topics, all topics, enabled sources."""
    t = topics.where("NOT archived").agg(F.count_if("enabled").alias("enabled_topics"), F.count(F.lit(1)).alias("topics"))
    s = sources.where("NOT archived").agg(F.count_if("enabled").alias("enabled_sources"))
    return t.unpivot([], ["enabled_topics", "topics"], "metric", "value").unionByName(
        s.unpivot([], ["enabled_sources"], "metric", "value")
    )


def admit_topics(requests: DataFrame, topics: DataFrame, owner: str, order: list[Column], limit: int = MAX_TOPICS) -> DataFrame:
    """``requests`` for new topics in order, with ``admitted``: whether the owner has fewer than ``limit`` unarchived ones.

    The first rows of an owner that could be admitted at all are ranked; the others are refused unranked.
    """
    held = topics.where("NOT archived").groupBy(owner).agg(F.count(F.lit(1)).alias("_held"))
    first = top_per_group(requests, [owner], order, limit, "_nth").join(held, owner, "left")
    fits = first.where(F.col("_nth") + F.coalesce("_held", F.lit(0)) <= limit).select(owner, "topic_id", F.lit(True).alias("admitted"))
    return requests.join(fits, [owner, "topic_id"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def audit_report(checks: DataFrame, by: list[str]) -> DataFrame:
    """Per audit: sources checked and failed, and the exit status: 0 only if every source is in order."""
    failed = F.count_if(~F.coalesce("ok", F.lit(False)))
    return checks.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), failed.alias("failed"), F.when(failed > 0, 1).otherwise(0).alias("exit_status"))


def sync_presets(sources: DataFrame, presets: DataFrame, version: int) -> DataFrame:
    """Sources after a catalogue update, with what happened to each.

    A preset finds its source by preset id or id (edited rows first), else by URL.  Unedited
    rows take the catalogue's values, edited rows only fill a missing identity, the rest of the
    presets become new sources.
    """
    p = presets.select(*[F.col(c).alias(f"p_{c}") for c in ("id", "name", "url", "language")])
    kept = sources.select("source_id", "name", "url", "language", "preset_id", "user_modified")
    by_identity = kept.where("preset_id IS NOT NULL").join(p, F.col("preset_id") == F.col("p_id")).unionByName(
        kept.join(p, F.col("source_id") == F.col("p_id"))
    ).withColumn("priority", F.when(F.col("user_modified"), 0).otherwise(1) * 2 + F.when(F.col("source_id") == F.col("p_id"), 0).otherwise(1))
    by_url = kept.join(p, F.col("url") == F.col("p_url")).withColumn("priority", F.lit(9))
    # one source for each preset, then one preset for each source
    found = top_per_group(
        by_identity.unionByName(by_url), ["p_id"], [F.col("priority"), F.col("source_id")], 1, "_rn"
    ).drop("_rn")
    found = top_per_group(found, ["source_id"], [F.col("priority"), F.col("p_id")], 1, "_rn").drop("_rn", "priority")
    take = ~F.col("user_modified")
    changed = found.select(
        "source_id", F.when(take, F.col("p_name")).otherwise(F.col("name")).alias("name"), "url",
        F.when(take, F.col("p_language")).otherwise(F.col("language")).alias("language"),
        F.when(take, F.col("p_id")).otherwise(F.coalesce("preset_id", "p_id")).alias("preset_id"), "user_modified",
        F.when(take, "updated").otherwise("kept").alias("action"),
    )
    inserted = p.join(found.select("p_id"), "p_id", "left_anti").select(
        F.col("p_id").alias("source_id"), F.col("p_name").alias("name"), F.col("p_url").alias("url"),
        F.col("p_language").alias("language"), F.col("p_id").alias("preset_id"), F.lit(False).alias("user_modified"),
        F.lit("inserted").alias("action"),
    )
    rest = kept.join(found.select("source_id"), "source_id", "left_anti").withColumn("action", F.lit("untouched"))
    return changed.unionByName(inserted).unionByName(rest).withColumn("preset_version", F.lit(version))
