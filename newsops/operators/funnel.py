"""Run accounting: what happened to every article, per run, topic and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Second names under which old readers expect the same count.
ALIASES = {
    "feed_items": ("discovered",),
    "semantic_reviewed": ("semantic_fallback",),
    "semantic_additional_reviewed": ("semantic_expansion",),
    "semantic_budget_exhausted": ("budget_exhausted",),
    "threshold_rejected": ("below_supplement", "below_extended"),
    "supplement_selected": ("extended_selected",),
    "selected": ("results",),
}
REASON_COUNTERS = (
    "direct_match contextual_match background_context off_topic exclusion_match insufficient_evidence"
).split()
OUTCOMES = (
    "complete no_fresh_articles no_relevant_after_ai no_keyword_match no_new_after_dedup below_threshold"
).split()


def reason_counter(reason) -> Column:
    """Counter name of a relevance reason; unknown ones share ``reason_other``."""
    clean = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    return F.when(clean.isin(*REASON_COUNTERS), F.concat(F.lit("reason_"), clean)).otherwise("reason_other")


def with_aliases(counts: DataFrame, counter: str = "counter") -> DataFrame:
    """Repeat each count under its other names."""
    names = F.create_map(*[
        x for name, others in ALIASES.items()
        for x in (F.lit(name), F.array(*[F.lit(n) for n in (name, *others)]))
    ])
    known = F.coalesce(names[F.col(counter)], F.array(F.col(counter)))
    return counts.withColumn(counter, F.explode(known))


def count_events(events: DataFrame, amount: str | None = None) -> DataFrame:
    """(run_id, scope, scope_id, counter, value) from events (run_id, topic_id, source_id, counter).

    Events collapse to one row per (run, topic, source, counter) first; the three scopes are
    grouping sets over that small table.  A NULL topic or source adds to no such scope.
    """
    value = F.sum(amount) if amount else F.count(F.lit(1))
    small = events.groupBy("run_id", "topic_id", "source_id", "counter").agg(value.alias("n"))
    rows = small.select("run_id", "counter", "n", F.explode(F.array(
        F.struct(F.lit("global").alias("scope"), F.lit("").alias("scope_id")),
        F.struct(F.lit("topic").alias("scope"), F.col("topic_id").alias("scope_id")),
        F.struct(F.lit("source").alias("scope"), F.col("source_id").alias("scope_id")),
    )).alias("s"))
    return (
        rows.select("run_id", "s.scope", "s.scope_id", "counter", "n").where("scope_id IS NOT NULL")
        .groupBy("run_id", "scope", "scope_id", "counter").agg(F.sum("n").alias("value"))
    )


def item_counts(items: DataFrame, topic_scope: DataFrame) -> DataFrame:
    """Feed-item and freshness counters.

    Globally and per source an item counts once; per topic it counts in every topic whose scope
    has its source, so the topic values do not add up to the global one.
    ``items``: run_id, source_id, date_reason.  ``topic_scope``: topic_id, source_id.
    """
    per_source = (
        items.groupBy("run_id", "source_id", "date_reason").agg(F.count(F.lit(1)).alias("n"))
        .select("run_id", "source_id", "n", F.explode(F.when(
            F.col("date_reason").isNull(), F.array(F.lit("feed_items"), F.lit("fresh"))
        ).otherwise(F.array(F.lit("feed_items"), F.lit("date_rejected"), F.col("date_reason")))).alias("counter"))
    )
    once = count_events(per_source.withColumn("topic_id", F.lit(None).cast("string")), "n")
    per_topic = (
        per_source.join(topic_scope, "source_id")
        .groupBy("run_id", F.lit("topic").alias("scope"), F.col("topic_id").alias("scope_id"), "counter")
        .agg(F.sum("n").alias("value"))
    )
    return once.unionByName(per_topic)


def widen(counts: DataFrame) -> DataFrame:
    """One row per (run, scope, scope_id) with a counter -> value map."""
    return counts.groupBy("run_id", "scope", "scope_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("counter", F.col("value").cast("bigint"))))).alias("counts")
    )


def run_totals(counts: DataFrame, names: list[str]) -> DataFrame:
    """Global counters of each run as columns, 0 where absent."""
    total = counts.where("scope = 'global'")
    return total.groupBy("run_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("counter") == n, F.col("value"))), F.lit(0)).cast("bigint").alias(n)
        for n in names
    ])


OUTCOME_INPUTS = (
    "selected feed_items fresh keyword_hits ai_success ai_irrelevant threshold_rejected "
    "semantic_reviewed unique_candidates duplicates_skipped"
).split()


def outcome(c=F.col) -> Column:
    """Why a run ended as it did, first matching reason; works on ``OUTCOME_INPUTS`` columns."""
    return (
        F.when(c("selected") > 0, "complete")
        .when((c("feed_items") == 0) | (c("fresh") == 0), "no_fresh_articles")
        .when(
            (c("keyword_hits") > 0) & (c("ai_success") > 0)
            & (c("ai_irrelevant") == c("ai_success")) & (c("threshold_rejected") == 0),
            "no_relevant_after_ai",
        )
        .when((c("keyword_hits") == 0) & (c("semantic_reviewed") == 0), "no_keyword_match")
        .when((c("unique_candidates") == 0) & (c("duplicates_skipped") > 0), "no_new_after_dedup")
        .when(c("threshold_rejected") > 0, "below_threshold")
        .when(c("duplicates_skipped") > 0, "no_new_after_dedup")
        .otherwise("no_keyword_match")
    )


def run_status(source_failures, model_failed, cap_hit) -> Column:
    return F.when((source_failures > 0) | model_failed | cap_hit, "degraded").otherwise("complete")


def source_outcome(results: DataFrame) -> DataFrame:
    """Success and failure counts per run from (run_id, source_id, ok); all failed fails the run."""
    counted = results.groupBy("run_id").agg(
        F.count_if("ok").alias("source_success"), F.count_if(~F.col("ok")).alias("source_failure")
    )
    return counted.withColumn(
        "run_failed", (F.col("source_success") == 0)
    )


def warning_text(*messages: Column) -> Column:
    """Messages that apply, without repeats, joined by blanks; NULL when none does."""
    texts = F.array_distinct(F.filter(F.array_compact(F.array(*messages)), lambda m: m != ""))
    return F.nullif(F.array_join(texts, " "), F.lit(""))


def first_numeric(record: Column, *keys: str) -> Column:
    """First key of a string map that holds a finite number."""
    def number(key):
        value = record[key].try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return F.coalesce(*[number(k) for k in keys])


def duplicate_total(record: Column) -> Column:
    """Skipped duplicates, or the sum of its two parts when only those were stored."""
    parts = [first_numeric(record, "history_duplicates"), first_numeric(record, "run_duplicates")]
    both = F.when(
        parts[0].isNotNull() | parts[1].isNotNull(),
        F.coalesce(parts[0], F.lit(0.0)) + F.coalesce(parts[1], F.lit(0.0)),
    )
    return F.coalesce(first_numeric(record, "duplicates_skipped", "duplicate_count"), both)
