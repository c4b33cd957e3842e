"""Validation of imported bundles: rules, references and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Device names that must not become a file name.
RESERVED = ["aux", "con", "nul", "prn", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}\z"


def is_safe_id(value) -> Column:
    """True when the id can name one report file."""
    c = F.col(value) if isinstance(value, str) else value
    return c.rlike(SAFE_ID) & ~F.lower(F.substring_index(c, ".", 1)).isin(*RESERVED)


# ---------------------------------------------------------------------------
# Bundle rules.  Incoming frames hold text columns, as a loosely typed import does.
# ---------------------------------------------------------------------------
RUN_STATUSES = ("queued", "running", "complete", "degraded", "failed", "cancelled")


def _id_error(c) -> Column:
    value = F.trim(F.col(c))
    return F.when(value.isNull() | (value == ""), f"{c} is empty").when(F.length(value) > 128, f"{c} is too long")


def _text_error(c, limit, required=False) -> Column:
    value = F.col(c)
    error = F.when(F.length(value) > limit, f"{c} is too long")
    return F.when(F.trim(F.coalesce(value, F.lit(""))) == "", f"{c} is empty").otherwise(error) if required else error


def _int_error(c, low=0, high=None) -> Column:
    number = F.when(F.col(c).rlike(r"^-?\d+$"), F.col(c).try_cast("bigint"))
    outside = (number < low) if high is None else ~number.between(low, high)
    return F.when(F.col(c).isNotNull() & number.isNull(), f"{c} is not an integer").when(outside, f"{c} is out of range")


def _bool_error(c) -> Column:
    return F.when(F.col(c).isNotNull() & ~F.col(c).isin("true", "false", "0", "1"), f"{c} is not a boolean")


RULES = {
    "source": lambda: [
        _id_error("source_id"), _text_error("name", 100, True),
        F.when(~F.col("url").rlike(r"^https?://[^/?#\s]+"), "url is not http(s)"),
        _bool_error("enabled"), _bool_error("archived"), _bool_error("user_modified"),
    ],
    "topic": lambda: [
        _id_error("topic_id"), _text_error("name", 80, True), _int_error("threshold", 0, 100),
        _int_error("article_limit", 1, 100), _bool_error("enabled"), _bool_error("archived"),
    ],
    "run": lambda: [
        F.when(~F.coalesce(is_safe_id("run_id"), F.lit(False)), "run_id is not safe"),
        F.when(~F.coalesce(F.col("status").isin(*RUN_STATUSES), F.lit(False)), "status is unknown"),
        _int_error("article_count"), _text_error("warning", 5000), _text_error("error", 5000),
    ],
    "article": lambda: [
        _id_error("id"), _text_error("title", 1000, True),
        F.when(~F.coalesce(F.col("url").rlike(r"^https?://[^/?#\s]+"), F.lit(False)), "url is not http(s)"),
        _text_error("url", 5000), _text_error("excerpt", 10000), _text_error("summary", 10000),
        _text_error("analysis", 20000), _int_error("score", 0, 100), _bool_error("favorite"),
    ],
}
KEYS = {"source": "source_id", "topic": "topic_id", "run": "run_id", "article": "id"}


def rule_violations(df: DataFrame, entity: str) -> DataFrame:
    """(entity, id, rule): field rules, one narrow pass."""
    key = KEYS[entity]
    broken = F.array_compact(F.array(*RULES[entity]()))
    return df.select(
        F.lit(entity).alias("entity"), F.col(key).cast("string").alias("id"), F.explode(broken).alias("rule")
    )


def duplicate_ids(df: DataFrame, entity: str) -> DataFrame:
    key = KEYS[entity]
    return df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit(entity).alias("entity"), "id", F.lit("duplicate id").alias("rule")
    )


def dangling(df: DataFrame, entity: str, column: str, target: DataFrame, target_key: str) -> DataFrame:
    """References to rows the bundle does not contain; an empty reference is none."""
    refs = df.where(F.coalesce(F.col(column), F.lit("")) != "")
    missing = refs.join(target.select(F.col(target_key).alias(column)).distinct(), column, "left_anti")
    return missing.select(
        F.lit(entity).alias("entity"), F.col(KEYS[entity]).cast("string").alias("id"), F.lit(f"unknown {column}").alias("rule")
    )


def validate_bundle(
    sources: DataFrame, topics: DataFrame, runs: DataFrame, articles: DataFrame, version: int = 1
) -> DataFrame:
    """Every violation of an incoming bundle; an empty result means it may be merged.

    From version 2 on every article must name its run; runs that list topics must list known ones.
    """
    refs = topics.select("topic_id", F.explode("source_ids").alias("source_id"))
    parts = [rule_violations(df, e) for e, df in
             (("source", sources), ("topic", topics), ("run", runs), ("article", articles))]
    parts += [duplicate_ids(df, e) for e, df in
              (("source", sources), ("topic", topics), ("run", runs), ("article", articles))]
    parts += [
        dangling(refs, "topic", "source_id", sources, "source_id"),
        dangling(articles, "article", "topic_id", topics, "topic_id"),
        dangling(articles, "article", "source_id", sources, "source_id"),
        dangling(articles, "article", "run_id", runs, "run_id"),
    ]
    if "topic_ids" in runs.columns:
        parts.append(dangling(runs.select("run_id", F.explode("topic_ids").alias("topic_id")), "run", "topic_id", topics, "topic_id"))
    if version >= 2:
        unnamed = articles.where(F.trim(F.coalesce("run_id", F.lit(""))) == "")
        parts.append(unnamed.select(F.lit("article").alias("entity"), F.col("id").cast("string").alias("id"), F.lit("run_id is empty").alias("rule")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def close_unfinished(runs: DataFrame) -> DataFrame:
    """Imported runs that never ended are stored as failed and interrupted."""
    stuck = F.col("status").isin("queued", "running")
    return runs.withColumns({
        "outcome": F.when(stuck, "interrupted").otherwise(F.col("outcome")),
        "finished_at": F.when(stuck, F.coalesce("finished_at", "started_at")).otherwise(F.col("finished_at")),
        "status": F.when(stuck, "failed").otherwise(F.col("status")),
    })
