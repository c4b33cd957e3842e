"""Scores: thresholds and tiers, model-output checks, cache, and the pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..schemas import REASONS, SCORE_FIELDS
from ..session import cut

# Policy of the score cache and the per-run cap.
POLICY_VERSION = 2
CACHE_DAYS = 7
MAX_CALLS_PER_RUN = 500
MAX_TEXT = 12000

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def effective(*values) -> Column:
    """First value that is set: run over topic over default."""
    return F.coalesce(*values)


def supplement_threshold(threshold) -> Column:
    return F.least(threshold, F.greatest(F.lit(40), threshold - 15))


def selection_tier(score, threshold, supplement=None) -> Column:
    """``core`` or ``supplement``; without a stored threshold everything is core."""
    known = threshold.isNotNull() & score.isNotNull()
    if supplement is not None:
        known = known & supplement.isNotNull()
    return F.when(known & (score < threshold), "supplement").otherwise("core")


def score_band(score) -> Column:
    return (
        F.when(score >= 80, "80-100").when(score >= 60, "60-79").when(score >= 40, "40-59").otherwise("0-39")
    )


def analysis_mode(has_model: Column, from_cache: Column, literal: Column, model_configured: Column) -> Column:
    """Where a score came from."""
    return (
        F.when(has_model & from_cache & literal, "ai_cache")
        .when(has_model & from_cache, "ai_cache_semantic")
        .when(has_model & literal, "ai")
        .when(has_model, "ai_semantic")
        .when(model_configured, "rules_fallback")
        .otherwise("rules")
    )


# ---------------------------------------------------------------------------
# Identity of a scored text
# ---------------------------------------------------------------------------
def content_hash(url="canonical_url", title="norm_title") -> Column:
    return F.sha2(F.concat_ws("\n", F.col(url), F.col(title)), 256)


def analysis_fingerprint(
    url="canonical_url", title="norm_title", excerpt="excerpt", full_text="full_text", published="published_at"
) -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (url, title, excerpt, full_text, published)]
    return F.sha2(F.concat_ws("\x00", *parts), 256)


def topic_config(name="name", keywords="keywords", exclusions="exclusion_keywords") -> Column:
    """Everything about a topic that changes a score, as JSON with sorted keys."""
    words = F.when(F.size(keywords) > 0, F.col(keywords)).otherwise(F.array(name))
    return F.to_json(F.struct(
        F.col(exclusions).alias("exclusion_keywords"), words.alias("keywords"), F.col(name).alias("name"),
        F.lit(POLICY_VERSION).alias("scoring_policy_version"),
    ))


def cache_key(fingerprint, config, model) -> Column:
    return F.sha2(F.concat_ws("\x00", fingerprint, F.sha2(config, 256), model), 256)


# ---------------------------------------------------------------------------
# Model output
# ---------------------------------------------------------------------------
def parse_model_output(raw) -> Column:
    """struct(valid, error, score, summary, analysis, relevant, reason) from model text.

    A code fence is removed; all five fields must be present and in range.
    """
    text = F.trim(raw)
    body = F.regexp_replace(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1")
    # numbers stay text here: a quoted or fractional score must not pass as an integer
    fields = F.from_json(body, "map<string,string>")
    typed = F.from_json(body, "struct<score:int,relevant:boolean>")
    summary, analysis = F.trim(fields["summary"]), F.trim(fields["analysis"])
    missing = F.array_except(
        F.array(*[F.lit(n) for n in ("analysis", "reason", "relevant", "score", "summary")]),
        F.map_keys(fields),
    )
    error = (
        F.when(~body.rlike(r"(?s)^\{.*\}$") | fields.isNull(), "not a JSON object")
        .when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
        .when(typed["score"].isNull() | ~typed["score"].between(0, 100), "score out of range")
        .when(typed["relevant"].isNull(), "relevant is not a boolean")
        .when(~fields["reason"].isin(*REASONS), "unknown reason")
        .when((summary == "") | (F.length(summary) > 2000), "summary length")
        .when((analysis == "") | (F.length(analysis) > 5000), "analysis length")
    )
    ok = error.isNull()
    return F.struct(
        ok.alias("valid"), error.alias("error"), F.when(ok, typed["score"]).alias("score"),
        F.when(ok, summary).alias("summary"), F.when(ok, analysis).alias("analysis"),
        F.when(ok, typed["relevant"]).alias("relevant"), F.when(ok, fields["reason"]).alias("reason"),
    )


# ---------------------------------------------------------------------------
# Scoring with a cache
# ---------------------------------------------------------------------------
def cached_scores(candidates: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Left join to the unexpired cache; unreadable cached scores count as a miss.

    ``cache``: cache_key, analysis (JSON), created_at, expires_at; the newest entry per key wins.
    """
    live = (
        cache.where(F.col("expires_at") > as_of)
        .withColumn("parsed", parse_model_output(F.col("analysis")))
        .where("parsed.valid")
        .groupBy("cache_key")
        .agg(F.max_by("parsed", "created_at").alias("cached"))
    )
    return candidates.join(live, "cache_key", "left").withColumn("cache_hit", F.col("cached").isNotNull())


def _guarded(scorer: Scorer) -> Scorer:
    """A batch on which the scorer fails comes back unanswered instead of ending the job."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                yield pd.concat([*scorer(iter([frame]))], ignore_index=True)[["cache_key", "raw"]].assign(failed=False)
            except Exception:  # noqa: BLE001  whatever a user's scorer raises
                yield pd.DataFrame({"cache_key": frame["cache_key"], "raw": None, "failed": True})
    return run


def call_scorer(misses: DataFrame, scorer: Scorer, run: str, order: list[Column], cap: int = MAX_CALLS_PER_RUN) -> DataFrame:
    """(run, cache_key, fresh_score, ai_status) of rows without a cached score.

    Up to ``cap`` keys per run go to ``scorer``, each once and in the order of its first row; an invalid answer
    is asked once more.  The scorer gets frames with cache_key, title and text, and returns cache_key and raw (model text).
    ``ai_status`` is success, invalid (twice), failure (the scorer raised) or over_cap (not asked).  Only keys and order are
    sorted; texts are joined to the keys that are asked.
    """
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_first")
    numbered = cut(misses.groupBy(run, "cache_key").agg(first).withColumn(
        "call_no", F.row_number().over(W.partitionBy(run).orderBy("_first", "cache_key"))).drop("_first"))
    asked, over = numbered.where(F.col("call_no") <= cap), numbered.where(F.col("call_no") > cap)
    body = F.when(F.coalesce(F.col("full_text"), F.lit("")) != "", F.col("full_text")).otherwise(F.col("excerpt"))
    # at most ``cap`` keys a run
    keys = cut(asked.select("cache_key").distinct())
    request = misses.select("cache_key", "title", F.substring(body, 1, MAX_TEXT).alias("text")).join(
        F.broadcast(keys), "cache_key").dropDuplicates(["cache_key"])

    def answers(rows: DataFrame) -> DataFrame:
        # written down, so that what reads the answers twice does not ask twice
        return cut(rows.mapInPandas(_guarded(scorer), "cache_key string, raw string, failed boolean").withColumn(
            "parsed", parse_model_output(F.col("raw"))
        ))

    first = answers(request)
    valid = F.coalesce(F.col("parsed.valid"), F.lit(False))
    again = first.where(~valid & ~F.col("failed")).select("cache_key")
    retry = answers(request.join(again, "cache_key", "left_semi"))
    last = first.join(again, "cache_key", "left_anti").unionByName(retry)
    status = F.when(valid, "success").when(F.col("failed"), "failure").otherwise("invalid")
    got = last.select("cache_key", F.when(valid, F.col("parsed")).alias("fresh_score"), status.alias("ai_status"))
    answered = asked.select(run, "cache_key").join(got, "cache_key", "left")
    skipped = over.select(
        run, "cache_key", F.lit(None).cast(got.schema["fresh_score"].dataType).alias("fresh_score"), F.lit("over_cap").alias("ai_status")
    )
    return answered.select(run, "cache_key", "fresh_score", F.coalesce("ai_status", F.lit("failure")).alias("ai_status")).unionByName(skipped)


def scorer_report(scored: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run: cache hits, requests by result, rows over the cap, and whether the run is degraded."""
    once = scored.select(run, "cache_key", "cache_hit", "ai_status").distinct()
    return once.groupBy(run).agg(
        F.count_if("cache_hit").alias("ai_cached"),
        F.count_if(F.col("ai_status").isin("success", "invalid", "failure")).alias("ai_requests"),
        F.count_if(F.col("ai_status") == "success").alias("ai_success"),
        F.count_if(F.col("ai_status").isin("invalid", "failure")).alias("ai_failure"),
        F.count_if(F.col("ai_status") == "over_cap").alias("ai_over_cap"),
    ).withColumn("degraded", (F.col("ai_failure") + F.col("ai_over_cap")) > 0)


def put_cache(scores: DataFrame, as_of: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Cache rows for new scores."""
    return scores.where("fresh_score.valid").select(
        "cache_key",
        F.to_json(F.struct(*[F.col(f"fresh_score.{f}") for f in SCORE_FIELDS])).alias("analysis"),
        as_of.alias("created_at"),
        (as_of + F.make_interval(days=F.lit(max(1, days)))).alias("expires_at"),
    )


def score_with_cache(
    candidates: DataFrame, cache: DataFrame, as_of: Column, scorer: Scorer | None = None,
    run: str = "run_id", order: list[Column] | None = None, cap: int = MAX_CALLS_PER_RUN, keep_answers: bool = False,
) -> DataFrame:
    """Final score per candidate: cached, else fresh from the scorer, else the keyword rule.

    Candidates need cache_key, lexical_score, literal_match and the text columns.  A candidate
    without a literal match and without a model score gets no score.  ``ai_status`` says what the
    scorer did for the row (see :func:`call_scorer`), NULL where it was not needed.  With
    ``keep_answers`` the scorer's answer stays in ``fresh_score``, as :func:`put_cache` takes it.
    """
    if scorer is not None:                # read several times below: what makes the candidates runs once
        candidates = cut(candidates)
    looked = cached_scores(candidates, cache, as_of)
    if scorer is None:
        scored = looked.withColumn("fresh_score", F.lit(None).cast(looked.schema["cached"].dataType)).withColumn(
            "ai_status", F.lit(None).cast("string"))
    else:
        misses = looked.where("NOT cache_hit")
        fresh = call_scorer(misses, scorer, run, order or [F.col("cache_key")], cap)
        scored = looked.join(fresh, [run, "cache_key"], "left")
    model = F.coalesce("cached", F.when(F.col("fresh_score.valid"), F.col("fresh_score")))
    has_model = model.isNotNull()
    return (
        scored.withColumn("_model", model)
        .withColumn("score", F.when(has_model, F.col("_model.score")).when(F.col("literal_match"), F.col("lexical_score")))
        .withColumn("relevant", F.when(has_model, F.col("_model.relevant")).otherwise(F.col("literal_match")))
        .withColumn("reason", F.when(has_model, F.col("_model.reason")).when(F.col("literal_match"), "direct_match"))
        .withColumn("analysis_mode", analysis_mode(
            has_model, F.col("cache_hit"), F.col("literal_match"), F.lit(scorer is not None)
        ))
        .drop("_model", "cached", *([] if keep_answers else ["fresh_score"]))
    )
