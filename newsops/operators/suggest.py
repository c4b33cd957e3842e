"""Keyword and threshold suggestions from labelled examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

MAX_SUGGESTIONS = 40


def suggest_keywords(examples: DataFrame, k: int = MAX_SUGGESTIONS, label: str = "positive", column: str = "text") -> DataFrame:
    """The ``k`` words and word pairs that set positive texts apart (smoothed log odds).

    Each text counts a term once.  Terms reduce to two counts before anything is ranked.
    """
    words = F.filter(F.split(text.searchable_text(column), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    base = examples.select(F.col(label).alias("pos"), words.alias("w"))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - 1, F.lit(1))),
        lambda i: F.concat_ws(" ", F.try_element_at("w", i), F.try_element_at("w", i + 1)),
    )
    terms = base.where(F.size("w") > 0).select("pos", F.explode(F.array_distinct(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))))).alias("term"))
    counted = terms.groupBy("term").agg(F.count_if("pos").alias("n_pos"), F.count_if(~F.col("pos")).alias("n_neg"))
    sizes = examples.agg(F.count_if(label).alias("p"), F.count_if(~F.col(label)).alias("n")).first()
    odds = F.log((F.col("n_pos") + 0.5) / (sizes.p - F.col("n_pos") + 0.5)) - F.log((F.col("n_neg") + 0.5) / (sizes.n - F.col("n_neg") + 0.5))
    return counted.where("n_pos > 0").withColumn("weight", F.round(odds, 6)).orderBy(F.desc("weight"), F.desc("n_pos"), "term").limit(k)


def suggest_threshold(scored: DataFrame, quantile: float = 0.25) -> DataFrame:
    """A threshold that keeps all but the weakest quarter of the positive examples."""
    return scored.where("positive").agg(F.floor(F.percentile("score", quantile)).cast("int").alias("threshold"))
