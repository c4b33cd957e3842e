"""What makes the candidates of a scorer runs once, however often they are read."""

import pandas as pd
from pyspark.sql import functions as F

from newsops.operators import score


def test_candidates_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(i):
        made.add(1)
        return f"title {i}"

    def scorer(frames):
        for frame in frames:
            yield pd.DataFrame({"cache_key": frame["cache_key"], "raw": ["no json"] * len(frame)})

    rows = spark.range(20).select(
        F.lit("r").alias("run_id"), (F.col("id") % 15).cast("string").alias("cache_key"), title("id").alias("title"), F.lit("").alias("excerpt"),
        F.lit("text").alias("full_text"), F.lit(60).alias("lexical_score"), F.lit(True).alias("literal_match"), "id")
    cache = spark.createDataFrame([], "cache_key string, analysis string, created_at timestamp, expires_at timestamp")
    done = score.score_with_cache(rows, cache, F.lit("2024-01-01").cast("timestamp"), scorer, order=[F.col("id")], cap=10).select(
        "id", "title", "ai_status").collect()
    assert {r.id: r.ai_status for r in done} == {i: "invalid" if i % 15 < 10 else "over_cap" for i in range(20)}
    assert made.value == 20
