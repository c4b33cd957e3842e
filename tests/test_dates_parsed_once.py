"""Usual spellings of dates take a short way, with the result of the long one; a verdict parses its date once."""

import re

from pyspark.sql import functions as F

from newsops.functions import dates

SPELLINGS = [
    ("2024-01-05T10:20:30Z", "2024-01-05 10:20:30"), ("2024-01-05T10:20:30+02:00", "2024-01-05 08:20:30"),
    ("2024-01-05", "2024-01-05 00:00:00"), ("20240105T102030", "2024-01-05 10:20:30"), ("2024-13-05T10:20:30Z", None),
    ("Fri, 05 Jan 2024 10:20:30 GMT", "2024-01-05 10:20:30"), ("fri, 5 jan 24 10:20 EST", "2024-01-05 15:20:00"),
    ("Fri, 05 Jan 2024 10:20:30 GMT\n", "2024-01-05 10:20:30"), ("Fri, 31 Feb 2024 10:20:30 GMT", None), ("undated", None), (None, None),
]


def test_spellings(spark):
    df = spark.createDataFrame(SPELLINGS, "raw string, want string")
    got = df.select("raw", F.col("want").cast("timestamp").alias("want"), dates.published_timestamp("raw").alias("got"))
    assert got.where("NOT (want <=> got)").collect() == []


def test_a_filter_on_the_verdict_parses_once(spark):
    df = spark.createDataFrame(SPELLINGS, "raw string, want string").withColumn("ts", dates.published_timestamp("raw"))
    reason = dates.date_reason("raw", "ts", F.lit("2024-01-06 00:00:00").cast("timestamp"), 3)
    fresh = df.withColumn("reason", reason).where("reason IS NULL").select("raw")
    assert sorted(r.raw for r in fresh.collect()) == sorted(raw for raw, want in SPELLINGS if want)
    plan = fresh._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("gettimestamp", plan)) <= 1
