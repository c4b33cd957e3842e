"""Scalar functions on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsops.functions import dates, text, urls
from newsops.functions.similarity import changes_content, common_subsequence, similar
from newsops.operators import score


def one(spark, value, column, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(column.alias("r")).first().r


def column(spark, values, make):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r.r for r in df.select("i", make(F.col("x")).alias("r")).orderBy("i").collect()]


def test_title_identity(spark):
    titles = {
        "Output up 0.50 percent": "outputup0.5%", "ＯＵＴＰＵＴ up ０.5%": "outputup0.5%",
        "Sales of $1,050.00 in Kiel": "salesofusd1050inkiel", "Plan 2031-2-14": "plan2031/2/14",
        "[Photos] The old bridge": "theoldbridge", "[Draft] The old bridge": "draftthe" + "oldbridge",
        "独家：新桥公布 - 证券时报": "新桥发布", "Große Straße": "grossestrasse", "1,23405 x": "123405x",
    }
    got = column(spark, list(titles), lambda c: text.normalize_title(text.folded_title(c)))
    assert got == list(titles.values())


@pytest.mark.parametrize("a,b,same", [
    ("Rate at 1.5", "Rate at 15", False), ("Rate at 5", "Rate at 5%", False), ("Rate at -5", "Rate at 5", False),
    ("Meeting in June", "Meeting in July", False), ("Open today", "Open tomorrow", False),
    ("From May to June", "From June to May", False), ("Loan of 3 million", "Loan of 3 billion", False),
    ("Loan of $3", "Loan of €3", False), ("Rule proposed", "Rule approved", False),
    ("Rate at 5 percent", "Rate at 5%", True), ("Rate at 5.0", "Rate at 5", True), ("Sum of 1,000", "Sum of 1000", True),
    ("Meeting in Sept", "Meeting in September", True), ("Loan of 3 dollars", "Loan of 3 usd", True),
])
def test_material_keeps_updates(spark, a, b, same):
    got = column(spark, [a, b], lambda c: text.material_key(text.material_signature(text.folded_title(c))))
    assert (got[0] == got[1]) is same


def test_stage_and_calendar_order(spark):
    signature = one(spark, "获批准 十二月 then may, 2 月", text.material_signature(text.folded_title("x")))
    assert signature.stages == ["批准", "获批"] or sorted(signature.stages) == sorted(["批准", "获批"])
    assert signature.calendar == ["month-12", "month-5"]


def test_keywords(spark):
    got = one(spark, "Ａlpha， beta  two;ALPHA\nß、SS,,", text.parse_keywords("x"))
    assert got == ["Alpha", "beta two", "ß"]


def test_urls(spark):
    cases = {
        "HTTPS://me@Site.example:443/News/?utm_source=a&b=2&A=1#top": "https://site.example/news?a=1&b=2",
        "http://site.example:8080/": "http://site.example:8080/", "http://site.example:70000/a#b": "raw:http://site.example:70000/a",
        "https://site.example/a/?ref=x&gclid=": "https://site.example/a", "https://site.example/?q=a%20b&e=": "https://site.example/?e=&q=a+b",
    }
    assert column(spark, list(cases), lambda c: urls.canonical_url(urls.folded_url(c))) == list(cases.values())
    safe = column(spark, ["https://a.example/x", "http://localhost/", "http://10.0.0.1/", "ftp://a.example", "http://printer.local/x"],
                  lambda c: urls.is_public_url(urls.folded_url(c)))
    assert safe == [True, False, False, False, False]


def test_freshness_bounds(spark):
    now = dt.datetime(2031, 5, 10)
    values = ["2031-05-03T00:00:00Z", "2031-05-02T23:59:59Z", "2031-05-11T00:00:00Z", "2031-05-11T00:00:01Z", "", None, "soon",
              "Fri, 09 May 2031 10:00:00 +0200"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").withColumn("ts", dates.published_timestamp("x"))
    got = [r.r for r in df.select("i", dates.date_reason("x", "ts", F.lit(now), 7).alias("r")).orderBy("i").collect()]
    assert got == [None, "date_stale", None, "date_future", "date_missing", "date_missing", "date_invalid", None]


def test_similarity_bound_never_rejects():
    import difflib
    import random
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcde") for _ in range(rng.randint(5, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            b[rng.randrange(len(b))] = rng.choice("abcde")
        b = "".join(b)
        ratio = difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()
        assert 2 * common_subsequence(a, b) / (len(a) + len(b)) >= ratio - 1e-12
        assert similar(a, b, 0.9) == (ratio >= 0.9)
    assert changes_content("bridgeopensinkiel", "tunnelopensinkiel") and not changes_content("bridgeopens", "bridgeopen")


def test_model_output(spark):
    good = '{"score": 71, "summary": "s", "analysis": "a", "relevant": true, "reason": "direct_match"}'
    cases = {good: None, f"```json\n{good}\n```": None, "plain": "not a JSON object", good.replace("71", "171"): "score out of range",
             good.replace('"summary": "s", ', ""): "missing: summary", good.replace("direct_match", "maybe"): "unknown reason"}
    assert [r.error for r in column(spark, list(cases), score.parse_model_output)] == list(cases.values())


def test_thresholds(spark):
    df = spark.createDataFrame([(60,), (50,), (40,), (30,)], "t int")
    assert [r[0] for r in df.select(score.supplement_threshold(F.col("t"))).collect()] == [45, 40, 40, 30]
