"""Rounds of a review: exact rules look for no similar titles, plans start from the last one, no empty frame is judged."""

from pyspark.sql import functions as F

from newsops.operators import dedup, rank, review

LIMITS = "run_id string, topic_id string, topic_ord int, article_limit int"
ROW = "run_id string, topic_id string, topic_ord int, row_id string, review_pos int, article_limit int, published_rank bigint, score int"
TWIN = "row_id string, run_id string, canonical_url string, norm_title string, material string"


def test_exact_twins_do_not_compare_titles(spark, monkeypatch):
    rows = [
        ("a", "r", "https://u/1", "alongenoughtitleofanarticle", ""), ("b", "r", "https://u/2", "alongenoughtitleofanarticle", ""),
        ("c", "r", "https://u/1", "alongenoughtitleofanarticles", ""), ("d", "r", "https://u/1", "short", ""),
        ("e", "r", "https://u/1", "short", ""), ("f", "q", "https://u/1", "short", ""), ("g", "r", "https://u/1", "short", "m"),
    ]
    frame = spark.createDataFrame(rows, TWIN)
    exact = ("same_url_exact", "cross_url_exact")
    whole = dedup.duplicate_edges(frame, "row_id", ["run_id"])
    expect = {(r.a, r.b) for r in whole.where(F.col("rule").isin(*exact)).collect()}
    one = {(r.a, r.b) for r in whole.where("rule = 'cross_url_exact'").collect()}
    monkeypatch.setattr(dedup, "_similar", None)
    monkeypatch.setattr(dedup, "_contained", None)
    assert {(r.a, r.b) for r in rank.cross_topic_twins(frame, "run_id", "row_id", exact).collect()} == expect
    assert expect == {("a", "b"), ("b", "a"), ("d", "e"), ("e", "d")}
    assert {(r.a, r.b) for r in rank.cross_topic_twins(frame, "run_id", "row_id", ("cross_url_exact",)).collect()} == one


def _pool(spark):
    rows = [("r", f"t{t}", t, f"t{t}|{i}", i, 3, 0, 90 - i) for t in range(3) for i in range(6)]
    pairs = [(f"t{t}|{i}", f"t{u}|{i}") for i in range(5) for t in range(3) for u in range(3) if t != u]
    return spark.createDataFrame(rows, ROW), spark.createDataFrame(pairs, "a string, b string")


def test_a_plan_does_not_depend_on_its_start(spark):
    pool, pairs = _pool(spark)
    cold = {tuple(r) for r in rank.planned(pool, pairs).select("row_id", "skipped", "trial").collect()}
    wrong = spark.createDataFrame([("t0|0",), ("t2|5",), ("gone",)], "row_id string")
    warm = {tuple(r) for r in rank.planned(pool, pairs, wrong).select("row_id", "skipped", "trial").collect()}
    assert warm == cold and any(skipped for _, skipped, _ in cold)


def test_no_empty_frame_is_judged_and_plans_go_on(spark, monkeypatch):
    pool, pairs = _pool(spark)
    asked, starts, whole = [], [], rank.planned

    def judge(rows):
        asked.append(rows.count())
        return rows.withColumn("qualifies", F.lit(True)).withColumn("counted", F.lit(True))

    def planned(pool, twins, skipped=None):
        starts.append(skipped)
        return whole(pool, twins, skipped)

    monkeypatch.setattr(rank, "planned", planned)
    limits = spark.createDataFrame([("r", f"t{t}", t, 3) for t in range(3)], LIMITS)
    done = review.review_run(pool, limits, judge, lambda rows: pairs)
    assert asked and 0 not in asked
    assert starts[0] is None and None not in starts[1:] and len(starts) > 1
    assert done.seen.where("status = 'selected'").count() > 0


def test_a_run_without_candidates_ends(spark):
    pool, pairs = _pool(spark)
    limits = spark.createDataFrame([("r", "t0", 0, 3)], LIMITS)
    judge = lambda rows: rows.withColumn("qualifies", F.lit(True)).withColumn("counted", F.lit(True))
    done = review.review_run(pool.limit(0), limits, judge, lambda rows: pairs)
    assert done.seen.count() == 0 and [tuple(r) for r in done.short.collect()] == [("r", "t0", 3)]
