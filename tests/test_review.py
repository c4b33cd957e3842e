"""Demand-driven review against a walk through the turns, one by one."""

import random

import pytest
from pyspark.sql import functions as F

from newsops.operators import review

SCHEMA = ("run_id string, topic_id string, topic_ord int, row_id string, review_pos int, article_limit int, published_rank long, "
          "story int, score int, relevant boolean, counted boolean, matched boolean")


def make_run(rng, topics, direct, semantic, stories):
    limits, rows = [], []
    for t in range(topics):
        limit = rng.randint(1, 6)
        limits.append(("r", f"t{t}", t, limit))
        for kind, n in (("d", direct), ("s", semantic)):
            for pos in range(1, rng.randint(0, n) + 1):
                rows.append(("r", f"t{t}", t, f"t{t}{kind}{pos}", pos, limit, rng.randint(1, 9), rng.randint(1, stories), rng.randint(0, 100),
                             rng.random() < 0.8, rng.random() < 0.9, kind == "d"))
    return limits, rows


def walk(limits, rows, initial, additional):
    """The reference behaviour as a sequential program: reviewed rows with their stage, and the final selection."""
    by_topic = {t: [] for _, t, _, _ in limits}
    pools = {k: {t: [r for r in sorted(rows, key=lambda r: r[4]) if r[1] == t and r[11] == (k == "d")] for t in by_topic} for k in "ds"}
    at = {k: dict.fromkeys(by_topic, 0) for k in "ds"}
    reviewed = []

    plan = planner(limits, by_topic)
    _turns(limits, pools, at, by_topic, plan, reviewed, initial, additional)
    return reviewed, plan()[0]


def planner(limits, by_topic):
    def plan():
        taken, counts, stories = [], dict.fromkeys(by_topic, 0), set()
        ranked = {t: sorted(by_topic[t], key=lambda r: (-r[8], -r[6])) for t in by_topic}
        place = dict.fromkeys(by_topic, 0)
        while True:
            moved = False
            for _, t, _, limit in limits:
                while counts[t] < limit and place[t] < len(ranked[t]):
                    row = ranked[t][place[t]]
                    place[t] += 1
                    if row[7] in stories:
                        continue
                    taken.append(row[3])
                    stories.add(row[7])
                    counts[t] += 1
                    moved = True
                    break
            if not moved:
                return taken, counts

    return plan


def _turns(limits, pools, at, by_topic, plan, reviewed, initial, additional):
    def turns(kind, stage, budget):
        used = 0
        while True:
            moved = False
            for _, t, _, limit in limits:
                if budget is not None and used >= budget:
                    return
                if plan()[1][t] >= limit or at[kind][t] >= len(pools[kind][t]):
                    continue
                row = pools[kind][t][at[kind][t]]
                at[kind][t] += 1
                moved = True
                reviewed.append((row[3], stage))
                used += row[10]
                if row[9] and row[8] >= 50:
                    by_topic[t].append(row)
            if not moved:
                return

    turns("d", "direct", None)
    turns("s", "initial", initial)
    if any(plan()[1][t] < limit and at["s"][t] < len(pools["s"][t]) for _, t, _, limit in limits):
        turns("s", "additional", additional)


def judge(rows):
    return rows.withColumn("qualifies", F.col("relevant") & (F.col("score") >= 50))


def twins(rows):
    a, b = [rows.select(F.col("row_id").alias(x), F.col("story").alias(f"_{x}"), F.col("topic_id").alias(f"_t{x}")) for x in "ab"]
    return a.join(b, (F.col("_a") == F.col("_b")) & (F.col("_ta") != F.col("_tb"))).select("a", "b")


def repeats_inside_topics_removed(rows):
    seen, out = set(), []
    for r in rows:                                   # as the digest does before the review, over both pools of a topic
        if (r[1], r[7]) not in seen:
            seen.add((r[1], r[7]))
            out.append(r)
    return out


@pytest.mark.parametrize("seed,stories", [(1, 1000), (2, 1000), (3, 25)])
def test_review_equals_the_walk(spark, seed, stories):
    rng = random.Random(seed)
    limits, rows = make_run(rng, 4, 10, 14, stories)
    rows = repeats_inside_topics_removed(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    asked = []

    def counting(part):
        asked.extend(r.row_id for r in part.select("row_id").collect())
        return judge(part)

    done = review.review_run(
        frame.where("matched"), spark.createDataFrame(limits, "run_id string, topic_id string, topic_ord int, article_limit int"), counting, twins,
        frame.where("NOT matched"), initial=6, additional=4,
    )
    want, selected = walk(limits, rows, 6, 4)
    got = [(r.row_id, r.stage) for r in done.seen.collect()]
    assert sorted(got) == sorted(want)
    assert sorted(asked) == sorted(r for r, _ in want)                 # nobody is asked for a row that no turn reaches
    assert sorted(r.row_id for r in done.seen.where("status = 'selected'").collect()) == sorted(selected)


@pytest.mark.parametrize("seed", [4, 5])
def test_review_with_many_repeats_across_topics(spark, seed):
    """Topics take each other's stories away: the selection is that of the turns over what was reviewed, and no one stays short in vain."""
    rng = random.Random(seed)
    limits, rows = make_run(rng, 4, 10, 14, 12)
    rows = repeats_inside_topics_removed(rows)
    frame = spark.createDataFrame(rows, SCHEMA)
    done = review.review_run(
        frame.where("matched"), spark.createDataFrame(limits, "run_id string, topic_id string, topic_ord int, article_limit int"), judge, twins,
        frame.where("NOT matched"), initial=6, additional=4,
    )
    seen = done.seen.orderBy("review_seq").collect()
    by_topic = {t: [r for row in seen if row.qualifies and row.topic_id == t for r in rows if r[3] == row.row_id] for _, t, _, _ in limits}
    selected, counts = planner(limits, by_topic)()
    assert sorted(r.row_id for r in seen if r.status == "selected") == sorted(selected)
    reviewed = {r.row_id for r in seen}
    for _, t, _, limit in limits:
        if counts[t] < limit:
            assert all(r[3] in reviewed for r in rows if r[1] == t and r[11])
    used = {s: sum(r.counted for r in seen if r.stage == s) for s in ("initial", "additional")}
    assert used["initial"] <= 6 and used["additional"] <= 4


def test_coupled_budget_equals_the_walk(spark):
    for seed in range(4):
        rng = random.Random(seed)
        limits, rows = make_run(rng, 5, 0, 20, 10 ** 6)
        frame = spark.createDataFrame(rows, SCHEMA)
        need = spark.createDataFrame([(r, t, n) for r, t, _, n in limits], "run_id string, topic_id string, missing int")
        got = review.coupled_budget(frame, judge, need, (("initial", 8), ("additional", 5)))
        assert sorted((r.row_id, r.stage) for r in got.collect()) == sorted(walk(limits, rows, 8, 5)[0])


def test_review_of_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    limits = spark.createDataFrame([("r", "t", 1, 3)], "run_id string, topic_id string, topic_ord int, article_limit int")
    done = review.review_run(none, limits, judge, twins, none)
    assert done.seen.count() == 0 and done.short.first().missing == 3
