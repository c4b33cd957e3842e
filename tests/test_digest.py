"""Demand-driven runs: who is scored, vetoes, page bodies, counters."""

import json
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsops.plans import digest as D
from newsops.queries import views as V
from newsops.queries.intake import _sample_scorer
from newsops.queries.ranking import new_and_past
from test_review import walk

SF = "/root/testdata/sf0.001"
ARTICLE = "article_id long, title string, url string, excerpt string, full_text string, source_id string, source_name string, published_at string"
TOPIC = ("topic_id string, topic_ord int, name string, keywords array<string>, exclusion_keywords array<string>, threshold int, article_limit int, "
         "source_ids array<string>, enabled boolean, archived boolean")


def topic(n, keywords, limit, exclusions=(), threshold=60, sources=()):
    return (f"t{n}", n, f"Topic {n}", list(keywords), list(exclusions), threshold, limit, list(sources), True, False)


def run(spark, articles, topics, **how):
    rows = [(i, title, f"https://s{i % 2}.example.com/{i}", "", text, f"s{i % 2}", f"S{i % 2}", f"2024-01-0{1 + i % 5}T00:00:00Z") for i, title, text in articles]
    sources = spark.createDataFrame([("s0", 0, True, False), ("s1", 1, True, False)], "source_id string, source_ord int, enabled boolean, archived boolean")
    how = {"fuzzy": False} | how                       # the similarity rules have tests of their own
    return D.digest(
        spark.createDataFrame(rows, ARTICLE), spark.createDataFrame(topics, TOPIC), sources, None, F.lit("2024-01-06 00:00:00").cast("timestamp"), **how
    )


def totals(done, scope="global", scope_id=""):
    return {r.counter: r.value for r in done.counts.where((F.col("scope") == scope) & (F.col("scope_id") == scope_id)).collect()}


def scorer_with(folder, answers):
    """A scorer that writes down every title it is asked for; titles without an answer get nonsense."""
    folder = str(folder)

    def scorer(frames):
        for frame in frames:
            for title in frame["title"]:
                with open(f"{folder}/calls", "a") as out:
                    out.write(title + "\n")
            yield pd.DataFrame({"cache_key": frame["cache_key"], "raw": [json.dumps(answers[t]) if t in answers else "?" for t in frame["title"]]})

    return scorer


def calls(folder):
    path = Path(folder) / "calls"
    return path.read_text().splitlines() if path.exists() else []


def answer(score, relevant=True, reason="direct_match"):
    return {"score": score, "summary": "s", "analysis": "a", "relevant": relevant, "reason": reason}


def test_only_rows_that_a_short_topic_reaches_are_scored(spark, tmp_path):
    articles = [(i, f"Solar number {i} {'abcdefghij'[i]}", "x") for i in range(10)]
    done = run(spark, articles, [topic(1, ["solar"], 3)], scorer=scorer_with(tmp_path, {t: answer(90) for _, t, _ in articles}), semantic=False)
    assert len(calls(tmp_path)) == 3 and done.selected.count() == 3
    assert totals(done)["ai_requests"] == totals(done)["ai_success"] == totals(done)["processed"] == 3
    assert done.cache_rows.count() == 3


def test_vetoes_and_low_scores_ask_further_and_the_cache_answers(spark, tmp_path):
    articles = [(i, f"Solar number {i} {'abcdefghij'[i]}", "x") for i in range(8)]
    given = {t: answer(90) for _, t, _ in articles}
    order = ["Solar number 4 e", "Solar number 3 d", "Solar number 2 c"]           # newest first, sources in turn
    given[order[0]], given[order[1]] = answer(95, False, "off_topic"), answer(10)
    topics = [topic(1, ["solar"], 2)]
    done = run(spark, articles, topics, scorer=scorer_with(tmp_path, given), semantic=False)
    asked = calls(tmp_path)
    assert len(asked) == len(set(asked)) == 4 and set(order[:2]) <= set(asked)
    counts = totals(done)
    assert (counts["ai_irrelevant"], counts["threshold_rejected"], counts["selected"], counts["reason_off_topic"]) == (1, 1, 2, 1)
    assert {r.reason for r in done.rejected.collect()} == {"ai_irrelevant", "threshold_rejected"}
    again = run(spark, articles, topics, scorer=scorer_with(tmp_path, given), semantic=False, cache=done.cache_rows)
    assert calls(tmp_path) == asked and totals(again)["ai_cache_hits"] == 4
    assert again.selected.select("article_id").collect() == done.selected.select("article_id").collect()
    assert {r.analysis_mode for r in again.selected.collect()} == {"ai_cache"}


def test_a_cap_and_an_invalid_answer_fall_back_to_the_rule(spark, tmp_path):
    articles = [(i, f"Solar number {i} {'abcdefghij'[i]}", "x") for i in range(6)]
    done = run(spark, articles, [topic(1, ["solar"], 5)], scorer=scorer_with(tmp_path, {}), semantic=False, max_calls=2)
    assert len(set(calls(tmp_path))) == 2 and len(calls(tmp_path)) == 4              # invalid answers are asked once more
    assert {r.analysis_mode for r in done.selected.collect()} == {"rules_fallback"} and totals(done)["ai_failure"] == 2
    assert done.selected.count() == 5


def test_articles_without_a_keyword_share_the_reviews(spark, tmp_path):
    articles = [(0, "Solar one", "x"), (1, "Wind one", "x")] + [(i, f"Other story {i} {'abcdefghijklmnopqrstuvwxyz'[i % 26]}{i}", "x") for i in range(2, 60)]
    given = {t: answer(80) for i, t, _ in articles if i % 3 == 0} | {"Solar one": answer(70), "Wind one": answer(70)}
    given |= {t: answer(80, False, "off_topic") for i, t, _ in articles if i % 3}
    done = run(spark, articles, [topic(1, ["solar"], 4), topic(2, ["wind"], 30)], scorer=scorer_with(tmp_path, given))
    counts, first, second = totals(done), totals(done, "topic", "t1"), totals(done, "topic", "t2")
    assert (counts["semantic_initial_reviewed"], counts["semantic_additional_reviewed"]) == (20, 15)
    assert first["selected"] == 4 and first["semantic_reviewed"] < second["semantic_reviewed"]
    assert counts["semantic_budget_exhausted"] if "semantic_budget_exhausted" in counts else second["semantic_budget_exhausted"] > 0
    assert "semantic_budget_exhausted" not in first
    assert len(calls(tmp_path)) == counts["ai_requests"] == 37
    rows = done.selected.select("article_id").collect()
    assert len(rows) == len(set(rows))                                             # no topic shows what another one shows


def test_page_bodies_are_tried_once_and_can_win_or_lose_an_article(spark):
    articles = [(0, "Solar plant opens", ""), (1, "Quiet day", ""), (2, "Market news", ""), (3, "Solar again today", "full text here"), (4, "Nothing known", "")]
    bodies = spark.createDataFrame([
        ("https://s0.example.com/0", "about solar and gossip"), ("https://s1.example.com/1", "a word on solar"), ("https://s0.example.com/2", "plain"),
    ], "canonical_url string, body string")
    topics = [topic(1, ["solar"], 5, ["gossip"]), topic(2, ["market"], 5)]
    done = run(spark, articles, topics, page_bodies=bodies)
    assert {(r.topic_id, r.article_id) for r in done.selected.collect()} == {("t1", 3), ("t1", 1), ("t2", 2)}
    counts = totals(done)
    assert (counts["fulltext_fetches"], counts["fulltext_success"], counts["fulltext_failure"]) == (4, 3, 1)
    assert (counts["exclusion_rejected"], counts["reason_exclusion_match"], counts["fulltext_keyword_hits"]) == (1, 1, 1)
    assert totals(done, "topic", "t2")["fulltext_success"] == 3                    # remembered texts count for the second topic, not as fetches
    assert done.rejected.where("reason = 'exclusion_rejected'").first().article_id == 0
    body = {r.article_id: r.full_text for r in done.selected.collect()}
    assert body[1] == "a word on solar" and body[3] == "full text here"


def test_page_budget(spark, monkeypatch):
    articles = [(i, f"Solar number {i} {'abcdefghij'[i]}", "") for i in range(6)]
    bodies = spark.createDataFrame([(f"https://s{i % 2}.example.com/{i}", "text") for i in range(6)], "canonical_url string, body string")
    monkeypatch.setattr(D.Pages.__init__, "__defaults__", (2,))
    done = run(spark, articles, [topic(1, ["solar"], 4)], page_bodies=bodies)
    counts = totals(done)
    assert (counts["fulltext_fetches"], counts["fulltext_recovery_budget_exhausted"], counts["selected"]) == (2, 2, 4)


def test_run_equals_the_walk_over_its_pools(spark, monkeypatch):
    """Pools as the digest makes them, reviewed one by one in Python with the scorer's rule written out."""
    held = {}
    original = D.review.review_run

    def kept(direct, limits, judge, twins, semantic=None, *rest):
        held["rows"] = [direct.collect(), semantic.collect()]
        held["limits"] = [(r.run_id, r.topic_id, r.topic_ord, r.article_limit) for r in limits.orderBy("topic_ord").collect()]
        return original(direct, limits, judge, twins, semantic, *rest)

    monkeypatch.setattr(D.review, "review_run", kept)
    _, past = new_and_past(spark, SF)
    done = D.digest(V.articles(spark, SF), V.topics(spark), V.sources(spark, SF), past, V.as_of(), days=3, fuzzy=False, scorer=_sample_scorer)
    titles = {r.article_id: r.title for r in V.articles(spark, SF).collect()}
    rows = []
    for part, direct in zip(held["rows"], (True, False), strict=True):
        for r in part:
            n = len(titles[r.article_id])
            score, relevant = (n % 101, n % 3 > 0) if n % 7 else (r.lexical_score, direct)
            fits = relevant and score >= r.supplement_threshold
            story = (r.norm_title, r.material) if len(r.norm_title) >= 12 else (r.canonical_url, r.norm_title)
            rows.append((r.run_id, r.topic_id, r.topic_ord, r.row_id, r.review_pos, r.article_limit, r.published_rank, story,
                         score + 1000 if fits else 0, fits, True, direct))
    reviewed, selected = walk(held["limits"], rows, 20, 15)
    assert sorted(r.row_id for r in done.selected.collect()) == sorted(selected)
    assert totals(done)["ai_requests"] == len(reviewed)


def test_nothing_to_review(spark, tmp_path):
    done = run(spark, [], [topic(1, ["solar"], 3)], scorer=scorer_with(tmp_path, {}))
    assert done.selected.count() == 0 and done.outcome.count() == 0 and calls(tmp_path) == []
    quiet = run(spark, [(1, "Other", "x")], [topic(1, ["solar"], 3)], scorer=scorer_with(tmp_path, {"Other": answer(5)}))
    assert quiet.outcome.first().outcome == "below_threshold" and len(calls(tmp_path)) == 1
