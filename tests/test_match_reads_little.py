"""What matching and ranking read: anchors in one pass, folded texts once, and keys only where positions are written."""

from pyspark.sql import functions as F

from newsops.functions import text
from newsops.operators import match, rank
from newsops.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TEXTS = ["onor", "xonor onor2 ónor", "a-b and c", "x 利率 y", "oand hnor", "an and", "and\nan", "", "c++ 5 $5 5b"]


def test_tokens_among_are_those_of_the_text(spark):
    sought = ["onor", "nor", "an", "and", "a", "5", "利", "+", "$", "h"]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    known = F.array(*[F.lit(s) for s in sought])
    got = df.select(
        F.array_sort(F.array_intersect(F.array_distinct(text.tokens_among("t", sought)), known)).alias("got"),
        F.array_sort(F.array_intersect(text.text_tokens("t"), known)).alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and any(r.want for r in got)


def test_few_and_many_anchors_give_the_same_evidence(spark, monkeypatch):
    rows = [(i, "s", t, "", t[::-1]) for i, t in enumerate(TEXTS)]
    articles = spark.createDataFrame(rows, "article_id int, source_id string, title string, excerpt string, full_text string")
    topics = spark.createDataFrame(
        [("t", "T", ["onor", "利率", "a b", "and"], ["5"], [])],
        "topic_id string, name string, keywords array<string>, exclusion_keywords array<string>, source_ids array<string>")
    out = []
    for most in (64, 0):
        monkeypatch.setattr(match, "MAX_SOUGHT", most)
        for literal in (100, 0):
            found = match.match_topics(articles, topics, keep_unmatched=True, literal_limit=literal)
            out.append(sorted((r.article_id, r.matched, tuple(r.matched_keywords), tuple(r.excluded_keywords), tuple(r.matched_fields)) for r in found.collect()))
    assert out[0] == out[1] == out[2] == out[3] and any(r[1] for r in out[0])


def test_folded_texts_are_made_once_by_the_anchor_route(spark, monkeypatch):
    made = []
    monkeypatch.setattr(match, "cut", lambda df, real=match.cut: made.append(df.columns) or real(df))
    QUERIES["keyword_evidence_anchor"](spark, SMALL)
    assert len(made) == 1 and "_full_text" in made[0] and "full_text" not in made[0]


def test_positions_are_written_without_texts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(rank, "cut", lambda df, real=rank.cut: written.append(df.columns) or real(df))
    QUERIES["round_robin_all"](spark, SMALL)
    assert written and not any({"full_text", "excerpt", "title"} & set(c) for c in written)
