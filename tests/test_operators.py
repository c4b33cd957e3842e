"""Operators against brute force or hand-made expectations on small fixtures."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from newsops.functions.similarity import changes_content
from newsops.operators import dedup, funnel, history, match, merge, rank, validate
from newsops.sources import feeds, files, pages

TOPICS = "topic_id string, topic_ord int, name string, keywords array<string>, exclusion_keywords array<string>, " \
         "threshold int, article_limit int, source_ids array<string>, enabled boolean, archived boolean"


def topics(spark):
    return spark.createDataFrame([
        ("a", 1, "Alpha", ["air pump", "Straße", "芯片"], ["spam"], None, None, [], True, False),
        ("b", 2, "bridge", [], [], None, None, ["s1", "gone"], True, False),
        ("c", 3, "off", ["air"], [], None, None, ["gone"], True, False),
    ], TOPICS)


def test_match_evidence_and_both_routes(spark):
    rows = [
        (1, "s1", "New AIR-pump", "on the strasse", "", ), (2, "s1", "repair pumps", "", "air  pump and spam"),
        (3, "s2", "国产芯片量产", "", ""), (4, "s2", "Bridge", "", ""), (5, "s1", "A bridge", None, "footbridge"), (6, "s1", "chair pump", "", ""),
    ]
    df = spark.createDataFrame(rows, "article_id long, source_id string, title string, excerpt string, full_text string")
    expect = {
        ("a", 1): (True, ["air pump", "Straße"], ["title", "excerpt"], [], 58 + 14 + 8), ("a", 2): (False, ["air pump"], ["full_text"], ["spam"], 65),
        ("a", 3): (True, ["芯片"], ["title"], [], 73), ("b", 5): (True, ["bridge"], ["title"], [], 73),
    }
    for limit in (1000, 1):
        got = match.match_topics(df, topics(spark), literal_limit=limit).withColumn("s", match.keyword_score())
        assert {
            (r.topic_id, r.article_id): (r.matched, r.matched_keywords, r.matched_fields, r.excluded_keywords, r.s) for r in got.collect()
        } == expect
        pairs = match.match_topics(df, topics(spark), keep_unmatched=True, literal_limit=limit)
        assert pairs.count() == 6 + 4                     # a: every article, b: source s1 only, c: nothing left


def _sequential(rows):
    kept, verdict = [], {}
    for key, url, title, material in rows:
        dup = None
        for k in kept:
            _, k_url, k_title, k_material = k
            if k_url == url and k_title == title:
                dup = k
            elif title and k_title and k_material == material:
                if k_url == url and SequenceMatcher(None, k_title, title, False).ratio() >= 0.88 and not changes_content(k_title, title):
                    dup = k
                elif min(len(title), len(k_title)) >= 12:
                    size = sorted((len(title), len(k_title)))
                    inside = title in k_title or k_title in title
                    if title == k_title or (size[0] / size[1] >= 0.78 and inside) or (
                        size[0] / size[1] >= 0.75 and SequenceMatcher(None, k_title, title, False).ratio() >= 0.9
                    ):
                        dup = k
            if dup:
                break
        verdict[key] = (dup is None, dup and dup[0])
        if dup is None:
            kept.append((key, url, title, material))
    return verdict


def _noisy_rows(seed, n):
    rng = random.Random(seed)
    letters = "abcdefghijklmnop"
    stems = ["".join(rng.choice(letters) for _ in range(rng.choice([8, 14, 30, 60, 120]))) for _ in range(6)]
    rows = []
    for i in range(n):
        title = list(stems[0] if rng.random() < 0.4 else rng.choice(stems))     # one stem holds a large share
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            at = rng.randrange(len(title))
            action = rng.random()
            if action < 0.4:
                title[at] = rng.choice(letters)
            elif action < 0.7:
                title.insert(at, rng.choice(letters))
            elif len(title) > 3:
                del title[at]
        rows.append((i, f"https://u/{rng.randrange(n // 3)}", "".join(title) if rng.random() > 0.03 else "", rng.choice(["", "", "x"])))
    return rows


FP = "id long, canonical_url string, norm_title string, material string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keep_first_equals_sequential_pass(spark, seed):
    rows = _noisy_rows(seed, 60)
    if seed == 3:                                          # NULL parts count as empty
        rows = [(i, None if i % 7 == 0 else u, None if i % 11 == 0 else t, None if i % 2 else m) for i, u, t, m in rows]
    df = spark.createDataFrame(rows, FP).repartition(3)
    got = {r.id: (r.is_kept, r.duplicate_of) for r in dedup.keep_first(df, "id", [F.col("id")]).collect()}
    assert got == _sequential([(i, u or "", t or "", m or "") for i, u, t, m in rows])


def test_keep_first_on_one_crowded_url(spark):
    """20,000 different titles on one URL, and 3,000 that repeat one of them nearly."""
    words = [f"{i:x}" for i in range(0x1000, 0x9000)]
    rng = random.Random(3)
    rows = [(i, "https://u", "".join(rng.sample(words, 6)), "") for i in range(20_000)]
    rows += [(i, "https://u", rows[i - 20_000][2] + "x", "") for i in range(20_000, 23_000)]
    got = dedup.keep_first(spark.createDataFrame(rows, FP), "id", [F.col("id")]).groupBy("is_kept").count().collect()
    assert {r.is_kept: r["count"] for r in got} == {True: 20_000, False: 3_000}


def test_history_duplicates_equal_brute_force(spark):
    rows = _noisy_rows(7, 80)
    past, new = rows[:40], rows[40:]
    expect = {r[0] for r in new if not _sequential_against(past, r)}
    df, old = spark.createDataFrame(new, FP), spark.createDataFrame(past, FP)
    assert {r.id for r in dedup.history_duplicates(df, old, "id").collect()} == expect


def _sequential_against(past, row):
    """True when the row is new against every past row (no in-run hash rule)."""
    _, url, title, material = row
    if not title:
        return True
    for _, k_url, k_title, k_material in past:
        if not k_title or k_material != material:
            continue
        if k_url == url and (k_title == title or (
            SequenceMatcher(None, k_title, title, False).ratio() >= 0.88 and not changes_content(k_title, title)
        )):
            return False
        if min(len(title), len(k_title)) >= 12:
            low, high = sorted((len(title), len(k_title)))
            if title == k_title or (low / high >= 0.78 and (title in k_title or k_title in title)) or (
                low / high >= 0.75 and SequenceMatcher(None, k_title, title, False).ratio() >= 0.9
            ):
                return False
    return True


def test_distributed_position_equals_window(spark):
    rows = [("hot" if i % 3 else "cold", (i * 37) % 101, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(5)
    got = {r.i: r.position for r in rank.distributed_position(df, ["k"], [F.col("v").desc(), F.col("i")]).collect()}
    expect = {}
    for key in ("hot", "cold"):
        for n, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            expect[row[2]] = n
    assert got == expect


def test_selection_takes_turns_and_shares_no_article(spark):
    cols = "run_id string, topic_id string, topic_ord int, article_id long, canonical_url string, norm_title string, material string, " \
           "review_pos int, score int, published_rank double, qualifies boolean, article_limit int"
    rows = []
    for topic, order in (("a", 1), ("b", 2)):
        for i, (art, sc) in enumerate([(1, 90), (2 + order * 10, 80), (3 + order * 10, 70), (4 + order * 10, 20)], 1):
            rows.append(("r", topic, order, art, f"https://u/{art}", f"title number {art} in long form".replace(" ", ""), str(art), i, sc, 1.0, sc >= 45, 2))
    got = rank.select_for_run(spark.createDataFrame(rows, cols)).collect()
    chosen = {t: [r.article_id for r in sorted(got, key=lambda r: r.rank) if r.topic_id == t and r.status == "selected"] for t in "ab"}
    # topic a takes the shared best article, topic b its own next two
    assert chosen == {"a": [1, 12], "b": [22, 23]}


def test_funnel_outcome_ladder(spark):
    base = dict.fromkeys(funnel.OUTCOME_INPUTS, 0)
    cases = [
        ({"selected": 1}, "complete"), ({}, "no_fresh_articles"), ({"feed_items": 5}, "no_fresh_articles"),
        ({"feed_items": 5, "fresh": 5, "keyword_hits": 2, "ai_success": 2, "ai_irrelevant": 2}, "no_relevant_after_ai"),
        ({"feed_items": 5, "fresh": 5}, "no_keyword_match"),
        ({"feed_items": 5, "fresh": 5, "keyword_hits": 2, "duplicates_skipped": 2}, "no_new_after_dedup"),
        ({"feed_items": 5, "fresh": 5, "keyword_hits": 2, "unique_candidates": 2, "threshold_rejected": 1}, "below_threshold"),
        ({"feed_items": 5, "fresh": 5, "keyword_hits": 2, "unique_candidates": 1}, "no_keyword_match"),
    ]
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], ["i", *base])
    assert [r.o for r in df.select("i", funnel.outcome().alias("o")).orderBy("i").collect()] == [o for _, o in cases]


def test_merge_twice_adds_nothing(spark):
    cols = "id string, run_id string, topic_id string, source_id string, content_hash string, created_at string, favorite boolean"
    local = spark.createDataFrame([("1", "r", "t", "s", "h1", "d1", False), ("2", "r", "t", "s", "h2", "d1", True)], cols)
    incoming = spark.createDataFrame([
        ("9", "r", "t", "s", "h1", "d0", True), ("1", "r", "t", "s", "h3", "d0", False), ("8", "r", "t", "s", "h3", "d2", True),
    ], cols)
    once = merge.merge_articles(incoming, local)
    assert {(r.content_hash, r.state, r.favorite, r.flipped) for r in once.collect()} == {
        ("h1", "matched", True, True), ("h2", "local", True, False), ("h3", "new", True, False)}
    assert once.select("id").distinct().count() == 3
    again = merge.merge_articles(incoming, once.drop("state", "flipped"))
    assert again.where("state = 'new' OR flipped").count() == 0


def test_run_remap_is_stable(spark):
    cols = "run_id string, status string, outcome string, started_at string, finished_at string"
    local = spark.createDataFrame([("r1", "complete", "x", "1", "2"), ("r2", "complete", "x", "1", "2")], cols)
    inc = spark.createDataFrame([("r1", "complete", "x", "1", "2"), ("r2", "failed", "x", "1", "2"), ("r3", "complete", "x", "1", None)], cols)
    first = {r.run_id: (r.local_id, r.state) for r in merge.match_runs(inc, local).collect()}
    assert [first[k][1] for k in ("r1", "r2", "r3")] == ["matched", "remapped", "new"]
    moved = spark.createDataFrame([(first["r2"][0], "failed", "x", "1", "2"), ("r3", "complete", "x", "1", None)], cols)
    second = {r.run_id: (r.local_id, r.state) for r in merge.match_runs(inc, local.unionByName(moved)).collect()}
    assert all(s == "matched" for _, s in second.values()) and second["r2"][0] == first["r2"][0]


def test_unfinished_runs_and_ids(spark):
    df = spark.createDataFrame([("con.x",), ("ok-1",), ("../x",), ("",), (None,)], "v string")
    assert [bool(r[0]) for r in df.select(validate.is_safe_id("v")).collect()] == [False, True, False, False, False]
    runs = spark.createDataFrame([("running", None, "s", None), ("complete", "complete", "s", "f")],
                                 "status string, outcome string, started_at string, finished_at string")
    assert [tuple(r) for r in validate.close_unfinished(runs).select("status", "outcome", "finished_at").collect()] == [
        ("failed", "interrupted", "s"), ("complete", "complete", "f")]


def test_feeds(spark):
    item = "<item><title>T{0} &amp;amp; more</title><link>https://f.example/a/{0}</link><description>&lt;b&gt;d&lt;/b&gt;</description><pubDate>{1}</pubDate></item>"
    good = "<rss version='2.0'><channel>" + "".join(item.format(i, "Fri, 09 May 2031 10:00:00 GMT") for i in range(105)) + "</channel></rss>"
    atom = ("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>E</title><link rel='self' href='https://x.example/s'/>"
            "<link href='https://x.example/e'/><updated>2031-05-09T00:00:00Z</updated></entry></feed>")
    old = "<rss><channel>" + item.format(1, "Fri, 09 May 2003 10:00:00 GMT") + "</channel></rss>"
    undated = "<rss><channel>" + item.format(1, "") + "</channel></rss>"
    rows = [(f"https://f.example/{k}", k, k, v) for k, v in
            {"good": good, "atom": atom, "old": old, "undated": undated, "html": "<html><body>no</body></html>"}.items()]
    df = spark.createDataFrame(rows, "feed_url string, source_id string, source_name string, document string")
    arts = feeds.feed_articles(df)
    assert {(r.source_id, r["count"]) for r in arts.groupBy("source_id").count().collect()} == {("good", 100), ("atom", 1), ("old", 1), ("undated", 1)}
    first = arts.where("source_id = 'good' AND pos = 0").first()
    assert (first.title, first.url, first.excerpt) == ("T0 & more", "https://f.example/a/0", "d")
    assert arts.where("source_id = 'atom'").first().url == "https://x.example/e"
    assert [r.source_id for r in feeds.feed_errors(df, arts).collect()] == ["html"]
    health = {r.feed_url[18:]: r for r in feeds.feed_health(df, F.lit("2031-05-10").cast("timestamp")).collect()}
    assert health["good"].ok and health["atom"].ok and health["good"].entries == 105 and health["good"].sample_size == 20
    assert health["old"].errors == ["latest entry too old"] and "entry without date" in health["undated"].errors
    assert health["html"].errors[:2] == ["not a recognized feed", "no entries"]


def test_page_paragraphs():
    page = ("<body><p>outside text</p><nav><p>menu</p></nav><article><p>Eins <b>zwei</b><br>drei</p><aside><p>ad</p></aside>"
            "<p>tail<script>x()</script></p></article></body>")
    assert pages.paragraphs_of(page) == ["Eins zwei drei", "tail"]
    assert pages.paragraphs_of("plain") == []


def test_parts_and_artifacts(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "'t' AS full_text")
    manifest = files.write_parts(df.repartition(2), str(tmp_path / "parts"), 10)
    assert files.reconcile_parts(manifest, files.actual_parts(spark, str(tmp_path / "parts"))).isEmpty()
    wrong = manifest.withColumn("rows", F.col("rows") + 1).unionByName(spark.createDataFrame([("lost", 3)], "part string, rows long"))
    rules = {r.rule for r in files.reconcile_parts(wrong, manifest).collect()}
    assert rules == {"row count differs", "missing"}
    target = files.write_artifact(df, str(tmp_path), "r1")
    assert "full_text" not in spark.read.json(target).columns
    with pytest.raises(Exception):
        files.write_artifact(df, str(tmp_path), "r1")


def test_search_after_pages_like_offset(spark):
    rows = [(i, f"t{i}", "", "", "", "t", "s", f"2031-01-{1 + i % 9:02d}", i % 4, False) for i in range(30)]
    arts = spark.createDataFrame(rows, "id int, title string, excerpt string, summary string, analysis string, topic_id string, "
                                       "source_id string, created_at string, score int, favorite boolean")
    tdim, sdim = spark.createDataFrame([("t", "T")], "topic_id string, name string"), spark.createDataFrame([("s", "S")], "source_id string, name string")
    page1 = history.search(arts, tdim, sdim, limit=7).collect()
    last = page1[-1]
    page2 = history.search_after(arts, tdim, sdim, (last.created_at, last.score, last.id), limit=7).collect()
    assert [r.id for r in page2] == [r.id for r in history.search(arts, tdim, sdim, limit=7, offset=7).collect()]


def test_scorer_is_asked_once_and_its_failure_is_the_rule(spark, tmp_path):
    import json

    import pandas as pd

    from newsops.operators import score

    log = str(tmp_path)

    def scorer(frames):
        for frame in frames:
            for key in frame["cache_key"]:
                with open(f"{log}/{key}", "a") as out:
                    out.write("x")
            if frame["title"].str.contains("boom").any():
                raise OSError("no answer")
            yield pd.DataFrame({"cache_key": frame["cache_key"], "raw": [
                "?" if "bad" in t else json.dumps({"score": 7, "summary": "s", "analysis": "a", "relevant": False, "reason": "off_topic"})
                for t in frame["title"]]})

    rows = [("r", f"k{i}", "boom" if i == 3 else "bad" if i == 4 else f"t{i}", "", "", 50, True) for i in range(8)]
    df = spark.createDataFrame(rows, "run_id string, cache_key string, title string, excerpt string, full_text string, "
                                     "lexical_score int, literal_match boolean").repartition(8, "cache_key")
    cache = spark.createDataFrame([], "cache_key string, analysis string, created_at timestamp, expires_at timestamp")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        done = score.score_with_cache(df, cache, F.current_timestamp(), scorer, order=[F.col("cache_key")], cap=6)
        got = {r.cache_key: (r.score, r.analysis_mode, r.ai_status) for r in done.collect()}
        report = score.scorer_report(done).first()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got["k0"] == (7, "ai", "success") and got["k3"] == (50, "rules_fallback", "failure")
    assert got["k4"] == (50, "rules_fallback", "invalid") and got["k7"] == (50, "rules_fallback", "over_cap")
    calls = {f"k{i}": len((tmp_path / f"k{i}").read_text()) if (tmp_path / f"k{i}").exists() else 0 for i in range(8)}
    assert calls == {"k0": 1, "k1": 1, "k2": 1, "k3": 1, "k4": 2, "k5": 1, "k6": 0, "k7": 0}
    assert (report.ai_requests, report.ai_success, report.ai_failure, report.ai_over_cap, report.degraded) == (6, 4, 2, 2, True)


def test_a_row_limit_above_the_bound_is_an_error(spark):
    df = spark.range(150).selectExpr("'g' AS g", "id", "150 AS n")
    with pytest.raises(Exception, match="at most 100"):
        rank.top_per_group(df, ["g"], [F.col("id")], F.col("n")).collect()


def test_presets_meet_one_source_each(spark):
    from newsops.operators import catalog

    cols = "source_id string, name string, url string, language string, preset_id string, user_modified boolean"
    sources = spark.createDataFrame([("s1", "S", "u2", "en", "p1", False)], cols)
    presets = spark.createDataFrame([("p1", "P1", "u1", "en"), ("p2", "P2", "u2", "en")], "id string, name string, url string, language string")
    got = {(r.source_id, r.action) for r in catalog.sync_presets(sources, presets, 2).collect()}
    assert got == {("s1", "updated"), ("p2", "inserted")}


def test_extension_elements_stay_apart(spark):
    rss = ("<rss xmlns:media='m' xmlns:content='c'><channel><item><title>Real title</title><media:title>Photo credit</media:title>"
           "<link>https://f.example/1</link><description>d</description><content:encoded><![CDATA[<p>a <x:y>b</x:y></p>]]></content:encoded></item></channel></rss>")
    atom = ("<a:feed xmlns:a='http://www.w3.org/2005/Atom'><a:entry><a:title>E</a:title><a:link href='https://x.example/e'/>"
            "<a:updated>2031-05-09T00:00:00Z</a:updated></a:entry></a:feed>")
    df = spark.createDataFrame([("https://f.example/r", "r", "r", rss), ("https://f.example/a", "a", "a", atom)],
                               "feed_url string, source_id string, source_name string, document string")
    got = {r.source_id: (r.title, r.full_text) for r in feeds.feed_articles(df.unionByName(df)).collect()}
    assert got == {"r": ("Real title", "a b"), "a": ("E", "")}
    assert feeds.feed_articles(df.unionByName(df)).count() == 4


def test_bundle_of_version_two_names_runs_and_topics(spark):
    sources = spark.createDataFrame([("s", "S", "https://s.example", "true", "false", "false")],
                                    "source_id string, name string, url string, enabled string, archived string, user_modified string")
    topics_df = spark.createDataFrame([("t", "T", "50", "10", "true", "false", ["s"])],
                                      "topic_id string, name string, threshold string, article_limit string, enabled string, archived string, source_ids array<string>")
    runs = spark.createDataFrame([("r", "complete", "1", "", "", ["t", "gone"])],
                                 "run_id string, status string, article_count string, warning string, error string, topic_ids array<string>")
    cols = "id string, run_id string, topic_id string, source_id string, title string, url string, excerpt string, summary string, analysis string, score string, favorite string"
    articles = spark.createDataFrame([("a", "r", "t", "s", "T", "https://x.example", "", "", "", "5", "0"), ("b", " ", "t", "s", "T", "https://x.example", "", "", "", "5", "0")], cols)
    found = lambda v: {(r.entity, r.id, r.rule) for r in validate.validate_bundle(sources, topics_df, runs, articles.withColumn("run_id", F.trim("run_id")), v).collect()}
    assert found(1) == {("run", "r", "unknown topic_id")}
    assert found(2) == {("run", "r", "unknown topic_id"), ("article", "b", "run_id is empty")}
