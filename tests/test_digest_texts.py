"""A run without a scorer: candidates go through its steps without their texts, and what is selected has them."""

from newsops.plans import digest as D
from newsops.queries import views as V

SF = "/root/testdata/sf0.001"


def test_candidates_are_narrow_and_selected_rows_whole(spark, monkeypatch):
    went = []
    plain = D.same_hash

    def watched(rows, *more):
        went.append(set(rows.columns))
        return plain(rows, *more)

    monkeypatch.setattr(D, "same_hash", watched)
    run = D.digest(V.articles(spark, SF), V.topics(spark), V.sources(spark, SF), None, V.as_of(), days=30, fuzzy=False)
    rows = run.selected.select("article_id", "title", "excerpt", "full_text").distinct().collect()
    assert went and not went[0] & {"excerpt", "full_text"}
    given = {r.article_id: r for r in V.articles(spark, SF).collect()}
    assert rows and all((r.title, r.excerpt, r.full_text) == tuple(given[r.article_id][c] for c in ("title", "excerpt", "full_text")) for r in rows)
