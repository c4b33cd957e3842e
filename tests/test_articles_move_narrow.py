"""What of an article moves between tasks: its text only where it is asked for, and then once; sources are known to be few."""

from newsops.queries import views as V
from newsops.queries.matching import _fresh_live

SF = "/root/testdata/sf0.001"


def moved(df):
    """Names of the columns of every shuffle, one set each."""
    def walk(node):
        if node.nodeName() == "Exchange":
            yield {node.output().apply(i).name() for i in range(node.output().size())}
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


def shuffled(spark, make):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")      # large tables, as the joins see them
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return moved(make())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_titles_move_without_their_texts(spark):
    found = shuffled(spark, lambda: V.fingerprints(V.articles(spark, SF).drop("full_text", "excerpt")))
    assert found and not [names for names in found if names & {"text", "full_text", "excerpt"}]


def test_texts_move_once(spark):
    found = shuffled(spark, lambda: _fresh_live(spark, SF))
    assert len([names for names in found if names & {"text", "full_text"}]) == 1


def test_dates_are_those_of_every_step_th_event(spark):
    docs, events = V.table(spark, SF, "documents"), V.table(spark, SF, "events")
    step = max(1, events.count() // docs.count())
    times = {r.event_id: r.ts.replace(microsecond=0) for r in events.collect()}
    for r in V.articles(spark, SF).select("article_id", "created_at").collect():
        assert r.created_at == times.get(r.article_id * step)
