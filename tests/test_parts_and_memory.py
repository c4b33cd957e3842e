"""Byte-bounded parts with a manifest from the writer; fuzzy duplicate memory of a stream."""

import datetime as dt
import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from newsops.operators import match
from newsops.sources import files
from newsops.sources import store as S
from newsops.streaming import jobs

SCHEMA = "n int, text string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(i, "é" * rng.randint(0, 120)) for i in range(400)] + [(1000, "x" * 700), (1001, "x" * 5000), (1002, None), (1002, None)]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


def test_no_part_exceeds_the_bound_and_all_rows_come_once(spark, rows, tmp_path):
    path = str(tmp_path / "parts")
    manifest = files.write_bounded_parts(rows, path, [F.col("n")], max_bytes=1000)
    sizes = {p.name: sum(f.stat().st_size for f in p.glob("*.txt")) for p in Path(path).glob("part=*")}
    assert {f"part={r.part}": r.bytes for r in manifest.collect()} == sizes
    above = [name for name, size in sizes.items() if size > 1000]
    assert len(above) == 1 and above[0].startswith("part=single-")                   # the one row that no part can hold
    assert all(len(list(p.glob("*.txt"))) == 1 for p in Path(path).glob("part=*"))
    filled = sorted(size for name, size in sizes.items() if "part-" in name)
    assert sum(size < 250 for size in filled) <= 1                                   # cut every half bound, rows of up to a quarter
    back = files.read_bounded_parts(spark, path, manifest, SCHEMA, 1000)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
    order = [r.n for p in sorted(Path(path).glob("part=part-*")) for r in spark.read.text(str(p)).select(F.from_json("value", SCHEMA).alias("r")).select("r.n").collect()]
    assert order == sorted(order)


def test_broken_parts_are_told_apart(spark, rows, tmp_path):
    path = tmp_path / "parts"
    manifest = files.write_bounded_parts(rows, str(path), [F.col("n")], max_bytes=1000)
    lost, doubled, short, altered, copied = sorted(path.glob("part=part-*"))[:5]
    shutil.rmtree(lost)
    one = next(doubled.glob("*.txt"))
    shutil.copy(one, one.with_name("second.txt"))
    file = next(short.glob("*.txt"))
    file.write_bytes(b"".join(file.read_bytes().splitlines(keepends=True)[:-1]))
    file = next(altered.glob("*.txt"))
    file.write_bytes(file.read_bytes().replace(b'"n":', b'"m":', 1))
    shutil.copytree(copied, path / "part=part-999999999999")
    for crc in path.rglob(".*.crc"):
        crc.unlink()
    twice = manifest.unionByName(manifest.where(F.col("part") == copied.name.removeprefix("part=")))
    found = {(r.part, r.rule) for r in files.check_bounded_parts(twice, files.actual_bounded_parts(spark, str(path)), 1000).collect()}
    name = lambda p: p.name.removeprefix("part=")
    assert found == {
        (name(lost), "missing"), (name(doubled), "several files"), (name(doubled), "row count differs"), (name(short), "row count differs"),
        (name(altered), "content differs"), (name(copied), "listed twice"), ("part-999999999999", "not listed"),
    } | ({(name(doubled), "too many bytes")} if 2 * one.stat().st_size > 1000 else set())
    with pytest.raises(ValueError, match="do not match"):
        files.read_bounded_parts(spark, str(path), manifest, SCHEMA, 1000)


def test_no_rows_give_no_parts(spark, tmp_path):
    manifest = files.write_bounded_parts(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), [F.col("n")])
    assert manifest.count() == 0


ARTICLE = "article_id long, canonical_url string, norm_title string, material string, created_at timestamp"


def title(rng):
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(40))


def test_fuzzy_memory_equals_a_replay_and_forgets(spark, tmp_path):
    rng = random.Random(6)
    stories = [title(rng) for _ in range(6)]
    days, n = {}, 0
    for day in (1, 2, 9, 17):
        rows = []
        for _ in range(8):
            n += 1
            text = rng.choice(stories)
            if rng.random() < 0.5:
                at = rng.randrange(40)
                text = text[:at] + rng.choice("xyz") + text[at + 1:]
            rows.append((n, f"https://example.com/{n}", text, "m", dt.datetime(2024, 1, day, 10)))
        days[day] = rows
    kept, replayed = [], []
    for day, rows in days.items():                                     # the batch operators on plain frames, day by day
        batch = spark.createDataFrame(rows, ARTICLE)
        fresh = jobs.fuzzy_batch(batch, spark.createDataFrame(kept, ARTICLE), F.lit(rows[0][4]))
        got = jobs.dedup.keep_first(fresh, "article_id", [F.col("created_at"), F.col("article_id")]).where("is_kept").select(*batch.columns).collect()
        kept += [tuple(r) for r in got]
        replayed += [(r.article_id, day) for r in got]
    assert {d for _, d in replayed} >= {1, 9, 17}                      # stories come back once they are forgotten
    schemas = {"memory": ARTICLE, "kept": ARTICLE + ", batch_id long"}
    store = S.Store(spark, str(tmp_path / "store"), schemas, {"memory": "created_at", "kept": "created_at"})
    for rows in days.values():
        spark.createDataFrame(rows, ARTICLE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.fuzzy_dedup_batches(stream, store, str(tmp_path / "check")).awaitTermination()
    assert sorted((r.article_id, r.created_at.day) for r in store.read("kept").collect()) == sorted(replayed)
    assert {r.day.day for r in store.live("memory")} <= {17}    # what is past the memory is no longer live
    assert sorted(r.batch_id for r in store.read("kept").select("batch_id").distinct().collect()) == list(range(len(days)))


def test_no_topics_match_nothing(spark):
    none = spark.createDataFrame([], "topic_id string, name string, keywords array<string>, exclusion_keywords array<string>, source_ids array<string>")
    articles = spark.createDataFrame([(1, "s", "title", "", "")], "article_id long, source_id string, title string, excerpt string, full_text string")
    for keep in (False, True):
        found = match.match_topics(articles, none, keep_unmatched=keep)
        assert found.count() == 0 and "matched_keywords" in found.columns
