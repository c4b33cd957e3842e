"""Near duplicates, line dedup and mixing against plain Python, and the pipeline's stages."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from newsops.llm import linededup, mixing, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def expected_components(rows, k, percent):
    """Row number -> least id of its component (all pairs)."""
    sets = [grams(text, k) for _, text in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(key, len(sets[i]), least.get(root(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def chained_copies():
    """Chains of near copies, a large group of mutual near copies, and documents that share a passage."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10_000)}"
    texts = []
    for _ in range(6):
        words = [word() for _ in range(120)]
        for _ in range(8):
            texts.append(" ".join(words))
            words[rng.randrange(120)] = word()
            words[rng.randrange(120)] = word()
    base = [word() for _ in range(150)]
    for _ in range(60):
        near = base[:]
        for _ in range(rng.randint(1, 5)):
            near[rng.randrange(150)] = word()
        texts.append(" ".join(near))
    passage = [word() for _ in range(60)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(3, 60))]) for _ in range(40)]
    texts += [t.upper() for t in texts[:5]] + texts[50:60]
    rng.shuffle(texts)
    return list(enumerate(texts, 1000))


def test_components_are_those_of_all_pairs(spark, odd_docs, odd_rows, no_docs):
    rows = chained_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 85), (5, 80)):
        got = neardup.near_duplicates(docs, shingle=k, percent=percent).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == sorted(expected_components(rows, k, percent))
    odd = neardup.near_duplicates(odd_docs, shingle=3, percent=85).select("doc_id", "n_shingles", "component_id").collect()
    want = expected_components([r[:2] for r in odd_rows], 3, 85)
    assert sorted(map(tuple, odd), key=repr) == sorted(want, key=repr)
    assert neardup.near_duplicates(no_docs).count() == 0


def test_one_document_of_a_group_stays(spark, odd_docs, odd_rows, no_docs):
    kept = neardup.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = defaultdict(list)
    for (key, _, component), row in zip(expected_components([r[:2] for r in odd_rows], 5, 80), odd_rows, strict=True):
        groups[component if grams(row[1], 5) else ("alone", key, row[1])].append(key)
    assert kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).count() == len([g for g in groups if not isinstance(g, tuple) and g is not None]) + sum(
        1 for r in odd_rows if grams(r[1], 5) and r[0] is None)
    assert neardup.drop_near_duplicates(no_docs).count() == 0


def test_sketch_coordinates_estimate_similarity():
    sketcher = neardup.Sketcher(3, 85)
    import numpy as np

    rng = np.random.default_rng(3)
    for n, share in ((1, 1.0), (2, 0.5), (5, 0.6), (60, 0.5), (600, 0.9)):
        errors = []
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, 2 * n).astype(np.uint64))
            a, b = x[:n], np.concatenate((x[: int(n * share)], x[n:n + n - int(n * share)]))
            true = int(n * share) / (2 * n - int(n * share))
            errors.append((sketcher.sketch(a) == sketcher.sketch(b)).mean() - true)
        assert abs(np.mean(errors)) < 0.04


UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
UNIT = re.compile(f"{UNSPACED.pattern}|[^\\x20\\x09-\\x0D{UNSPACED.pattern[1:-1]}]+")


def expected_dropped(rows):
    seen = defaultdict(list)
    for key, text in set(rows):
        for k, line in enumerate((text or "").split("\n")):
            units = tuple(UNIT.findall(line))
            if units:
                seen[units].append(((key is not None, key or 0), key, text, k))
    first = {w: min(x[0] for x in places) for w, places in seen.items()}

    def heavy(units):
        return sum(1 if UNSPACED.fullmatch(u) else 2 for u in units) >= 16

    def close(a, b):
        if a == b or not heavy(a) or not heavy(b) or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    gone = defaultdict(set)
    for words, places in seen.items():
        near = any(close(words, other) and first[other] < first[words] for other in first)
        places.sort(key=lambda x: (x[0], x[3]))
        for place in places:
            if near or place is not places[0]:
                gone[place[1:3]].add(place[3])
    return gone


def test_lines_go_when_an_earlier_line_is_within_one_unit(spark, odd_docs, no_docs):
    rng = random.Random(4)
    lines = [[f"w{rng.randrange(500)}" for _ in range(rng.randint(6, 30))] for _ in range(25)]
    rows = []
    for i in range(80):
        own = []
        for _ in range(4):
            line = rng.choice(lines)[:]
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(line))
                rng.choice((lambda: line.pop(at), lambda: line.insert(at, "x"), lambda: line.__setitem__(at, "y")))()
            own.append(rng.choice(("", "  ")) + "  ".join(line))
        rows.append((i, "\n".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.dropped_lines) for r in linededup.line_report(docs).collect()}
    want = expected_dropped(rows)
    assert got == {key: want.get((key, text), set()) for key, text in rows}
    left = {r.doc_id: r.text for r in linededup.drop_lines(docs).collect()}
    for key, text in rows:
        keep = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in got[key])
        assert left.get(key, "") == (keep if WORD.search(keep) else "")
    assert linededup.line_report(odd_docs).count() == odd_docs.count()
    dropped = linededup.drop_lines(odd_docs)
    assert dropped.columns == odd_docs.columns and dropped.where("text is null").count() == 1
    assert linededup.line_report(no_docs).count() == 0 and linededup.drop_lines(no_docs).count() == 0


def test_short_lines_and_scripts_without_spaces(spark):
    import corpus_pipeline

    rows = [
        (1, "Read more\n今天的天气非常好我们一起去公园散步吧\nfew words here\n短句"),
        (2, "Read  more\n今天的天气非常好我们一起去公园跑步吧\nfew words there\n短语"),
        (3, "วันนี้อากาศดีมากเราไปเดินเล่น\nRead more\n\nlast"), (4, "วันนี้อากาศดีมากเราไปเดินเล่น\n短句"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (set(r.dropped_lines), r.n_near) for r in linededup.line_report(docs).collect()}
    assert got == {1: (set(), 0), 2: ({0, 1}, 1), 3: ({1}, 0), 4: ({0, 1}, 0)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert left == {1: rows[0][1], 2: "few words there\n短语", 3: "วันนี้อากาศดีมากเราไปเดินเล่น\n\nlast"}


def test_within_one_unit():
    near = [("a b c", "a b c"), ("a b c", "a x c"), ("a b c", "a c"), ("b c", "a b c"), ("a b", "a b c")]
    far = [("a b c", "a c b"), ("a b c", "c"), ("a b c", "x b y"), ("a b", "b c a")]
    assert all(linededup.within_one_unit(*p) and linededup.within_one_unit(*p[::-1]) for p in near)
    assert not any(linededup.within_one_unit(*p) or linededup.within_one_unit(*p[::-1]) for p in far)


def expected_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, closed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in closed]
        rest = budget - sum(closed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 2.0 * sizes[s] for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return closed | share
        closed |= over


def test_mix_meets_its_targets(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice((3, 50, 50, 50, 7, 700, rng.randint(1, 300))), rng.choice("abcdefgg")) for i in range(900)]
    rows += [(i, "word " * 40, "a") for i in range(900, 1300)]                       # one very common length
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n)).drop("_key").collect())) for n in (2, 5)]
    assert runs[0] == runs[1]
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, taken = expected_targets(sizes), Counter()
    for _, size, source, source_size, target, copies in runs[0]:
        assert source_size == sizes[source] and abs(target - want[source]) < 1e-6 * max(1, target) and 0 <= copies <= 2
        taken[source] += size * copies
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    odd = mixing.mix(odd_docs).collect()
    assert len(odd) == len(odd_rows)
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = expected_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) for r in odd)
    made = mixing.apply_mix(odd_docs)
    assert made.columns == odd_docs.columns
    assert made.count() == sum(r.copies for r in odd)
    assert mixing.mix(no_docs).count() == 0 and mixing.apply_mix(no_docs).count() == 0


def test_fit_is_exact_where_a_subset_exists():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted({rng.randint(1, 40) for _ in range(6)})
        counts = [rng.randint(1, 6) for _ in lengths]
        whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
        budget = rng.randint(0, whole)
        taken = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        got = sum(n * t for n, t in zip(lengths, taken, strict=True))
        assert abs(got - budget) <= max(lengths)
    assert mixing.fit([7, 900_000], [10, 3], 900_014) in ([2, 1],)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "source mix", "bpe encoding"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert docs.columns[:2] == ["doc_id", "n_tokens"] and docs.count() > 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    import corpus_pipeline

    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, "").count() >= 0
