"""The corpus pipeline, stage by stage, against plain Python over what the stage before wrote."""

import hashlib
import random
from collections import Counter, defaultdict

from test_duplicates import WORD, expected_components, expected_dropped, expected_targets
from test_texts import expected_figures

SOURCES = ("a", "b", None)


def corpus():
    """Boilerplate over a host, depleted and failing documents, repeated and nearly repeated lines, copies and near copies."""
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(5000)}"
    line = lambda n: " ".join(word() for _ in range(n))
    banner, shared = line(12), [line(14) for _ in range(4)]
    texts = []
    for i in range(36):
        own = [line(rng.randint(9, 20)) for _ in range(rng.randint(5, 9))]
        if i < 26:
            own.insert(0, banner)
        if i % 3 == 0:
            own.append(rng.choice(shared))
        if i % 4 == 0:
            words = rng.choice(shared).split()
            words[rng.randrange(14)] = "changed"
            own.append(" ".join(words))
        texts.append("\n".join(own))
    rows = [(i, t, "en", "a" if i < 26 else SOURCES[i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, rows[30 + i][1], "en", "b", 1) for i in range(4)]                              # copies
    rows += [(200 + i, rows[26 + i][1] + " one more", "en", None, 1) for i in range(4)]               # near copies
    rows += [(300, None, "en", "b", None), (301, "", None, "b", 0), (302, "too short", "en", "b", 9), (303, banner + "\n" + line(8), "en", "a", 1)]
    rows += [(304, "again and again " * 60, "en", "b", 1), rows[31]]
    return rows


def after_quality(rows):
    hosts = defaultdict(set)
    held = defaultdict(set)
    for _, text, _, source, _ in rows:
        hosts[source or ""].add(text)
        for x in (text or "").split("\n"):
            if WORD.search(x):
                held[source or "", " ".join(WORD.findall(x))].add(text)
    often = {k for k, v in held.items() if len(v) >= 20 and len(v) > 0.01 * len(hosts[k[0]])}
    out = []
    for row in rows:
        n, *_, repeated = expected_figures(row[1])
        lines = (row[1] or "").split("\n")
        gone = [(row[3] or "", " ".join(WORD.findall(x))) in often for x in lines]
        lost = sum(len(WORD.findall(x)) for x, g in zip(lines, gone, strict=True) if g)
        if n >= 50 and 100 * repeated <= 50 * n and n - lost >= 0.3 * n:
            out.append((row[0], "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out, often


def test_pipeline_equals_plain_python(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers as P
    import tiktoken

    from newsops.llm import bpe

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    written = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        written.append(docs.collect())
    quality, lines, near, mixed, coded = written

    want, often = after_quality(rows)
    assert often and sorted((r.doc_id, r.text) for r in quality) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in quality)

    before = [(r.doc_id, r.text) for r in quality]
    gone = expected_dropped(before)
    want = []
    for key, text in before:
        left = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone.get((key, text), ()))
        if WORD.search(left):
            want.append((key, left))
    assert gone and sorted((r.doc_id, r.text) for r in lines) == sorted(want)

    before = [(r.doc_id, r.text) for r in lines]
    first = {key for key, _, component in expected_components(before, 5, 80) if key == component}
    assert sorted(r.doc_id for r in near) == sorted(first) and {(r.doc_id, r.text) for r in near} <= set(before)

    size = lambda text: len(WORD.findall(text or ""))
    sizes, got, copies = Counter(), Counter(), Counter(r.doc_id for r in mixed)
    for r in near:
        sizes[r.source] += size(r.text)
        got[r.source] += size(r.text) * copies[r.doc_id]
    targets = expected_targets(dict(sizes))
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in near}
    longest = max(size(r.text) for r in near)
    assert all(abs(got[s] - targets[s]) <= longest for s in sizes)

    tokens = {t: i for i, t in enumerate(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens, special_tokens={})
    want = []
    for r in mixed:
        ids = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(tuple(r)[:4] for r in coded) == sorted(want)
