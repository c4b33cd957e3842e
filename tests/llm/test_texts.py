"""BPE, fingerprints, quality rules and language identification against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newsops.llm import bpe, fingerprint, langid, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_content(rows):
    return sorted(rows, key=repr)


def test_bpe_equals_the_library(spark, odd_docs, odd_rows, no_docs):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digest(odd_docs, path, P.PATTERN).collect()]
    want = []
    for row in odd_rows:
        ids = own.encode_ordinary(row[1] or "")
        want.append((row[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert by_content(got) == by_content(want)
    assert bpe.digest(no_docs, path, P.PATTERN).count() == 0
    kept = bpe.decode(bpe.encode(odd_docs, path, P.PATTERN), path)
    assert set(odd_docs.columns) | {"decoded"} == set(kept.columns)          # ids is replaced
    assert kept.where(F.col("decoded") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0


def test_bpe_every_character_and_odd_runs():
    import public_tokenizers as P
    import regex
    import tiktoken

    tokens = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    encoder, split = bpe.Encoder(tokens, bpe.build_model(tokens)), regex.compile(P.PATTERN)
    for code in [*range(0, 0x3000), *range(0x3000, 0xD800, 7), *range(0xE000, 0x20000, 13)]:
        text = f"a{chr(code)}b 1{chr(code)} {chr(code)}{chr(code)}"
        ids = b"".join(encoder[m] for m in split.findall(text))
        assert [int.from_bytes(ids[i:i + 4], "little") for i in range(0, len(ids), 4)] == own.encode_ordinary(text)


def test_fingerprints(spark, odd_docs, odd_rows, no_docs):
    got = fingerprint.edited_fingerprints(odd_docs).collect()
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    want, sketcher = [], fingerprint.Sketcher()
    for i, row in enumerate(order):
        text, after = row[1] or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        new = text[: len(text) - cut] + after[:cut]
        prints = [sketcher.fingerprint(t) for t in (text, new, after)]
        want.append((row[0], len(text), hashlib.sha256(new.encode()).hexdigest(), prints[0].hex(), prints[1].hex(),
                     fingerprint.likeness(*prints[:2]), fingerprint.likeness(prints[0], prints[2])))
    assert by_content(map(tuple, got)) == by_content(want)
    assert fingerprint.edited_fingerprints(no_docs).count() == 0
    alone = fingerprint.edited_fingerprints(odd_docs.where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_likeness_is_near_the_similarity():
    import random

    rng, sketcher, errors = random.Random(1), fingerprint.Sketcher(), []
    for _ in range(60):
        words = [str(rng.random()) for _ in range(400)]
        share = rng.random()
        other = words[: int(400 * share)] + [str(rng.random()) for _ in range(400 - int(400 * share))]
        grams = [{tuple(w[i:i + 5]) for i in range(396)} for w in (words, other)]
        true = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
        errors.append(abs(true - fingerprint.likeness(*[sketcher.fingerprint(" ".join(w)) for w in (words, other)])))
    assert sum(errors) / len(errors) < 0.04 and max(errors) < 0.15


def expected_figures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_figures_and_verdicts(spark, odd_docs, odd_rows, no_docs):
    rows = quality.verdicts(quality.figures(odd_docs)).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    assert by_content(got) == by_content((r[0], *expected_figures(r[1])) for r in odd_rows)
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.verdicts(quality.figures(no_docs)).count() == 0
    assert quality.apply_rules(no_docs).columns == no_docs.columns


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    common, rare = " ".join(f"c{i}" for i in range(40)), lambda i, n: " ".join(f"w{i}.{k}" for k in range(n))
    rows = [(i, f"{common}\n{rare(i, 60)}" if i < 30 else f"{common}\n{rare(i, 12)}" if i < 35 else rare(i, 60), "en", "s", 0) for i in range(60)]
    rows += [(100 + i, rare(7, 60), "en", "s", 0) for i in range(40)]           # copies of one document count once
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    assert set(kept) == {i for i, *_ in rows} - {30, 31, 32, 33, 34}
    assert all(common not in r.text and r.n_chars == len(r.text) for r in kept.values() if r.doc_id < 30)


def test_language_is_learned_from_the_other_two_thirds(spark, odd_docs, no_docs):
    import random
    import zlib

    rng, rows = random.Random(2), []
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "éèçàùabc"}
    for i in range(300):
        lang = rng.choice(list(letters))
        rows.append((i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(30)), lang))
    rows += [(900, None, "aa"), (901, "123 !?", "aa"), (902, "", None), (None, "abc abc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, text, lang in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert got[i].lang_pred == lang and 0 <= got[i].score <= 1
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert langid.identify(odd_docs).count() == odd_docs.count()
    assert langid.identify(no_docs).count() == 0
    unlabelled = langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]
    pred = defaultdict(set)
    for r in langid.identify(docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) != 1, F.col("lang")))).collect():
        pred[r.doc_id].add(r.lang_pred)
    assert all(pred[i] == {got[i].lang_pred} for i in range(300))               # held-out labels play no part


@pytest.mark.parametrize("text", ["a" * 200_000, "ab " * 100_000])
def test_very_long_words_and_texts(text):
    from newsops.llm.hashing import Words

    starts, ends, hashes = Words()(text.encode())
    assert [(a, b) for a, b in zip(starts, ends, strict=True)] == [m.span() for m in WORD.finditer(text)]
    assert len(set(hashes.tolist())) == len(set(text.split()))
