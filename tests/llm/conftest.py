import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    *[T.StructField(c, T.StringType()) for c in ("_key", "size", "fingerprint", "kept", "ids", "h", "node", "component_id")],
])


def sentence(rng, n):
    return " ".join(rng.choice(("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi "
                                "rho sigma tau upsilon phi chi psi omega éa öb ñc").split()) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empties, white space, copies, near copies, ties and a very long text."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(60, 160)) for _ in range(12)]
    texts = [None, "", " \n\t ", "one", "one two", "#$% <x> | &", *base, base[0], base[0], base[1]]
    for text in base[:6]:
        words = text.split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    lines = [sentence(rng, 12) for _ in range(6)]
    texts.append("\n".join(lines))
    texts.append("\n".join([lines[0] + " more", lines[1].replace(" ", "  "), "new " + lines[2], sentence(rng, 60)]))
    texts.append("\n".join(["short line", "short line", lines[3], *[sentence(rng, 20)] * 3]))
    texts.append(sentence(rng, 40_000))
    texts.append("word " * 300)
    rows = []
    for i, text in enumerate(texts):
        source = [None, "", "a", "b", "B", "é"][i % 6]
        rows.append((None if i in (3, 9) else i, text, ["en", None, "fr"][i % 3], source, None if text is None else len(text), *["x"] * 8))
    rows.append(rows[7])                                             # a repeated row
    rows.append((7, "the same id with another text " * 5, "en", "a", 1, *[None] * 8))
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
