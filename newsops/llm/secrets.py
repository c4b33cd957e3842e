"""Secret scans: known patterns, and a battery of randomness tests on other tokens.

Native: every step is a DataFrame or SQL function.

Assignments, access keys and long hexadecimal strings are found by pattern.  Beside them, every token of
``MIN_TOKEN`` or more characters with at least two of lower case, upper case and digits that lies in
no such match is a candidate.  Its encoding is the smallest alphabet that holds it (padding aside).
A token of one kind of characters, a long word or number, gives no evidence of runs and is none.  Three tests, each one-sided against what ordinary tokens do, give an upper bound of the chance that an
ordinary token looks as random as this one:

* uniformity: the chi-squared statistic over the encoding's alphabet, against that of a token whose
  characters are as concentrated as text is (non-central, normal approximation);
* runs: changes between kinds of characters (a capital goes with the small letters after it), against the
  rate of identifiers made of words of five letters (Chernoff bound);
* serial correlation of neighbours in the alphabet, against that of ordered sequences.

A token counts as random only if it differs from all three sorts of ordinary tokens, so its chance is the
greatest of the three.  Which chances suffice is set by false-discovery control (Benjamini and Hochberg)
over the distinct candidates of all documents, in strata of encoding and length: as the chances depend on
the length, short tokens need more evidence, and a crowd of them does not drown the long ones.  Chances are
counted in tenths of a power of ten, so the control needs one small table whatever the corpus holds.

Positions are code points, the end exclusive; a span is the whole match.  Null and empty texts have no spans;
rows equal in id and text are one document and get the same spans; extra columns are left out; an
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, row_key

# The patterns, and the length a match has at least.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

# Parameters of the battery.
MIN_TOKEN, LENGTHS, RATE = 16, (16, 20, 24, 32, 48, 64), 0.01
CONCENTRATION, CHANGES, ORDERED = 0.065, 0.2, 0.8
RUN = "[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"
FINEST = 120                    # chances below 10 ** -12 count as that
TOKEN = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}=*"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {                   # smallest first
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _LOWER + _UPPER, "base64": _DIGITS + _LOWER + _UPPER + "+/", "base64url": _DIGITS + _LOWER + _UPPER + "-_",
}


def _below(z: Column) -> Column:
    """The standard normal distribution function (polynomial approximation of its tail)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def _spans(name: str, text: str, pattern: str) -> Column:
    """(kind, gap, said) of each match in order: the length of what stands between it and the match before."""
    gaps, said = F.split(F.col(text), pattern, -1), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    zipped = F.transform(said, lambda m, i: F.struct(F.lit(name).alias("kind"), i.alias("i"), F.length(F.element_at(gaps, i + 1)).alias("gap"), m.alias("said")))
    return F.when(F.col(text).rlike(pattern), zipped)


def matches(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, _key, found): the matches of all patterns in each text, null where there is none."""
    key = row_key(id_col, text).alias("_key")
    rows = docs.select(F.col(id_col), key, F.col(text).cast("string").alias("_text"))
    per_kind = [_spans(k, "_text", p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True)]
    none = F.array().cast("array<struct<kind: string, i: int, gap: int, said: string>>")
    found = F.concat(*[F.coalesce(x, none) for x in per_kind])
    return rows.select(id_col, "_key", F.when(F.size(found) > 0, found).alias("found"))


def placed(found: DataFrame) -> DataFrame:
    """(_key, no, kind, begin, end, said): base spans, and tokens that meet none of them."""
    each = found.where("found is not null").groupBy("_key").agg(F.first("found").alias("found"))
    each = each.select("_key", F.explode("found").alias("m")).select("_key", "m.*")
    before = W.partitionBy("_key", "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("bigint") + F.length("said")).over(before)
    spans = each.withColumn("end", end).withColumn("begin", F.col("end") - F.length("said"))
    no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    assigned = F.length(F.regexp_extract("said", ASSIGN, 2)) >= MIN_ASSIGNED
    kinds_held = sum(F.col("said").rlike(c).cast("int") for c in ("[a-z]", "[A-Z]", "[0-9]"))
    spans = spans.withColumn("no", no).where(
        F.when(F.col("kind") == "assign", assigned).when(F.col("kind") == "random", kinds_held >= 2).otherwise(True)
    )
    order = W.partitionBy("_key").orderBy("begin", "no")
    base = F.col("kind") != "random"
    ended = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    begins = F.min(F.when(base, F.col("begin"))).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    spans = spans.withColumn("_ended", ended).withColumn("_begins", begins)
    free = ~(F.coalesce(F.col("_ended") > F.col("begin"), F.lit(False)) | F.coalesce(F.col("_begins") < F.col("end"), F.lit(False)))
    return spans.where(base | free).select("_key", "no", "kind", "begin", "end", "said")


def _body(token: str) -> Column:
    return F.rtrim(F.col(token), F.lit("="))


def encoding(token: str) -> Column:
    """The smallest alphabet that holds a token, null if none does."""
    choice = F.lit(None).cast("string")
    for name, alphabet in reversed(ENCODINGS.items()):
        choice = F.when(F.translate(F.col(token), alphabet, "") == "", F.lit(name)).otherwise(choice)
    return choice


def _per_encoding(value) -> Column:
    table = F.create_map(*[F.lit(x) for k, a in ENCODINGS.items() for x in (k, value(a))])
    return F.element_at(table, F.col("encoding"))


def battery(spans: DataFrame) -> DataFrame:
    """``spans`` with the token's encoding, its stratum's length, the three chances and their ``bin``.

    A bin is a tenth of a power of ten; base spans and tokens of no encoding have null there.
    """
    rows = spans.withColumn("_body", F.when(F.col("kind") == "random", _body("said")))
    rows = rows.withColumn("encoding", encoding("_body")).withColumn("_n", F.length("_body").cast("double"))
    rows = rows.withColumn("_alphabet", _per_encoding(lambda a: a)).withColumn("_k", _per_encoding(lambda a: float(len(a))))
    rows = rows.withColumn("_at", F.transform(F.split("_body", ""), lambda c: F.instr(F.col("_alphabet"), c).cast("double")))
    n, k = F.col("_n"), F.col("_k")

    held = F.transform(F.split("_alphabet", ""), lambda c: n - F.length(F.replace(F.col("_body"), c, F.lit(""))))
    squares = F.aggregate(held, F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.withColumn("chi_squared", squares * k / n - n)
    apart = n * (F.greatest(k * F.lit(CONCENTRATION), F.lit(1.6)) - 1)
    uniform = _below((F.col("chi_squared") - (k - 1) - apart) / F.sqrt(2 * (k - 1) + 4 * apart))

    rows = rows.withColumn("changes", (F.regexp_count("_body", F.lit(RUN)) - 1) / (n - 1))
    f = F.col("changes")
    apart = F.when(f < 1, f * F.log(f / CHANGES) + (1 - f) * F.log((1 - f) / (1 - CHANGES))).otherwise(-F.log(F.lit(CHANGES)))
    changing = F.when(f > CHANGES, F.exp(-(n - 1) * apart)).otherwise(1.0)

    mean = F.aggregate("_at", F.lit(0.0), lambda s, x: s + x) / n
    rows = rows.withColumn("_off", F.transform("_at", lambda x: x - mean))
    spread = F.aggregate("_off", F.lit(0.0), lambda s, x: s + x * x)
    paired = F.zip_with("_off", F.slice("_off", F.lit(2), F.size("_off")), lambda x, y: x * F.coalesce(y, F.lit(0.0)))
    rows = rows.withColumn("serial", F.when(spread > 0, F.abs(F.aggregate(paired, F.lit(0.0), lambda s, x: s + x)) / spread).otherwise(1.0))
    unordered = _below((F.col("serial") - ORDERED) * F.sqrt(n) / (1 - ORDERED ** 2))

    chance = F.greatest(uniform, changing, unordered)
    stratum = F.array_max(F.filter(F.array(*[F.lit(x) for x in LENGTHS]), lambda x: x <= n))
    rows = rows.withColumn("stratum", stratum).withColumn(
        "bin", F.when(F.col("encoding").isNotNull(), F.least(F.lit(FINEST), F.floor(-10 * F.log10(F.greatest(chance, F.lit(1e-300)))).cast("int")))
    )
    return rows.drop("_body", "_n", "_alphabet", "_k", "_at", "_off")


def limits(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(encoding, stratum, least): the least bin of a stratum that keeps the false-discovery rate."""
    distinct = tested.where("bin is not null").select("encoding", "stratum", "bin", F.xxhash64("said").alias("t"), F.length("said").alias("n")).distinct()
    counts = distinct.groupBy("encoding", "stratum", "bin").agg(F.count(F.lit(1)).alias("c"))
    own = W.partitionBy("encoding", "stratum")
    above = F.sum("c").over(own.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow))
    told = counts.withColumn("above", above).withColumn("of", F.sum("c").over(own))
    allowed = F.pow(F.lit(10.0), -F.col("bin") / 10) * F.col("of") <= rate * F.col("above")
    return told.where(allowed).groupBy("encoding", "stratum").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """(id, _key, spans): one row per document; ``spans`` is an array of (begin, no, kind, end) in order."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.keep("found", matches(docs, id_col, text))
    tested = scratch.keep("tested", battery(placed(found)))
    taken = tested.join(limits(tested, rate), ["encoding", "stratum"], "left").where((F.col("kind") != "random") | (F.col("bin") >= F.col("least")))
    told = taken.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("begin", "no", "kind", "end"))).alias("spans"))
    return found.select(id_col, "_key").join(told, "_key", "left")


def told(spans: Column) -> Column:
    """kind:begin:end of each span, comma-joined."""
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ","), F.lit(""))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per document: id, the base counts, base_sha256 and spans."""
    rows = find_secrets(docs, id_col, text, rate)
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("spans", lambda s: s["kind"] == kind)), F.lit(0)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS[:3]]
    return rows.select(id_col, *counts, F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
