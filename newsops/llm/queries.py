"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, langid, licenses, linededup, manifest, mixing, neardup, quality, quotes, resample, secrets, wrappers
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _named(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@_named("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    return bpe.digest(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@_named("op2_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


@_named("op6_quality_rules", r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (
  SELECT doc_id, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d))),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
  FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
said AS (SELECT *, array_to_string(lw, ' ') AS norm FROM lines WHERE len(lw) > 0),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM said GROUP BY doc_id),
often AS (SELECT s.host, norm FROM said s JOIN (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host) h ON h.host = s.host
  GROUP BY s.host, norm, h.n HAVING count(DISTINCT t) >= 20 AND count(DISTINCT t) > 0.01 * h.n),
lost AS (SELECT doc_id, sum(len(lw)) AS lost_words FROM said SEMI JOIN often USING (host, norm) GROUP BY doc_id),
f AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(lost_words, 0) AS BIGINT) AS lost_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - lost_words >= 0.3 * n_words AS kept FROM b""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(quality.figures(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"
    )


@_named("op9_source_mix")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.selectExpr("doc_id", "size", "source_size", "target", "size * copies as taken")


@_named("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@_named("op4_near_duplicates", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x, x AS y FROM ways UNION SELECT r.x, s.y FROM reach r JOIN ways s ON s.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


_UNSPACED = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in linededup.UNSPACED_RANGES)


@_named("op7_line_dedup", rf"""
WITH lines AS (SELECT doc_id, line_no, regexp_extract_all(line, '[{_UNSPACED}]|[^\x20\x09-\x0D{_UNSPACED}]+') AS ws FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM documents)),
said AS (SELECT * FROM lines WHERE len(ws) > 0),
own AS (SELECT ws, min(ROW(doc_id, line_no)) AS spot FROM said GROUP BY ws),
long AS (SELECT ws, spot FROM own WHERE list_sum(list_transform(ws, lambda w: CASE WHEN regexp_full_match(w, '[{_UNSPACED}]') THEN 1 ELSE 2 END)) >= 16),
without AS (SELECT ws, spot, i, list_concat(list_slice(ws, 1, i - 1), list_slice(ws, i + 1, len(ws))) AS v FROM (SELECT ws, spot, unnest(range(1, len(ws) + 1)) AS i FROM long)),
near AS (
  SELECT ws FROM (SELECT ws, spot, min(spot) OVER (PARTITION BY v, i) AS least FROM without) WHERE least < spot
  UNION SELECT o.ws FROM long o JOIN without s ON o.ws = s.v WHERE s.spot < o.spot
  UNION SELECT s.ws FROM long o JOIN without s ON o.ws = s.v WHERE o.spot < s.spot),
gone AS (SELECT l.doc_id, l.line_no, n.ws IS NOT NULL AS near FROM said l JOIN own o USING (ws) LEFT JOIN near n USING (ws)
  WHERE n.ws IS NOT NULL OR ROW(l.doc_id, l.line_no) <> o.spot),
told AS (SELECT doc_id, count(*) AS n_dropped, count(*) FILTER (near) AS n_near, string_agg(line_no, ',' ORDER BY line_no) AS dropped_lines FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, coalesce(dropped_lines, '') AS dropped_lines
FROM documents LEFT JOIN told USING (doc_id)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = linededup.line_report(table(spark, sf_dir, "documents"))
    return report.withColumn("dropped_lines", F.array_join(F.col("dropped_lines").cast("array<string>"), ","))


@_named("op3_quotation_links")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotations(table(spark, sf_dir, "conversations"))


@_named("op5_main_text", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS body FROM pages),
t AS (SELECT page_id, url, replace(replace(array_to_string(list_filter(list_transform(
    regexp_split_to_array(body, '</?(?:p|h1|br)>'), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> ''), chr(10)), '&quot;', '"'), '&amp;', '&') AS text FROM a)
SELECT page_id, url, text, length(text) AS n_chars FROM t""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))


@_named("op8_license_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: The CRC-32 of the bytes in a list column ``bytes``, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, b:
  list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _bytes(value: str) -> str:
    return f"list_transform(range(0, len(hex(encode({value}))) // 2), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::BIGINT)"


@_named("op11_importance_resampling", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
said AS (SELECT doc_id, unnest(ws) AS w FROM d), aimed AS (SELECT unnest(ws) AS w FROM b),
known AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT w, {_bytes("w")} AS bytes FROM (SELECT w FROM said UNION SELECT w FROM aimed))),
s AS (SELECT bucket, count(*) AS s FROM said JOIN known USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aimed JOIN known USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM said) + 10000) / ((s + 1)::DOUBLE * ((SELECT count(*) FROM aimed) + 10000)))) AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, floor(sum(gain) / count(*))::BIGINT AS weight FROM said JOIN known USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM d LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, rank FROM scored
LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20)) USING (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def _normal(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    poly = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(CASE WHEN {z} < 0 THEN exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly} ELSE 1 - exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {poly} END)"


_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_ALPHABETS = ", ".join(f"('{name}', '{alphabet}', {i})" for i, (name, alphabet) in enumerate(secrets.ENCODINGS.items()))


@_named("op12_secret_scan", rf"""
WITH p(no, kind, pattern) AS (VALUES (1, 'assign', '{_ASSIGN}'), (2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+'), (4, 'random', '[A-Za-z0-9+/_-]{{16,}}=*')),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (
  SELECT doc_id, 1 AS no, regexp_split_to_array(t, '{_ASSIGN}') AS gaps, regexp_extract_all(t, '{_ASSIGN}', 0) AS said FROM d
  UNION ALL SELECT doc_id, 2, regexp_split_to_array(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 3, regexp_split_to_array(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT doc_id, 4, regexp_split_to_array(t, '[A-Za-z0-9+/_-]{{16,}}=*'), regexp_extract_all(t, '[A-Za-z0-9+/_-]{{16,}}=*') FROM d),
m AS (SELECT doc_id, no, i, gaps[i] AS gap, said[i] AS said FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM a)),
e AS (SELECT *, sum(length(gap) + length(said)) OVER (PARTITION BY doc_id, no ORDER BY i) AS "end" FROM m),
s AS (SELECT doc_id, e.no, kind, "end" - length(said) AS "begin", "end", said FROM e JOIN p ON p.no = e.no WHERE CASE e.no
  WHEN 1 THEN length(regexp_extract(said, '{_ASSIGN}', 2)) >= 6 WHEN 2 THEN length(said) >= 20 WHEN 3 THEN length(said) >= 24
  ELSE regexp_matches(said, '[a-z]')::INT + regexp_matches(said, '[A-Z]')::INT + regexp_matches(said, '[0-9]')::INT >= 2 END),
c AS (SELECT s.*, rtrim(said, '=') AS body FROM s WHERE no = 4 AND NOT EXISTS (
  SELECT 1 FROM s b WHERE b.no < 4 AND b.doc_id = s.doc_id AND b."begin" < s."end" AND b."end" > s."begin")),
coded AS (SELECT body, arg_min(alphabet, o) AS alphabet, arg_min(name, o) AS encoding FROM (SELECT DISTINCT body FROM c)
  JOIN (VALUES {_ALPHABETS}) v(name, alphabet, o) ON translate(body, alphabet, '') = '' GROUP BY body),
chars AS (SELECT *, unnest(range(1, length(body) + 1)) AS i FROM coded),
place AS (SELECT body, i, substr(body, i, 1) AS ch, instr(alphabet, substr(body, i, 1)) - avg(instr(alphabet, substr(body, i, 1))) OVER (PARTITION BY body) AS x FROM chars),
near AS (SELECT body, x, x * lead(x) OVER (PARTITION BY body ORDER BY i) AS xy FROM place),
serial AS (SELECT body, CASE WHEN sum(x * x) > 0 THEN abs(sum(xy)) / sum(x * x) ELSE 1 END AS r FROM near GROUP BY body),
held AS (SELECT body, sum(n * n) AS squares FROM (SELECT body, ch, count(*) AS n FROM place GROUP BY body, ch) GROUP BY body),
f AS (SELECT body, encoding, length(alphabet)::DOUBLE AS k, length(body)::DOUBLE AS n, squares::DOUBLE AS squares, r,
  (len(regexp_extract_all(body, '{secrets.RUN}')) - 1) / (length(body) - 1)::DOUBLE AS f FROM coded JOIN serial USING (body) JOIN held USING (body)),
z AS (SELECT *, n * (greatest(k * 0.065, 1.6) - 1) AS apart FROM f),
y AS (SELECT *, (squares * k / n - n - (k - 1) - apart) / sqrt(2 * (k - 1) + 4 * apart) AS z1, (r - 0.8) * sqrt(n) / (1 - 0.64) AS z3,
  CASE WHEN f <= 0.2 THEN 1 WHEN f < 1 THEN exp(-(n - 1) * (f * ln(f / 0.2) + (1 - f) * ln((1 - f) / 0.8))) ELSE exp((n - 1) * ln(0.2)) END AS p2 FROM z),
x AS (SELECT body, encoding, list_max(list_filter([16, 20, 24, 32, 48, 64], lambda v: v <= n)) AS stratum,
  least(120, floor(-10 * log10(greatest({_normal("z1")}, p2, {_normal("z3")}, 1e-300)))) AS bin FROM y),
told AS (SELECT DISTINCT said, encoding, stratum, bin FROM c JOIN x USING (body)),
counts AS (SELECT encoding, stratum, bin, count(*) AS n FROM told GROUP BY ALL),
sums AS (SELECT *, sum(n) OVER (PARTITION BY encoding, stratum ORDER BY bin DESC) AS above, sum(n) OVER (PARTITION BY encoding, stratum) AS of FROM counts),
limits AS (SELECT encoding, stratum, min(bin) AS least FROM sums WHERE pow(10, -bin / 10) * of <= 0.01 * above GROUP BY ALL),
every AS (SELECT doc_id, no, kind, "begin", "end" FROM s WHERE no < 4
  UNION ALL SELECT doc_id, no, kind, "begin", "end" FROM c JOIN x USING (body) JOIN limits USING (encoding, stratum) WHERE bin >= least),
lists AS (SELECT doc_id, count(*) FILTER (no = 1) AS n_assign, count(*) FILTER (no = 2) AS n_access, count(*) FILTER (no = 3) AS n_hex,
  string_agg(kind || ':' || "begin" || ':' || "end", ',' ORDER BY "begin", no) FILTER (no < 4) AS base,
  string_agg(kind || ':' || "begin" || ':' || "end", ',' ORDER BY "begin", no) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN lists USING (doc_id)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def _said(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


_LEAF = "sha256(concat({}))".format(", ".join(_said(c) for c in manifest.FIELDS))


@_named("op13_merkle_manifest", f"""
WITH RECURSIVE d AS (SELECT *, {_LEAF} AS leaf, {_CRC} % 2 = 0 AS struck
  FROM (SELECT *, {_bytes("doc_id::VARCHAR")} AS bytes FROM documents)),
altered AS (SELECT doc_id, {_LEAF} AS altered_leaf FROM (SELECT * REPLACE (CASE WHEN struck THEN replace(text, chr(10), '') ELSE text END AS text) FROM d)),
own AS (SELECT doc_id, coalesce('=' || source, '-') AS g, leaf,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT g, 0 AS level, pos, n, leaf AS h FROM own
  UNION ALL SELECT g, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY g, level, pos // 3),
sub AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
over AS (SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL SELECT level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY level, pos // 3),
runs AS (SELECT g, level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL),
top AS (SELECT level, pos // 3 AS run, list(h ORDER BY pos) AS hs FROM over WHERE n > 1 GROUP BY ALL),
way AS (
  SELECT doc_id, r.level, hs, pos // (3 ** r.level)::BIGINT % 3 AS slot FROM own o JOIN runs r ON r.g = o.g AND r.run = o.pos // (3 ** (r.level + 1))::BIGINT
  UNION ALL SELECT doc_id, 1000 + t.level, hs, s.pos // (3 ** t.level)::BIGINT % 3 FROM own o JOIN sub s USING (g) JOIN top t ON t.run = s.pos // (3 ** (t.level + 1))::BIGINT),
sides AS (SELECT doc_id, level, array_to_string(hs[:slot], '') AS l, array_to_string(hs[slot + 2:], '') AS r FROM way),
told AS (SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS proof, list({{'l': l, 'r': r}} ORDER BY level) AS steps FROM sides GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS i, altered_leaf AS h FROM altered
  UNION ALL SELECT doc_id, i + 1, sha256(steps[i + 1].l || h || steps[i + 1].r) FROM fold JOIN told USING (doc_id) WHERE i < len(steps)),
ends AS (SELECT doc_id, arg_max(h, i) AS folded_root FROM fold GROUP BY doc_id)
SELECT doc_id, leaf, subroot, (SELECT h FROM over WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
  folded_root = (SELECT h FROM over WHERE n = 1) AS verified
FROM own JOIN sub USING (g) LEFT JOIN told USING (doc_id) JOIN ends USING (doc_id)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest.verified(manifest.manifest(table(spark, sf_dir, "documents"), manifest.without_line_breaks()))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@_named("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
