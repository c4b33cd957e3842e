"""Maps the test tables to articles, topics, sources, runs and stored history.

Each view exists twice: as a DataFrame and as a SQL common table expression, so that every
check starts from the same rows.  ``AS_OF`` is fixed; nothing reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, urls
from ..session import cut

AS_OF = "2024-01-28 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- articles ----------------------------------------------------------------
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents + events (date) + pages (link): one raw feed item per document."""
    docs = table(spark, sf_dir, "documents")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    step = max(1, events.count() // docs.count())          # parquet footers only
    dates_of = events.where(F.col("event_id") % step == 0).select(F.expr(f"event_id div {step}").alias("doc_id"), "ts")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("page_url"))
    # both joins on doc_id, so rows move once; titles are cut before, so texts move only where they are asked for
    dated = docs.select(
        "doc_id", "lang", "source", F.col("text").alias("full_text"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 500).alias("title"),
        F.split_part("text", F.lit("\n"), F.lit(2)).alias("excerpt"),
    ).join(dates_of, "doc_id", "left").join(pages, "doc_id", "left")
    when = F.date_trunc("second", F.col("ts").cast("timestamp"))
    published = (
        F.when(F.col("source") == "src13", "undated")
        .when(F.col("source") == "src7", F.lit(None))
        .when(F.col("lang") == "en", F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(F.col("lang") == "de", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(
            F.col("lang") == "fr",
            F.date_format(when + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"),
        )
        .otherwise(F.date_format(when, "yyyy-MM-dd HH:mm:ss"))
    )
    built = F.concat(
        F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"),
        F.col("doc_id").cast("string"),
    )
    return dated.select(
        F.col("doc_id").alias("article_id"),
        "title",
        F.coalesce("page_url", built).alias("url"),
        "excerpt",
        "full_text",
        F.col("source").alias("source_id"),
        F.concat(F.lit("Source "), "source").alias("source_name"),
        "lang",
        published.alias("published_at"),
        when.alias("created_at"),
    )


ARTICLES = f"""
step AS (SELECT greatest(1, (SELECT count(*) FROM events) // (SELECT count(*) FROM documents)) AS k),
articles AS (
  SELECT d.doc_id AS article_id, substr(split_part(d.text, chr(10), 1), 1, 500) AS title,
    coalesce(p.url, 'https://' || d.source || '.example.com/' || d.lang || '/' || d.doc_id) AS url,
    split_part(d.text, chr(10), 2) AS excerpt, d.text AS full_text, d.source AS source_id,
    'Source ' || d.source AS source_name, d.lang,
    date_trunc('second', e.ts) AS created_at,
    CASE WHEN d.source NOT IN ('src7', 'src13') THEN date_trunc('second', e.ts) END AS published,
    CASE WHEN d.source = 'src7' THEN 'missing' WHEN d.source = 'src13' THEN 'invalid' ELSE 'dated'
      END AS date_kind,
    replace(lower(substr(split_part(d.text, chr(10), 1), 1, 500)), 'ß', 'ss') AS f_title,
    replace(lower(split_part(d.text, chr(10), 2)), 'ß', 'ss') AS f_excerpt,
    replace(lower(d.text), 'ß', 'ss') AS f_full
  FROM documents d CROSS JOIN step
  LEFT JOIN events e ON e.event_id = d.doc_id * step.k
  LEFT JOIN pages p ON p.page_id = d.doc_id),
fresh AS (
  SELECT * FROM articles WHERE published IS NOT NULL
    AND published <= TIMESTAMP '{AS_OF}' + INTERVAL 1 DAY
    AND published >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY)"""


def dated_articles(spark: SparkSession, sf_dir: str, days: int | None = 7) -> DataFrame:
    """Articles with parsed date and freshness verdict."""
    df = articles(spark, sf_dir).withColumn(
        "published", dates.published_timestamp("published_at")
    )
    return df.withColumn("date_reason", dates.date_reason("published_at", "published", as_of(), days))


def fresh_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dated_articles(spark, sf_dir).where("date_reason IS NULL").drop("date_reason")


def fingerprints(df: DataFrame) -> DataFrame:
    """Add canonical_url, norm_title and material to rows with title and url."""
    return (
        df.withColumn("_title", text.folded_title("title"))
        .withColumn("canonical_url", urls.canonical_url(urls.folded_url("url")))
        .withColumn("norm_title", text.normalize_title("_title"))
        .withColumn("material", text.material_key(text.material_signature("_title")))
        .drop("_title")
    )


# DuckDB form of the identities.  On the test tables titles hold no Han characters, leading
# labels or outlet names, and URLs have no escapes, so those rules are left to fixtures.
URL_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  split_part(lower(url), '#', 1), '([?&])(utm_[a-z]*|ref|ref_src|from|source|spm|gclid|fbclid)=[^&]*', '\1', 'g'),
  '[?&]+$', ''), '\?&+', '?'), '/+($|\?)', '\1')"""
_UNITS = (
    r"%|per\s+cent\b|percent\b|basis\s+points?\b|bps\b|(?:thousand|million|billion|trillion)\b"
    r"|(?:usd|eur|cny|rmb|gbp)\b|(?:[kmg]w(?:h)?|kg|km|tonnes?|tons?|dollars?|euros?)\b"
)
_COMPACT = (
    "regexp_replace(replace(replace(replace(replace({0}, '$', 'usd'), '€', 'eur'), '¥', 'cny'), '£', 'gbp'), "
    r"'[^\p{{L}}\p{{N}}]', '', 'g')"
)
_CANON = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(split_part({0}, chr(2), 1), ',', ''), "
    r"'+', ''), '^(-?)0+([0-9])', '\1\2'), '(\.[0-9]*?)0+$', '\1'), '\.$', ''), '^-0$', '0')"
)
_UNIT = r"""CASE regexp_replace(split_part({0}, chr(2), 2), '\s+', ' ', 'g')
  WHEN 'percent' THEN '%' WHEN 'per cent' THEN '%' WHEN 'basis point' THEN 'bps' WHEN 'basis points' THEN 'bps'
  WHEN 'dollar' THEN 'usd' WHEN 'dollars' THEN 'usd' WHEN 'euro' THEN 'eur' WHEN 'euros' THEN 'eur' WHEN 'rmb' THEN 'cny'
  WHEN 'ton' THEN 'tonne' WHEN 'tons' THEN 'tonne' WHEN 'tonnes' THEN 'tonne'
  ELSE regexp_replace(split_part({0}, chr(2), 2), '\s+', ' ', 'g') END"""
_MONTHS = (
    "january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sept sep",
    "october oct", "november nov", "december dec",
)
_MONTH_SQL = " ".join(
    f"WHEN w IN ({', '.join(repr(n) for n in names.split())}) THEN 'month-{i}'" for i, names in enumerate(_MONTHS, 1)
)
_DATE_WORDS = ", ".join(repr(w) for names in _MONTHS for w in names.split()) + ", 'yesterday', 'today', 'tomorrow'"
# Written out here, apart from the library's own list.
_STAGES = (
    "'approved', 'cancelled', 'canceled', 'completed', 'confirmed', 'delayed', 'denied', 'draft', 'effective', 'enforced', "
    "'implemented', 'lowered', 'passed', 'postponed', 'proposed', 'raised', 'scheduled'"
)


def titled(source: str = "articles", name: str = "titled") -> str:
    """CTE adding norm_title, numbers, material and canonical_url to rows with f_title and url."""
    run, number = _COMPACT.format("x"), f"{_CANON.format('x')} || {_UNIT.format('x')}"
    slash = (
        f"CASE WHEN i > 2 AND {_COMPACT.format('parts[i - 1]')} = '' AND split_part(parts[i - 2], chr(2), 2) = '' "
        "THEN '/' ELSE '' END"
    )
    return rf"""
{name}_parts AS (
  SELECT *, string_split(regexp_replace(f_title, '(^|[^0-9])([+-]?[0-9]+(?:,[0-9]{{3}})*(?:\.[0-9]+)?)(?:\s*({_UNITS}))?',
    '\1' || chr(1) || '\2' || chr(2) || '\3' || chr(1), 'g'), chr(1)) AS parts,
    regexp_extract_all(f_title, '[a-z]+') AS w_all FROM {source}),
{name} AS (
  SELECT * EXCLUDE (parts, w_all), {URL_SQL} AS canonical_url,
    array_to_string(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN {slash} || {number} ELSE {run} END), '') AS norm_title,
    list_filter(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN {_CANON.format('x')} || '|' || {_UNIT.format('x')} END),
      lambda x: x IS NOT NULL) AS numbers,
    array_to_string(list_filter(list_transform(parts, lambda x, i: CASE WHEN i % 2 = 0 THEN {_CANON.format('x')} || '|' || {_UNIT.format('x')} END),
      lambda x: x IS NOT NULL), ';') || '#' ||
    array_to_string(list_transform(list_filter(w_all, lambda w: w IN ({_DATE_WORDS})), lambda w: CASE {_MONTH_SQL} ELSE w END), ',') || '#' ||
    array_to_string(list_sort(list_distinct(list_filter(w_all, lambda w: w IN ({_STAGES})))), ',') AS material
  FROM {name}_parts)"""


TITLED = titled()

# -- topics and sources --------------------------------------------------------
_TOPICS = [
    # topic_id, ord, name, keywords, exclusions, threshold, limit, source_ids, enabled, archived
    ("t1", 1, "Energy", ["onor", "onble", "annt"], ["haan"], 65, 20, [], True, False),
    ("t2", 2, "Markets", ["reed", "of and", "ciónesado"], ["inble", "nden"], None, None, [], True, False),
    ("t3", 3, "Regional", ["nicht", "qui", "inan", "Straße"], [], 75, 15,
     ["src0", "src1", "src2", "src3", "src4", "src5", "src6", "src8", "src9"], True, False),
    ("t4", 4, "queque", [], ["aiment"], 60, 10, [], True, False),
    ("t5", 5, "Dormant", ["edth"], [], None, None, ["src5"], False, False),
    ("t6", 6, "Old", ["onor"], [], None, None, [], True, True),
]
DEFAULT_THRESHOLD, DEFAULT_LIMIT = 60, 20


def topics(spark: SparkSession) -> DataFrame:
    names = "topic_id topic_ord name keywords exclusion_keywords threshold article_limit source_ids enabled archived"
    rows = ", ".join("(" + ", ".join(_spark_literal(v) for v in row) + ")" for row in _TOPICS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(names.split())})")


def _spark_literal(value) -> str:
    if isinstance(value, list):
        return "CAST(array(" + ", ".join(_quote(v) for v in value) + ") AS ARRAY<STRING>)"
    return "CAST(NULL AS INT)" if value is None else _quote(value)


def _quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "CAST([" + ", ".join(_quote(v) for v in value) + "] AS VARCHAR[])"
    return "'" + value.replace("'", "''") + "'"


TOPICS = (
    "topics(topic_id, topic_ord, name, keywords, exclusion_keywords, threshold, article_limit, "
    "source_ids, enabled, archived) AS (VALUES "
    + ", ".join("(" + ", ".join(_quote(v) for v in row) + ")" for row in _TOPICS)
    + ")"
)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription per document source, settings derived from its name; cut, so that joins see how few they are."""
    number = F.substring("source", 4, 10).cast("int")
    return cut(
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("lang").alias("language"))
        .select(
            F.col("source").alias("source_id"),
            number.alias("source_ord"),
            F.concat(F.lit("Source "), "source").alias("name"),
            F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("url"),
            F.when(number < 4, "central_bank").when(number < 8, "banking").when(number < 14, "general")
            .otherwise("science").alias("category"),
            "language",
            (F.col("source") != "src3").alias("enabled"),
            (F.col("source") == "src5").alias("archived"),
            (number > 9).alias("user_modified"),
            F.when(number < 15, F.concat(F.lit("preset-"), "source")).alias("preset_id"),
            F.when(number % 3 == 0, "ok").when(number % 3 == 1, "error").alias("last_status"),
            "n_docs",
        )
    )


SOURCES = """
sources AS (
  SELECT source AS source_id, CAST(substr(source, 4) AS INTEGER) AS source_ord,
    'Source ' || source AS name, 'https://' || source || '.example.com/feed' AS url,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) < 4 THEN 'central_bank'
         WHEN CAST(substr(source, 4) AS INTEGER) < 8 THEN 'banking'
         WHEN CAST(substr(source, 4) AS INTEGER) < 14 THEN 'general' ELSE 'science' END AS category,
    min(lang) AS language, source <> 'src3' AS enabled, source = 'src5' AS archived,
    CAST(substr(source, 4) AS INTEGER) > 9 AS user_modified,
    CASE WHEN CAST(substr(source, 4) AS INTEGER) < 15 THEN 'preset-' || source END AS preset_id,
    CASE CAST(substr(source, 4) AS INTEGER) % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'error' END AS last_status,
    count(*) AS n_docs
  FROM documents GROUP BY source)"""

# -- matching, as SQL -----------------------------------------------------------
# Keywords of the fixed topics hold no character that is special in a pattern.
MATCHES = r"""
kw AS (
  SELECT topic_id, topic_ord, pos, word, role,
    '(^|[^a-z0-9])' || replace(replace(lower(word), 'ß', 'ss'), ' ', '\s+') || '($|[^a-z0-9])' AS pat
  FROM (
    SELECT topic_id, topic_ord, unnest(kws) AS word, generate_subscripts(kws, 1) AS pos, 'in' AS role
    FROM (SELECT *, CASE WHEN len(keywords) = 0 THEN [name] ELSE keywords END AS kws FROM topics
          WHERE enabled AND NOT archived)
    UNION ALL
    SELECT topic_id, topic_ord, unnest(exclusion_keywords), generate_subscripts(exclusion_keywords, 1), 'ex'
    FROM topics WHERE enabled AND NOT archived)),
scoped AS (
  SELECT f.*, t.topic_id, t.topic_ord, s.source_ord,
    coalesce(t.threshold, 60) AS threshold, coalesce(t.article_limit, 20) AS article_limit
  FROM fresh f JOIN sources s ON s.source_id = f.source_id AND s.enabled AND NOT s.archived
  JOIN topics t ON t.enabled AND NOT t.archived
    AND (len(t.source_ids) = 0 OR list_contains(t.source_ids, f.source_id))),
hit AS (
  SELECT s.article_id, s.topic_id, k.role, k.pos, k.word,
    regexp_matches(regexp_replace(s.f_title, '[\s\-]+', ' ', 'g'), k.pat) AS in_title,
    regexp_matches(regexp_replace(s.f_excerpt, '[\s\-]+', ' ', 'g'), k.pat) AS in_excerpt,
    regexp_matches(regexp_replace(s.f_full, '[\s\-]+', ' ', 'g'), k.pat) AS in_full
  FROM scoped s JOIN kw k ON k.topic_id = s.topic_id),
verdict AS (
  SELECT s.*,
    coalesce(h.n_in, 0) AS n_in, coalesce(h.n_ex, 0) AS n_ex, coalesce(h.n_title, 0) AS n_title,
    h.words, least(95, 58 + 7 * coalesce(h.n_in, 0) + 8 * coalesce(h.n_title, 0)) AS score
  FROM scoped s LEFT JOIN (
    SELECT article_id, topic_id, count(*) FILTER (role = 'in') AS n_in,
      count(*) FILTER (role = 'ex') AS n_ex, count(*) FILTER (role = 'in' AND in_title) AS n_title,
      string_agg(word, '|' ORDER BY pos) FILTER (role = 'in') AS words
    FROM hit WHERE in_title OR in_excerpt OR in_full GROUP BY ALL) h
  USING (article_id, topic_id))"""


def sql(*parts: str, select: str) -> str:
    """Join common table expressions and the final select."""
    with_ = "WITH " + ",\n".join(p.strip() for p in parts) + "\n" if parts else ""
    return with_ + select.strip()
