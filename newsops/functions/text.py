"""Text, keyword and title normalisation as native column expressions.

Nothing here is a Python UDF.  Unicode compatibility folding uses the ICU classes
that Spark itself ships for collations, called through the SQL function
``java_method``; pure-ASCII values never take that branch.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Term lists, units and patterns that decide which titles are equal.
# ---------------------------------------------------------------------------
STAGE_TERMS_HAN = (
    "上调 下调 取消 草案 提案 征求意见 通过 生效 执行 实施 延后 延期 推迟 完成 获批 批准 "
    "确认 否认 正式 召回 新增 暂停 恢复 终止 已 拟 将"
).split()
STAGE_TERMS_LATIN = (
    "confirmed denied approved cancelled canceled completed draft proposed passed scheduled "
    "effective implemented enforced delayed postponed raised lowered"
).split()
BOILERPLATE = "据悉 快讯 报道 最新 最新消息 消息 独家".split()
OUTLETS = (
    "新浪财经 新浪新闻 腾讯新闻 网易新闻 搜狐新闻 凤凰网 中国新闻网 中新网 界面新闻 澎湃新闻 "
    "第一财经 证券时报 证券日报"
).split()
OUTLET_ENDINGS = "新闻网 新闻客户端 财经网 日报 时报 周刊".split()
VERB_SYNONYMS = (
    ("推出", "发布"), ("公布", "发布"), ("推介", "发布"),
    ("表示", "称"), ("指出", "称"), ("透露", "称"),
)
MONTHS = (
    "january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul",
    "august aug", "september sept sep", "october oct", "november nov", "december dec",
)
HAN_MONTHS = "一 二 三 四 五 六 七 八 九 十 十一 十二".split()
RELATIVE_DATES = (
    "yesterday today tomorrow 昨日 今日 明日 昨天 今天 明天 上月 本月 下月 去年 今年 明年"
).split()
UNIT_NAMES = {
    "percent": "%", "per cent": "%", "basis point": "bps", "basis points": "bps",
    "dollar": "usd", "dollars": "usd", "$": "usd", "美元": "usd",
    "euro": "eur", "euros": "eur", "€": "eur", "欧元": "eur",
    "rmb": "cny", "¥": "cny", "元": "cny", "£": "gbp",
    "ton": "tonne", "tons": "tonne", "tonnes": "tonne", "吨": "tonne",
}
NUMBER = r"(?<!\d)[+-]?\d+(?:,\d{3})*(?:\.\d+)?"
UNIT = (
    r"%|per\s+cent\b|percent\b|basis\s+points?\b|bps\b|"
    r"(?:thousand|million|billion|trillion)\b|(?:usd|eur|cny|rmb|gbp)\b|"
    r"(?:[kmg]w(?:h)?|kg|km|tonnes?|tons?|dollars?|euros?)\b|"
    r"(?:万|亿)?(?:元|美元|欧元|吨|人|台|辆|件)|万|亿|年|月|日|天|小时|分钟|秒"
)
CURRENCY_BEFORE = r"(?U)((?:[$€£¥]|\b(?:usd|eur|cny|rmb|gbp)))\s*$"
KEYWORD_SEPARATORS = "[,，、;；\r\n]+"
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
MAX_KEYWORDS = 40

# ---------------------------------------------------------------------------
# Building blocks derived from the fixed values
# ---------------------------------------------------------------------------
_SPACE = r"(?U)[\s\x1c-\x1f]+"
_JOINERS = r"(?U)[\s\x1c-\x1f\-\x{2010}-\x{2015}\x{2212}]+"
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_TAIL_MARKS = " :：|｜-_—–·"
_CALENDAR = {
    **{name: f"month-{n}" for n, names in enumerate(MONTHS, 1) for name in names.split()},
    **{word: word for word in RELATIVE_DATES},
    **{f"{name}月": f"month-{n}" for n, name in enumerate(HAN_MONTHS, 1)},
}


def _alternatives(terms) -> str:
    """Longest-first alternation, Latin terms guarded by letter boundaries."""
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    latin = "|".join(re.escape(t) for t in ordered if t.isascii())
    other = "|".join(t for t in ordered if not t.isascii())
    parts = ([rf"(?<![a-z])(?:{latin})(?![a-z])"] if latin else []) + ([other] if other else [])
    return "|".join(parts)


_CALENDAR_RE = _alternatives(_CALENDAR)
_STAGE_RE = _alternatives(STAGE_TERMS_LATIN + STAGE_TERMS_HAN)
_MARKED_NUMBER = rf"(?U)({NUMBER})(?:\s*({UNIT}))?"


def _map_of(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimizer inlines."""
    return F.transform(F.array(_col(value)), body)[0]


def _has_non_ascii(c: Column) -> Column:
    return F.octet_length(c) > F.length(c)


# ---------------------------------------------------------------------------
# Unicode folding
# ---------------------------------------------------------------------------
def nfkc(c) -> Column:
    """Unicode NFKC; ASCII values pass through untouched."""
    c = _col(c)
    composed = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )
    return F.when(_has_non_ascii(c), composed).otherwise(c)


def fold(c) -> Column:
    """NFKC followed by full Unicode case folding (``ß`` equals ``ss``)."""
    c = _col(c)
    composed = F.call_function(
        "java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True)
    )
    folded = F.call_function(
        "java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True)
    )
    return F.when(_has_non_ascii(c), folded).otherwise(F.lower(c))


def squeeze(c) -> Column:
    """Trim and collapse every run of white space to one blank."""
    return F.trim(F.regexp_replace(_col(c), _SPACE, " "))


def truncate(c, limit: int) -> Column:
    return F.substring(_col(c), 1, limit)


def plain_text(c, limit: int | None = 4000) -> Column:
    """Strip simple markup and the common entities, collapse spaces, truncate (not at all where ``limit`` is None).

    For arbitrary HTML use :func:`newsops.sources.pages.page_paragraphs`.
    """
    text = F.coalesce(_col(c), F.lit(""))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " ")
    return squeeze(text) if limit is None else truncate(squeeze(text), limit)


# ---------------------------------------------------------------------------
# Keywords
# ---------------------------------------------------------------------------
def searchable_text(c) -> Column:
    """Folded text with blanks, hyphens and dashes unified to single blanks."""
    return F.regexp_replace(fold(c), _JOINERS, " ")


def normalize_keyword(c) -> Column:
    return squeeze(nfkc(c))


def parse_keywords(c) -> Column:
    """Split a keyword string (or an array of them) and drop repeats, first spelling wins."""
    raw = _col(c)
    parts = F.split(raw, KEYWORD_SEPARATORS)
    return _distinct_keywords(parts)


def parse_keyword_array(c) -> Column:
    parts = F.flatten(F.transform(_col(c), lambda x: F.split(x, KEYWORD_SEPARATORS)))
    return _distinct_keywords(parts)


def _distinct_keywords(parts: Column) -> Column:
    spelled = F.filter(F.transform(parts, normalize_keyword), lambda k: F.length(k) > 0)
    pairs = F.transform(spelled, lambda k: F.struct(fold(k).alias("key"), k.alias("word")))
    keys = F.transform(pairs, lambda p: p["key"])
    # keep a pair only where its key has not been seen at an earlier position
    first = F.filter(pairs, lambda p, i: F.array_position(keys, p["key"]) == i + 1)
    return F.transform(first, lambda p: p["word"])


def _is_substring_keyword(folded: Column) -> Column:
    return folded.rlike(HAN) | ~folded.rlike("[a-z0-9]")


def keyword_pattern(folded) -> Column:
    """Regular expression for one already folded keyword.

    Latin keywords must not touch ``[a-z0-9]`` on either side; keywords with Han
    characters, or without any Latin letter or digit, are plain substrings.
    """
    word = F.trim(_col(folded))
    literal = F.regexp_replace(word, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    literal = F.replace(literal, F.lit(" "), F.lit(r"\s+"))
    bounded = F.concat(F.lit("(?<![a-z0-9])"), literal, F.lit("(?![a-z0-9])"))
    return F.when(_is_substring_keyword(word), literal).otherwise(bounded)


def keyword_anchor(folded) -> Column:
    """A token that any text matching the keyword must contain (see ``text_tokens``)."""
    word = F.trim(_col(folded))
    runs = F.regexp_extract_all(word, F.lit("[a-z0-9]+"), 0)
    longest = F.aggregate(
        runs, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)
    )
    sign = F.regexp_extract(word, r"[^a-z0-9\s]", 0)
    return F.when(_is_substring_keyword(word), sign).otherwise(longest)


def text_tokens(folded) -> Column:
    """Distinct Latin/digit runs and single other characters of a folded text."""
    return F.array_distinct(
        F.regexp_extract_all(_col(folded), F.lit(r"[a-z0-9]+|[^a-z0-9\s]"), 0)
    )


def tokens_among(folded, tokens: list[str]) -> Column:
    """Of :func:`text_tokens` those among ``tokens``, and perhaps others of like letters; one pass that stops at first letters only."""
    words = [t for t in tokens if re.fullmatch("[a-z0-9]+", t)]
    sought = [re.escape(t) for t in tokens if t and t not in words]
    if words:
        first, rest = "".join(sorted({w[0] for w in words})), "|".join(w[1:] for w in words)
        sought.append(f"[{first}](?<![a-z0-9].)(?:{rest})(?![a-z0-9])")
    return F.regexp_extract_all(_col(folded), F.lit("|".join(sought)), 0)


# ---------------------------------------------------------------------------
# Titles
# ---------------------------------------------------------------------------
def canonical_number(c) -> Column:
    """``+1,050.00`` -> ``1050``; ``-0.0`` -> ``0``."""
    digits = F.regexp_replace(_col(c), r"[,+]", "")
    digits = F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1")
    digits = F.regexp_replace(digits, r"(\.\d*?)0+$", "$1")
    digits = F.regexp_replace(digits, r"\.$", "")
    return F.regexp_replace(digits, "^-0$", "0")


def unit_name(c) -> Column:
    unit = squeeze(c)
    return F.coalesce(F.element_at(_map_of(UNIT_NAMES), unit), unit)


def compact_text(c) -> Column:
    """Letters and digits only; currency signs become their code."""
    text = _col(c)
    for sign, code in (("$", "usd"), ("€", "eur"), ("¥", "cny"), ("£", "gbp")):
        text = F.replace(text, F.lit(sign), F.lit(code))
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def folded_title(c) -> Column:
    return F.replace(fold(c), F.lit("−"), F.lit("-"))


def normalized_title_text(folded) -> Column:
    """Remove label, lead-in word and outlet name from an already folded title.

    A leading label that carries a number, date or policy stage stays.
    """
    material = rf"{NUMBER}|{_STAGE_RE}|{_CALENDAR_RE}"
    label = (
        rf"(?U)^\s*(?:【(?![^】]*?(?:{material})[^】]*】)[^】]{{1,16}}】"
        rf"|\[(?![^\]]*?(?:{material})[^\]]*\])[^\]]{{1,16}}\])\s*"
    )
    lead = "|".join(sorted(BOILERPLATE, key=len, reverse=True))
    known, endings = "|".join(OUTLETS), "|".join(OUTLET_ENDINGS)
    marks = r"[ :：|｜\-_—–·]*"
    separated = rf"(?U)\s*[-_|｜—–·]\s*(?:(?:{known})|\S{{0,18}}?(?:{endings}))\s*$"
    text = F.regexp_replace(_col(folded), _EDGE_SPACE, "")
    text = F.regexp_replace(text, label, "")
    text = F.regexp_replace(text, rf"^(?:{lead}){marks}", "")
    text = F.regexp_replace(text, separated, "")
    text = F.regexp_replace(text, rf"(?s)^(.+?){marks}(?:{known})$", "$1")
    for verb, common in VERB_SYNONYMS:
        text = F.replace(text, F.lit(verb), F.lit(common))
    return text


def _number_segments(text: Column) -> Column:
    """Alternating array: plain run, ``value\\x02unit``, plain run, ..."""
    clean = F.translate(text, "\x01\x02", "  ")
    marked = F.regexp_replace(clean, _MARKED_NUMBER, "\x01$1\x02$2\x01")
    return F.split(marked, "\x01")


def _value(segment: Column) -> Column:
    return F.substring_index(segment, "\x02", 1)


def _unit(segment: Column) -> Column:
    return F.substring_index(segment, "\x02", -1)


def normalize_title(folded) -> Column:
    """Identity of a title: letters, digits, canonical numbers with their units."""

    def walk(segments: Column) -> Column:
        def render(segment, i):
            before = F.try_element_at(segments, i)             # the run before this number
            previous = F.try_element_at(segments, i - 1)       # the number before that run
            adjacent = (i > 1) & (compact_text(before) == "") & (_unit(previous) == "")
            number = F.concat(
                F.when(adjacent, "/").otherwise(""),
                canonical_number(_value(segment)), unit_name(_unit(segment)),
            )
            return F.when((i % 2) == 1, number).otherwise(compact_text(segment))

        return F.array_join(F.transform(segments, render), "")

    return let(_number_segments(normalized_title_text(folded)), walk)


def calendar_signature(folded) -> Column:
    found = F.regexp_extract_all(_col(folded), F.lit(_CALENDAR_RE), 0)
    return F.transform(found, lambda t: F.element_at(_map_of(_CALENDAR), t))


def stage_signature(folded) -> Column:
    """Sorted distinct policy-stage terms."""
    text = _col(folded)
    latin = F.regexp_extract_all(text, F.lit(_alternatives(STAGE_TERMS_LATIN)), 0)
    han = F.when(
        text.rlike(HAN),
        F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in STAGE_TERMS_HAN])),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(latin, han)))


def number_signature(folded) -> Column:
    """``array<struct<value,prefix,unit>>`` in text order."""

    def walk(segments: Column) -> Column:
        def describe(segment, i):
            number_before = F.when(
                i > 1, F.replace(F.try_element_at(segments, i - 1), F.lit("\x02"), F.lit(""))
            ).otherwise("")
            before = F.concat(number_before, F.try_element_at(segments, i))
            return F.when(
                (i % 2) == 1,
                F.struct(
                    canonical_number(_value(segment)).alias("value"),
                    unit_name(F.regexp_extract(before, CURRENCY_BEFORE, 1)).alias("prefix"),
                    unit_name(_unit(segment)).alias("unit"),
                ),
            )

        return F.array_compact(F.transform(segments, describe))

    return let(_number_segments(_col(folded)), walk)


def material_signature(folded) -> Column:
    """What makes a similar title a real update: numbers, dates and policy stages."""
    text = _col(folded)
    return F.struct(
        number_signature(text).alias("numbers"),
        calendar_signature(text).alias("calendar"),
        stage_signature(text).alias("stages"),
    )


def material_key(material) -> Column:
    """The signature as one comparable string."""
    return let(_col(material), _material_key)


def _material_key(m: Column) -> Column:
    numbers = F.transform(
        m["numbers"], lambda n: F.concat_ws("\x1f", n["value"], n["prefix"], n["unit"])
    )
    return F.concat_ws(
        "\x1d", F.concat_ws("\x1e", numbers), F.concat_ws("\x1e", m["calendar"]),
        F.concat_ws("\x1e", m["stages"]),
    )


def char_grams(c, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own single gram."""
    text = _col(c)
    grams = F.transform(
        F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, n)
    )
    return (
        F.when(F.length(text) >= n, F.array_distinct(grams))
        .when(F.length(text) > 0, F.array(text))
        .otherwise(F.array().cast("array<string>"))
    )
