"""URL identity, origin, safety and link resolution as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _EDGE_SPACE, _col, fold, let

# Query parameters that only track the reader.
TRACKING_PARAMETERS = ("fbclid", "from", "gclid", "ref", "ref_src", "source", "spm")
_NETLOC_SCHEMES = ("", "ftp", "http", "https", "file", "sftp", "ws", "wss")

_SCHEME = r"^([a-z][a-z0-9+.\-]*):"
_PARTS = r"^(?:[a-z][a-z0-9+.\-]*:)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?"


def _decode(c: Column) -> Column:
    # a lone percent sign is data, not an escape
    safe = F.regexp_replace(c, "%(?![0-9a-fA-F]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), c)


def _encode(c: Column) -> Column:
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _clean_query(query: Column) -> Column:
    fields = F.filter(F.split(query, "&"), lambda p: F.length(p) > 0)
    pairs = F.transform(
        fields,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("key"),
            _decode(
                F.when(F.instr(p, "=") > 0, F.regexp_replace(p, r"(?s)^[^=]*=", "")).otherwise("")
            ).alias("value"),
        ),
    )
    kept = F.filter(
        pairs,
        lambda p: ~F.startswith(p["key"], F.lit("utm_")) & ~p["key"].isin(*TRACKING_PARAMETERS),
    )
    return F.array_join(
        F.transform(
            F.array_sort(kept), lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))
        ),
        "&",
    )


def folded_url(c) -> Column:
    return fold(F.regexp_replace(_col(c), _EDGE_SPACE, ""))


def _netloc(folded: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(folded, _PARTS, 1), "(?s)^..", "")


def _host_port(folded: Column) -> Column:
    return F.regexp_replace(_netloc(folded), r"^.*@", "")


def _host(folded: Column) -> Column:
    hp = _host_port(folded)
    return F.when(hp.startswith("["), F.regexp_extract(hp, r"^\[([^\]]*)\]", 1)).otherwise(
        F.substring_index(hp, ":", 1)
    )


def _port_text(folded: Column) -> Column:
    hp = _host_port(folded)
    return F.when(
        hp.startswith("["), F.regexp_extract(hp, r"^\[[^\]]*\]:(.*)$", 1)
    ).otherwise(F.regexp_extract(hp, r"^[^:]*:(.*)$", 1))


def _malformed(folded: Column) -> Column:
    port = _port_text(folded)
    net = _netloc(folded)
    bracket = F.contains(net, F.lit("[")) != F.contains(net, F.lit("]"))
    bad_port = (port != "") & ~F.coalesce(
        port.rlike("^[0-9]+$") & (port.try_cast("bigint") <= 65535), F.lit(False)
    )
    return bracket | bad_port


def canonical_url(folded) -> Column:
    """One spelling per resource; input is :func:`folded_url`.

    Drops fragment, user name, default port, trailing slash and tracking parameters and
    sorts the rest.  A malformed URL keeps its text, marked ``raw:``.
    """
    return let(folded, _canonical)


def _canonical(url: Column) -> Column:
    scheme = F.regexp_extract(url, _SCHEME, 1)
    host, port = _host(url), _port_text(url).try_cast("int")
    default = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443))
    site = F.when(
        port.isNotNull() & (port != 0) & ~default, F.concat_ws(":", host, port)
    ).otherwise(host)
    path = F.regexp_extract(url, _PARTS, 2)
    path = (
        F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    )
    query = _clean_query(F.regexp_extract(url, _PARTS, 3))
    rooted = F.when(path.rlike("^/") | (path == ""), path).otherwise(F.concat(F.lit("/"), path))
    body = F.when(site != "", F.concat(F.lit("//"), site, rooted)).otherwise(
        F.when(
            (scheme != "") & scheme.isin(*_NETLOC_SCHEMES) & (path.startswith("/") | (path == "")),
            F.concat(F.lit("//"), path),
        ).otherwise(path)
    )
    whole = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        body,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when(_malformed(url), F.concat(F.lit("raw:"), F.substring_index(url, "#", 1))).otherwise(
        whole
    )


def origin_key(folded) -> Column:
    """``scheme|host|port`` or NULL when there is no host or the URL is malformed."""
    url = _col(folded)
    return F.when(
        ~_malformed(url) & (_host(url) != ""),
        F.concat_ws(
            "|", F.regexp_extract(url, _SCHEME, 1), _host(url),
            F.coalesce(_port_text(url).try_cast("int").cast("string"), F.lit("")),
        ),
    )


def is_public_url(folded) -> Column:
    """Syntax part of the safety check: http(s), a host, and not a local address."""
    url = _col(folded)
    scheme, host = F.regexp_extract(url, _SCHEME, 1), _host(url)
    local_v4 = (
        r"^(?:0|10|127)\.\d+\.\d+\.\d+$|^192\.168\.\d+\.\d+$|^169\.254\.\d+\.\d+$"
        r"|^172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+$|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.\d+\.\d+$"
        r"|^192\.0\.[02]\.\d+$|^198\.1[89]\.\d+\.\d+$|^198\.51\.100\.\d+$|^203\.0\.113\.\d+$"
        r"|^(?:22[4-9]|23\d|24\d|25[0-5])\.\d+\.\d+\.\d+$"
    )
    local_v6 = r"^(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{2}:.*)$"
    return (
        scheme.isin("http", "https") & (host != "") & (host != "localhost")
        & ~host.endswith(".local") & ~host.rlike(local_v4) & ~host.rlike(local_v6)
        & ~_malformed(url)
    )


def resolve_link(base, link) -> Column:
    """Resolve a feed link against the feed URL, dot segments included."""
    base, link = _col(base), F.trim(_col(link))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*/)?", 1)
    relative = F.concat(origin, F.when(folder == "", "/").otherwise(folder), link)
    joined = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link == "", base)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link))
        .otherwise(relative)
    )
    return F.when(joined.rlike(r"/\.\.?(?:/|$|\?|#)"), _drop_dots(joined)).otherwise(joined)


def _drop_dots(url: Column) -> Column:
    origin = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.concat(origin, F.lit("/"), F.array_join(kept, "/"), tail, rest)
