"""HTML main-text extraction with wrappers inferred as union-free regular expressions.

Pages become token streams of tags and texts; adjacent repeats of a group fold into one repeated
group.  The streams of a host's pages are aligned one after the other: where a wrapper and a page
differ, the extra tokens on either side become an optional group, a shared part that one of them
repeats becomes a repeated group, and differing texts become a text slot.  A wrapper never holds a
union, so its size follows the host's template and not the number of pages, and two wrappers align
like a wrapper and a page: tasks fold their own pages, then partial wrappers are folded per host.
(The stream is kept as a nested list, so that alignment respects the tags' nesting.)

Elements are keyed by their path and by those class or id words on it that recur on the host's pages
(on a quarter of them, and on two at least; counted in Spark), so labels of single pages, like a post's
number, do not keep pages from aligning.

A host's wrapper tells which container holds the content: ``article`` or ``main`` if it has one, else
the container with most slots in text blocks, or the one in its place under other labels.  The page's text blocks in that container are its main
text, without the parts that are menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles or reader comments by their element, role or class.  Class and id words say nothing on headings,
paragraphs and quotations, and an id says something only if it recurs on the host's pages or has no
other words.  Nothing else is dropped, constant texts of the container included.

A null or empty page has an empty text.  A null url belongs to the host "".  A page without the
container of its host falls back to its own stream.  Repeated rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
UNSEEN = frozenset("script style template noscript iframe object svg math canvas head title select textarea".split())
RAW = frozenset("script style textarea title iframe noscript xmp".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog button".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs sidebar aside header masthead topbar footer cookie cookies consent notice "
    "notification alert popup modal overlay newsletter subscribe signup login share sharing social related "
    "recommended comment comments disqus respond replies reply widget toolbar pagination pager skip".split()
)
CONTENT = frozenset("article main".split())
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
P_CLOSERS = BLOCK - frozenset("body html head title option optgroup caption legend summary".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")
PARTIALS = 32                   # partial wrappers of a host before the last fold
GROUP, LONGEST = 4, 64          # nodes of a repeated group; nodes of a sequence before any order is allowed
CONSTANT = 80                   # longer texts are slots at once
LABEL_PART = 4                  # a label recurs if one in so many of the host's pages has it
BARE = re.compile(r"\.[^/]*")


def _outside(name: str, attributes: dict[str, str], keep: frozenset[str] | None = None) -> bool:
    if name in OUTSIDE or attributes.get("role", "").lower() in OUTSIDE_ROLES or "hidden" in attributes:
        return True
    if name in CONTENT or name in TEXTUAL or name in ("html", "body"):
        return False
    if any(word in OUTSIDE_WORDS for word in WORDS.findall(attributes.get("class", "").lower())):
        return True
    own = attributes.get("id", "")
    words = [word in OUTSIDE_WORDS for word in WORDS.findall(own.lower())]
    return all(words) and bool(words) or any(words) and (keep is None or own.replace("/", "|") in keep)


def _labels(attributes: dict[str, str]) -> list[str]:
    return (attributes.get("class") or attributes.get("id") or "").replace("/", "|").split()


def _is_container(name: str) -> bool:
    return name in BLOCK and name not in ("p", "li", "b")


def tokens(page: str, keep: frozenset[str] | None = None):
    """(kind, value, container, seen) tokens: kind is open, close, text or break.

    ``container`` is the path of open containers with their labels, of which only those in ``keep``
    count where it is given, ``seen`` whether text here is content by its
    elements; unclosed and misnested elements are closed as a browser would.
    """
    stack: list[tuple[str, str, bool]] = []            # name, container path, seen
    at = 0

    def state():
        return stack[-1][1:] if stack else ("", True)

    while at <= len(page):
        found = TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            yield "text", page[at:stop], *state()
        if not found:
            return
        at = max(found.end(), stop + 1)
        name = (found["name"] or "").lower()
        if not name:
            continue
        if found["close"]:
            names = [s[0] for s in stack]
            if name in names:
                while stack:
                    top = stack.pop()
                    yield "close", top[0], *state()
                    if top[0] == name:
                        break
            elif name in BLOCK:
                yield "break", name, *state()
            continue
        attributes = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(found["rest"])}
        if name in VOID or found["rest"].endswith("/"):
            yield "break" if name in BLOCK or name == "br" else "void", name, *state()
            continue
        if name in P_CLOSERS or name == "li":
            closing = "li" if name == "li" else "p"
            names = [s[0] for s in stack]
            inner = names[len(names) - names[::-1].index(closing) - 1:] if closing in names else []
            if inner and not any(x in BLOCK for x in inner[1:]):
                for _ in inner:
                    top = stack.pop()
                    yield "close", top[0], *state()
        path, seen = state()
        if _is_container(name):
            path = ".".join([f"{path}/{name}", *(x for x in _labels(attributes) if keep is None or x in keep)])
        stack.append((name, path, seen and name not in UNSEEN and not _outside(name, attributes, keep)))
        yield "open", name, *state()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            end = end.end() if end else len(page)
            stack.pop()
            yield "close", name, *state()
            at = max(at, end)


# -- wrappers ----------------------------------------------------------------------------------
# A wrapper is a list of nodes [key, content, least, many]: key is "#" for a text (content: the constant
# text, or None for a slot), "<name label>" for an element (content: its inner wrapper) or "(keys)" for a
# group (content: its nodes); least is 0 if the node is optional, many is 1 if it can repeat.

def fold(nodes: list) -> list:
    """Adjacent repeats of a node or of a group of nodes become one repeated node, short groups first."""
    width = 1
    while 2 * width <= len(nodes) and width <= GROUP:
        keys = [n[0] for n in nodes]
        out, i = [], 0
        while i < len(nodes):
            k = 1
            while keys[i:i + width] == keys[i + k * width:i + (k + 1) * width] and i + (k + 1) * width <= len(nodes):
                k += 1
            if k == 1:
                out.append(nodes[i])
                i += 1
                continue
            parts = nodes[i:i + width]
            for r in range(1, k):
                parts = [_both(x, y) for x, y in zip(parts, nodes[i + r * width:i + (r + 1) * width], strict=True)]
            if width == 1:
                out.append([*parts[0][:3], 1])
            else:
                out.append([f"({' '.join(keys[i:i + width])})", parts, 1, 1])
            i += k * width
        width = 1 if len(out) < len(nodes) else width + 1
        nodes = out
    return _any(nodes) if len(nodes) > LONGEST else nodes


def _any(nodes: list) -> list:
    """One group of the nodes in any order; such a group never holds another."""
    kinds: dict[str, list] = {}
    for node in nodes:
        for n in node[1] if node[0] == "(any)" else [node]:
            kinds[n[0]] = _both(kinds[n[0]], n) if n[0] in kinds else n
    return [["(any)", [[k, c, 0, many] for k, c, _, many in (kinds[k] for k in sorted(kinds))], 1, 1]]


def _both(a: list, b: list) -> list:
    """One node that matches what either of two nodes of equal key matches."""
    if a == b:
        return a
    content = (a[1] if a[1] == b[1] else None) if a[0] == "#" else merge(a[1], b[1])
    return [a[0], content, min(a[2], b[2]), max(a[3], b[3])]


def merge(a: list, b: list) -> list:
    """The wrapper of everything that either wrapper matches: align, then resolve mismatches."""
    if a == b:
        return a
    ka, kb = [n[0] for n in a], [n[0] for n in b]
    if "(any)" in ka or "(any)" in kb:
        return _any(a + b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = 1 + best[i + 1][j + 1] if ka[i] == kb[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            out.append(_both(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([*a[i][:2], 0, a[i][3]])
            i += 1
        else:
            out.append([*b[j][:2], 0, b[j][3]])
            j += 1
    return fold(out)


def page_wrapper(page: str, keep: frozenset[str] | None = None) -> list:
    """A page's own token stream as a wrapper."""
    stack: list[list] = [[]]
    for kind, value, path, seen in tokens(page, keep):
        if kind == "text":
            text = SPACES.sub(" ", entities.unescape(value)).strip()
            if text and seen:
                stack[-1].append(["#", text if len(text) <= CONSTANT else None, 1, 0])
        elif kind == "open":
            node = [f"<{value} {path}>" if value in BLOCK else f"<{value}>", [], 1, 0]
            stack[-1].append(node)
            stack.append(node[1])
        elif kind == "close" and len(stack) > 1:
            inner = stack.pop()
            stack[-1][-1][1] = fold(inner)
    while len(stack) > 1:
        inner = stack.pop()
        stack[-1][-1][1] = fold(inner)
    return fold(stack[0])


def expression(nodes: list) -> str:
    """The wrapper as a regular expression over tags, with #PCDATA for text slots."""
    out = []
    for key, content, least, many in nodes:
        if key == "#":
            one = "#PCDATA" if content is None else re.escape(content)
        elif key[0] == "<":
            name = key[1:-1].split(" ")[0]
            one = f"<{name}>{expression(content)}</{name}>"
        else:
            one = expression(content)
        mark = ("*" if many else "?") if not least else "+" if many else ""
        out.append(f"({one}){mark}" if mark else one)
    return "".join(out)


def content_root(nodes: list) -> str:
    """The paths of the containers that hold the content, one a line; a page's is the first that it has.

    Every place of an article or main, the outermost first (a path without labels, after ``=``); else
    the container with most text slots, then those in its place under other labels.
    """
    slots: Counter = Counter()
    named: list[str] = []

    def walk(part: list, path: str, weight: int) -> None:
        for key, content, _, many in part:
            if key == "#":
                if content is None and path:
                    slots[path] += weight
                continue
            here = path
            if key[0] == "<" and " " in key:
                name, here = key[1:-1].split(" ", 1)
                if name in CONTENT:
                    named.append(here)
            walk(content, here, weight * (3 if many else 1))

    walk(nodes, "", 1)
    if named:
        return "\n".join(f"={p}" for p in sorted({BARE.sub("", p) for p in named}, key=lambda p: (p.count("/"), p)))
    ranked = sorted(slots, key=lambda p: (-slots[p], p))
    return "\n".join(p for p in ranked if BARE.sub("", p) == BARE.sub("", ranked[0]))


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def host_labels(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, labels): the class and id words of containers that recur on a host's pages, with blanks between."""

    def counted(batches):
        held: Counter = Counter()

        def flushed():
            names, labels = zip(*held, strict=True) if held else ((), ())
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(labels, pa.string()), pa.array(list(held.values()), pa.int64())], ["host", "label", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {""}                             # the page itself
                for found in TOKEN.finditer(page.as_py() or ""):
                    if found["rest"] and "=" in found["rest"] and _is_container(found["name"].lower()):
                        attributes = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(found["rest"])}
                        own.update(_labels(attributes), _labels({"id": attributes.get("id", "")}))
                held.update((name, x) for x in own)
                if len(held) > 100_000:
                    yield flushed()
        yield flushed()

    found = pages.select(host(url).alias("host"), html).mapInArrow(counted, "host string, label string, n bigint")
    found = found.groupBy("host", "label").agg(F.sum("n").alias("n"))
    of = found.where("label = ''").select("host", F.col("n").alias("of"))
    often = (F.col("n") >= F.least(F.lit(2), "of")) & (LABEL_PART * F.col("n") >= F.col("of"))
    return found.join(of, "host").where(often).groupBy("host").agg(
        F.array_join(F.sort_array(F.collect_list("label")), " ").alias("labels")
    )


def _sets():
    """Label sets out of their strings, each made once."""
    held: dict[str | None, frozenset[str]] = {}
    return lambda labels: held[labels] if labels in held else held.setdefault(labels, frozenset((labels or "").split()))


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", labels: DataFrame | None = None) -> DataFrame:
    """(host, wrapper, expression, root): one wrapper per host, from all its pages."""
    labels = host_labels(pages, url, html) if labels is None else labels

    def partial(batches):
        held: dict[str, list] = {}
        seen: dict[str, set] = {}
        kept = _sets()

        def flushed():
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], ["host", "wrapper"]
            )
            held.clear()
            seen.clear()
            return out

        for batch in batches:
            for name, page, keep in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = page_wrapper(page.as_py() or "", kept(keep))
                known = seen.setdefault(name, set())
                mark = hash(json.dumps(own))
                if mark not in known:
                    if len(known) < 4096:
                        known.add(mark)
                    held[name] = merge(held[name], own) if name in held else own
            if len(held) > 10_000:
                yield flushed()
        yield flushed()

    def folded(batches):
        held = None
        for batch in batches:
            for text in batch.column("wrapper").to_pylist():
                own = json.loads(text)
                held = (name, merge(held[1], own)) if held else (name := batch.column("host")[0].as_py(), own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([held[0]]), pa.array([json.dumps(held[1])]), pa.array([expression(held[1])]), pa.array([content_root(held[1])])],
            ["host", "wrapper", "expression", "root"],
        )

    from collections.abc import Iterator

    folded.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    schema = "host string, wrapper string, expression string, root string"
    rows = pages.select(host(url).alias("host"), F.col(html).alias("html")).join(labels, "host", "left")
    parts = rows.select("host", "html", "labels").mapInArrow(partial, "host string, wrapper string")
    parts = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(PARTIALS))).distinct()
    parts = parts.groupBy("host", "part").applyInArrow(folded, schema)
    return parts.groupBy("host").applyInArrow(folded, schema)


def main_text(page: str, root: str, keep: frozenset[str] | None = None) -> str:
    """The text blocks of the first container of ``root`` that holds any, in page order, joined by line feeds."""
    roots = root.split("\n") if root else []
    blocks: list[list[str]] = [[] for _ in range(len(roots) + 1)]      # the last is the whole page
    texts: list[list[str]] = [[] for _ in blocks]
    places: dict[str, list[int]] = {}

    def holding(path: str) -> list[int]:
        bare = BARE.sub("", path) + "/"
        return [i for i, r in enumerate(roots) if (bare.startswith(f"{r[1:]}/") if r[0] == "=" else f"{path}/".startswith(f"{r}/"))] + [len(roots)]

    def flush():
        for block, target in zip(blocks, texts, strict=True):
            if block:
                text = SPACES.sub(" ", "".join(block)).strip()
                if text:
                    target.append(text)
                block.clear()

    for kind, value, path, seen in tokens(page, keep):
        if kind == "text":
            if seen:
                text = entities.unescape(value)
                if path not in places:
                    places[path] = holding(path)
                for i in places[path]:
                    blocks[i].append(text)
        elif kind == "break" or value in BLOCK:
            flush()
    flush()
    return "\n".join(next((x for x in texts if x), []))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page, by the wrapper of its host."""
    scratch = Scratch(pages.sparkSession)
    labels = scratch.keep("labels", host_labels(pages, url, html))
    roots = scratch.keep("wrappers", infer_wrappers(pages, url, html, labels)).select("host", "root")
    roots = scratch.keep("roots", roots.join(labels, "host", "left"))                  # with its own size, for the join

    def taken(html: pa.Array, root: pa.Array, labels: pa.Array) -> pa.Array:
        kept = _sets()
        rows = zip(html, root.to_pylist(), labels.to_pylist(), strict=True)
        return pa.array([main_text(h.as_py() or "", r or "", kept(x)) for h, r, x in rows], pa.string())

    taken.__annotations__ = {"html": pa.Array, "root": pa.Array, "labels": pa.Array, "return": pa.Array}
    rows = pages.select(F.col(id_col), F.col(url), F.col(html).alias("html"), host(url).alias("host")).join(roots, "host", "left")
    rows = rows.select(id_col, url, F.arrow_udf(taken, "string")(F.col("html"), F.col("root"), F.col("labels")).alias("text"))
    return rows.select(id_col, url, "text", F.length("text").cast("bigint").alias("n_chars"))
