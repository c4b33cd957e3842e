"""HTML extraction, quotation links and license scans."""

import html as entities
import re

from newsops.llm import licenses, quotes, wrappers
from newsops.llm.common import table


def test_main_text_of_every_page(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r for r in wrappers.extract(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", row.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        text = "\n".join(x for x in blocks if x)
        assert got[row.page_id].text == text and got[row.page_id].n_chars == len(text) and got[row.page_id].url == row.url


def test_other_page_shapes(spark):
    shell = (
        '<html><body><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use</div><nav>n</nav>'
        '<div class="post"><h1>T{0}</h1><p>a &amp; b{0}<br>c<p>second <b>bold</b> x&#33;<form><input>f</form>'
        '<ul><li>one{0}<li>two</ul></div><aside>s</aside><section id="comments"><p>c1</p></section><footer>f</footer>'
    )
    rows = [(i, f"http://x.org/{i}", shell.format(i)) for i in range(4)]
    rows += [(10, None, None), (11, "http://y.org", ""), (12, "not a url", "plain  text"), (13, "http://y.org", "<p>a<p>b"), (13, "http://y.org", "<p>a<p>b")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, host string")
    got = wrappers.extract(docs).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert text[2] == "T2\na & b2\nc\nsecond bold x!\none2\ntwo"
    assert (text[10], text[11], text[12], text[13]) == ("", "", "plain text", "a\nb")
    assert wrappers.extract(docs.limit(0)).count() == 0


def test_labels_of_single_pages_do_not_part_a_host(spark):
    shell = '<body class="postid-{0} blog"><div class="wrap">{1}<div class="extra"><p>Extra {0}</p></div></div></body>'
    rows = [(i, "http://w.org/a", shell.format(i, f'<article class="post-{i}"><p>Text {i}</p></article>')) for i in range(80)]
    rows += [(100 + i, "http://v.org/a", shell.format(i, f'<div class="post-{i} entry"><p>Text {i}</p><p>More {i}</p></div>')) for i in range(80)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(docs).collect()}
    assert got == {i: f"Text {i}" for i in range(80)} | {100 + i: f"Text {i}\nMore {i}" for i in range(80)}
    held = {r.host: r for r in wrappers.infer_wrappers(docs).collect()}
    assert all(len(r.wrapper) < 2000 and "post-" not in r.wrapper for r in held.values())


def test_words_on_content_do_not_drop_it(spark):
    page = (
        '<article><p class="lead header">Lead {0}</p><h2 id="related-work">Work {0}</h2><section id="impact-{0}"><p>A {0}</p></section>'
        '{1}<div id="comments"><p>c</p></div><div class="share-bar">s</div><div id="sidebar-left">n {0}</div></article>'
    )
    rows = [(i, "http://a.org", page.format(i, '<section id="social-impact"><p>S</p></section>' if i == 3 else "")) for i in range(9)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(docs).collect()}
    assert got == {i: f"Lead {i}\nWork {i}\nA {i}" + "\nS" * (i == 3) for i in range(9)}


def test_wrapper_stays_small_whatever_the_order():
    keys = [f"<div class='k{i}'><p>x{i}</p></div>" for i in range(40)]
    held = wrappers.page_wrapper("".join(keys))
    for i in range(1, 40):
        held = wrappers.merge(held, wrappers.page_wrapper("".join(keys[i:] + keys[:i])))
    assert len(str(held)) < 3 * len(str(wrappers.page_wrapper("".join(keys))))


def test_wrapper_is_an_expression_of_the_host():
    pages = [f"<ul>{'<li>x' * n}</ul><p>{n} same</p>{'<hr>' * (n % 2)}<div><b>{n}</b></div>" * (1 + n // 4) for n in (1, 3, 5)]
    held = wrappers.page_wrapper(pages[0])
    for page in pages[1:]:
        held = wrappers.merge(held, wrappers.page_wrapper(page))
    assert "#PCDATA" in wrappers.expression(held) and "|" not in wrappers.expression(held)
    assert wrappers.merge(held, wrappers.page_wrapper(pages[1])) == held          # nothing new to learn


def test_quotations_meet_their_originals(spark):
    rows = [
        (1, 0, "a", "The plan is to ship on Friday. Nobody objected so far."),
        (1, 1, "b", "I disagree with the plan completely."),
        (1, 2, "c", "On Monday a wrote:\n> The plan is to ship\n> on Friday. Nobody objected so far.\n\nFine with me then."),
        (1, 3, "a", ">> The plan is to ship on Friday.\n> Fine with me then.\nThanks a lot."),
        (1, 4, "b", "And an unrelated remark."),
        (2, 0, "d", "> I disagree with   the PLAN completely.\nWhy so, may I ask?"),
        (2, 1, "d", "> never said by anyone at all here\nHello"),
        (3, None, None, None), (None, 1, "x", ""), (None, 1, "x", ""),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as linked", "1 as level")
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotations(docs).collect()}
    assert got[1, 2].linked and (got[1, 2].reply_to_conv, got[1, 2].reply_to_turn) == (1, 0)
    assert got[1, 2].text == "Fine with me then." and got[1, 2].n_quoted == 2
    assert (got[1, 3].reply_to_turn, got[1, 3].max_level) == (2, 2)
    assert [(s.level, s.turn) for s in got[1, 3].sources] == [(1, 2), (2, 0)]
    assert not got[1, 4].linked and got[1, 4].reply_to_turn == 3
    assert (got[2, 0].reply_to_conv, got[2, 0].reply_to_turn) == (1, 1)
    assert not got[2, 1].linked and got[2, 1].text == "Hello"
    assert [got[1, t].reply_order for t in range(5)] == [1, 2, 3, 4, 5]
    assert quotes.link_quotations(docs).count() == len(rows)
    assert quotes.link_quotations(docs.limit(0)).count() == 0


def test_short_and_restated_quotations_keep_their_link(spark):
    rows = [
        (1, 0, "a", "Come on?"), (1, 1, "b", "Yes, I do."), (1, 2, "a", "Something else."), (1, 3, "c", "> Yes, I do.\nGood."),
        (2, 0, "d", "> The committee has met on Monday.\n\nThe committee has met on Monday."),
        (2, 1, "d", "The committee has met on Monday."),
        (5, 0, "e", "The committee has met on Monday."), (5, 1, "e", "> Come on?\nNo."),
        (6, 0, "f", "我们明天去"), (6, 1, "f", "好"), (6, 2, "f", "> 我们明天去\n同意"),
    ]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.linked, r.reply_to_conv, r.reply_to_turn) for r in quotes.link_quotations(docs).collect()}
    assert got[1, 3] == (True, 1, 1) and got[6, 2] == (True, 6, 0)
    assert got[2, 0] == (True, 5, 0)
    assert not got[5, 1][0]                                     # too short to say anything about another conversation


def test_licenses_are_found_whole_and_edited(spark):
    filler = " ".join(f"w{i}" for i in range(150))
    mit = licenses.TEMPLATES["MIT"]
    rows = [
        (1, f"{filler}\n{mit}\n{filler}"), (2, mit.replace("sublicense", "").replace("copyright", "(c)").upper()),
        (3, f"{filler} Released under the\nMIT license! {filler}"), (4, f"{licenses.TEMPLATES['GPL-3.0']} {licenses.TEMPLATES['BSD-2-Clause']}"),
        (5, " ".join(mit.split()[:40])), (6, None), (7, ""), (8, filler), (9, "license"), (None, licenses.TEMPLATES["CC0-1.0"]),
        (3, f"{filler} Released under the\nMIT license! {filler}"),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {1: {"MIT"}, 2: {"MIT"}, 3: {"MIT-notice"}, 4: {"GPL-3.0", "BSD-2-Clause"}, None: {"CC0-1.0"}}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_whole_license_texts(spark):
    texts = {k: v for k, v in licenses.TEMPLATES.items() if k.endswith("-text") or k in ("BSD-3-Clause", "ISC", "Zlib", "BSL-1.0")}
    filler = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(k, f"{filler} {v} {filler}") for k, v in texts.items()] + [("none", filler)], "doc_id string, text string")
    got = {}
    for r in licenses.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert len(texts) == 11 and set(got) == set(texts) and all(k in v for k, v in got.items())
    assert all(len([x for x in v if x.endswith("-text")]) <= 1 for v in got.values())


def test_anchors_lose_nothing():
    chosen = set(licenses.anchors(licenses.TEMPLATES))
    for text in licenses.TEMPLATES.values():
        words = licenses._words(text)
        grams = {tuple(words[i:i + 3]) for i in range(len(words) - 2)}
        assert sum(not set(g) & chosen for g in grams) < licenses.MIN_CONTAINED * len(grams)
