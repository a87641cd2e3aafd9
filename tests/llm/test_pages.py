"""WARC conversion and main text."""

import base64
import gzip
import hashlib
import random

import pytest

from asofkit.llm import sitetree, warc

V1 = b"filedesc://x.arc 0.0.0.0 20010203040506 text/plain 76\n1 0 InternetArchive\nURL IP-address Archive-date Content-type Archive-length\n\n"


def block(body, key=None):
    return b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n" + (f"X-Archive-Key: {key}\r\n".encode() if key is not None else b"") + b"\r\n" + body


def test_versions_of_header_lines():
    body = block(b"a\nb\r\n\r\nWARC/1.0\r\n")
    one = warc.arc_head("a.arc", "20240101000000", 1) + b"\n" + warc.arc_record(1, "http://h/", "1.2.3.4", "20240101000000", "text/html", body) + b"\n"
    two = warc.arc_head("a.arc", "20240101000000", 2) + b"\n" + warc.arc_record(2, "http://h/", "1.2.3.4", "20240101000000", "text/html", body, offset=9, name="a.arc") + b"\n"
    for data, version, fields in ((one, 1, 5), (two, 2, 10), (gzip.compress(two), 2, 10)):
        (r,) = warc.read_arc(data)
        assert (r.version, len(r.fields), r.block, r.fields["URL"]) == (version, fields, body, "http://h/")
    for bad in (one[:-30], one.replace(b"text/html", b"text html", 1), one.replace(b"\n1 0", b"\n7 0", 1)):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_synthesised_fields():
    r = warc.ArcRecord(1, {"URL": "http://h/x", "IP-address": "1.2.3.4", "Archive-date": "20010203040506", "Content-type": "text/html", "Archive-length": "9"}, block(b"\xff\x00body", 7))
    (w,) = warc.read_warc(warc.convert(r) + b"\r\n\r\n")
    sha = base64.b32encode(hashlib.sha1(b"\xff\x00body").digest()).decode()
    assert w.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and w.headers["WARC-Payload-Digest"] == f"sha1:{sha}"
    assert (w.headers["WARC-Type"], w.headers["WARC-IP-Address"], w.block) == ("response", "1.2.3.4", r.block)
    assert w.headers["WARC-Record-ID"] == warc.record_id("http://h/x", "20010203040506", "7", sha)
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z"
    assert warc.warc_type("dns:h", "text/dns", b"x") == "resource"


def test_pages_through_archives(spark, tmp_path):
    html = "<p>same é\r\n\r\n</p>"
    rows = [(1, "http://a/1", html), (2, "http://a b/\n2", html), (9, None, html), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", html), (5, "http://f", "x" * 300_000), (6, "http://g", "WARC/1.0\r\n\r\n"), (9, None, html)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_arc(pages, str(tmp_path / "arc"))
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    got = warc.read_archives(spark, str(tmp_path / "warc")).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    bodies = {k: (h or "").encode() for k, _, h in rows}
    for r in got:
        body = bodies[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == body)
    kinds = {}
    for r in got:
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert kinds[1] == kinds[2] == kinds[None] == [("revisit", 9)]
    assert ("response", None) in kinds[9] and all(k in (("response", None), ("revisit", 9)) for k in kinds[9])
    assert (kinds[3], kinds[4], kinds[5]) == ([("revisit", 4)], [("response", None)], [("response", None)])
    warc.arc_to_warc(spark, str(tmp_path / "arc"), str(tmp_path / "all"), least_bytes=10**9)
    assert warc.read_archives(spark, str(tmp_path / "all")).filter("record_type <> 'response'").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="page">
<header><h1>Site</h1></header><nav><ul><li>menu</ul></nav><div id="cookie-notice">cookies</div><div class="has-sidebar"><main><article>
<h1>Head &amp; <b>line</b></h1><p>One<br>two &#8217;s   three<p>Four <a href="x>y">link</a><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<!-- <p>note</p> --><form><p>form</p></form><section class="comments"><article><p>a comment</p></article></section><div class="ad">buy</div></article></main>
<aside>side</aside></div><footer>foot</footer></body></html>"""


def test_blocks_of_an_article():
    assert sitetree.Page(PAGE).text() == "Head & line\nOne two ’s three\nFour link\na\nb\nc\nd"
    assert sitetree.Page(None).text() == sitetree.Page("").text() == sitetree.Page("<nav>x</nav>").text() == ""
    assert sitetree.Page("plain <b>words").text() == "plain words"
    assert sitetree.Page("<div>a</div>b<p>c").text() == "a\nb\nc"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<form id=aspnetForm><article><p>The whole article.</p></article></form>", "The whole article."),
        ("<main><h1>Title</h1><p>Body one.</p><article><p>Teaser.</p></article><p>Body two.</p></main>", "Title\nBody one.\nTeaser.\nBody two."),
        ("<div class='post-share'><p>All the text.</p></div>", "All the text."),
        ("<div id=alert-story><p>A long story about alerts.</p></div><p>End</p>", "A long story about alerts.\nEnd"),
        ("<div class='widget-area'><p>All the text.</p></div>", "All the text."),
        ("<div class=notice-board><article><p>Text.</p></article></div><div class=notice>cookies</div>", "Text."),
        ("<p>Some text of an article.</p><div class=share>share this</div><form>name</form>", "Some text of an article."),
        ("<p>Short.</p><div class=comments><article>A comment longer than the article itself.</article></div>", "Short."),
        ("<header><h1>Site</h1></header><main><header><h1>Title</h1></header><p>Text.</p><aside>beside</aside></main>", "Title\nText."),
        ("<span><div>in a span</div></span><span class=ad>buy</span><p>more text here", "in a span\nmore text here"),
        ("<div role=navigation>menu</div><div hidden>no</div><p style='display: none'>no</p><p>yes", "yes"),
        ("<!-- a --><p>a&nbsp;&amp;b &lt;c&gt;\t d</p>" + "<div>" * 300 + "deep", "a &b <c> d\ndeep"),
    ],
)
def test_rules(html, text):
    assert sitetree.Page(html).text() == text


def naive_low(pages):
    """host -> nodes (paths) in branches of low importance, by plain counting."""
    from collections import Counter, defaultdict
    from math import log

    seen, styles, texts, above = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), {}
    for host, html in pages:
        page = sitetree.Page(html)
        for path in {e.path for e in page.elements}:
            seen[host][path] += 1
            above[path] = path.rsplit("/", 1)[0]
        for x in {(e.path, tuple(e.children)) for e in page.elements}:
            styles[host, x[0]][x[1]] += 1
        for x in {(e.path, t) for e, t in page.blocks if e.path}:
            texts[host, x[0]][x[1]] += 1
    out = {}
    for host, count in seen.items():
        judged = {p for p, n in count.items() if n >= sitetree.LEAST_PAGES}

        def importance(p):
            n, s = count[p], sum(styles[host, p].values())
            style = -sum(c / s * log(c / s) for c in styles[host, p].values()) / log(n)
            own = texts[host, p]
            content = 1 - sum(log(c) for c in own.values()) / len(own) / log(n) if own else None
            below = [importance(q) for q in sorted(judged) if above[q] == p]
            if not below:
                return 1.0 if content is None else content
            share = sitetree.DAMPING ** len(below)
            below += [content] if content is not None else []
            return (1 - share) * style + share * sum(below) / len(below)

        high = {p for p in judged if importance(p) >= sitetree.LOW}
        low = {p for p in judged - high if not any(q.startswith(p + "/") for q in high)}
        if low:
            out[host] = low
    return out


def test_importance_against_plain_counts(spark):
    r, pages = random.Random(4), []
    for i in range(240):
        side = "".join(f"<div class=c{j}><p>{r.choice(['same', 'same', f'own {i}']) if j % 2 else 'fixed'}</p></div>" for j in r.sample(range(4), r.randint(1, 4)))
        pages.append((f"h{i % 5}", f"<body><div class=menu-x><ul><li>a<li>b</ul></div>{side}<div class=t><p>text {i}<p>{r.choice(['x', 'y'])}</div>{'<table><tr><td>1</table>' if i % 3 else ''}</body>"))
    df = spark.createDataFrame(pages + [("few", "<p>x")] * 3 + [("few", None)], "host string, html string")
    got = {x["host"]: set(x["low"]) for x in sitetree.low_nodes(df).collect()}
    assert got == {h: {sitetree.node_hash(p) for p in low} for h, low in naive_low(pages).items()} and len(got) == 5


def test_clashing_names_of_pages(spark):
    names = ["page_id", "url", "html", "_host", "_host_", "_site", "_low", "text", "n_chars"]
    df = spark.createDataFrame([(1, "http://a/", "<p>x", 1, 2, 3, 4, 5, 6)], "page_id int, url string, html string, _host int, _host_ int, _site int, _low int, text int, n_chars int")
    assert sitetree.extract_text(df).first().asDict() == dict(zip(names, (1, "http://a/", "<p>x", 1, 2, 3, 4, "x", 1)))


def test_site_templates_are_cut(spark):
    """What is the same on all pages of a host goes, though nothing in its markup says so."""
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div class=alpha><p>Welcome here</p></div><div class=beta><p>Text {i} of its own, number {i * 7}.</p></div></body>") for i in range(60)]
    rows += [(100, None, None), (101, "http://alone.example/", "<div class=alpha><p>Welcome here</p></div>"), (102, "no url", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'mine' as text")
    got = {r["page_id"]: r for r in sitetree.extract_text(df).collect()}
    assert all(got[i]["text"] == f"Text {i} of its own, number {i * 7}." for i in range(60))
    assert (got[100]["text"], got[100]["n_chars"], got[101]["text"], got[102]["text"]) == ("", 0, "Welcome here", "")
    assert sitetree.extract_text(df.limit(0)).count() == 0
