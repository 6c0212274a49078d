"""HTML extraction on written pages and on the small table."""

import html
import re
import tracemalloc

from coldlake.llm import html_extract
from coldlake.llm.html_extract import extract, extract_pages, vote

PAGE = """<!doctype html><html><head><title>T</title><style>p{color:red}</style><script>var a="<p>no</p>";</script></head>
<body class="x1"><header class="site"><h1>Site name</h1><nav><ul><li><a href="/">Home</a></ul></nav></header>
<div id="cookie-notice">We use cookies. Accept?</div>
<div class="wrap col-12"><aside>Side text that is quite long and has words in it</aside>
<div class="post-1234 entry"><h1>Title &amp; more</h1><p>First   para<br>graph with <b>bold <i>and</b> nested</i> text, long enough to matter here.
<p>Second &eacute; paragraph&nbsp;with <a href="#">a link</a> in it, and so on and so on.</p>
<ul><li>item one<li>item two</ul><table><tr><td>cell a<td>cell b</table><blockquote>A quote.</blockquote>
<div class="ad-box">Buy now</div><form><input value="x">Subscribe <button>Go</button></form></div>
<section id="comments"><h2>Comments</h2><div class="comment-list"><p>A very long reader comment that goes on and on and on and on for a while.</p>
<p>Another reader comment, even longer than the one above it, and longer still, with many words.</p></div></section></div>
<footer>(c) 2026</footer></body></html>"""
WANT = """Title & more
First para graph with bold and nested text, long enough to matter here.
Second é paragraph with a link in it, and so on and so on.
item one
item two
cell a
cell b
A quote."""


def test_written_page():
    path, _ = vote(PAGE)
    assert path.endswith("div.entry.post-#")
    assert extract(PAGE, path) == (WANT, True)
    assert extract(PAGE, None) == (WANT, False)


def test_host_vote_decides(spark):
    short = "<body><div class='post-9 entry'><p>Tiny text.</p></div><div class='box'><p>%s</p></div></body>" % ("Much longer other text. " * 20)
    pages = [(k, "http://h.org/%d" % k, PAGE.replace("1234", str(k)), "own") for k in range(5)]
    other = PAGE.replace('<div class="wrap col-12">', "").replace("</section></div>", "</section>")
    pages += [(10, "http://other.org/", short, "own"), (11, None, PAGE, "own"), (12, "", None, "own"), (13, "http://h.org/", "", "own")]
    pages += [(14, "http://h.org/z", "<p>unclosed <b>markup &lt;tag&gt; <a href='x>y'>l", "own"), (15, "http://h.org/q", other, "own"), (0, pages[0][1], pages[0][2], "own")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, row string")
    rows = extract_pages(frame).collect()
    assert len(rows) == len(pages)
    got = {r["page_id"]: r for r in rows}
    assert all(got[k]["text"] == WANT and got[k]["by_consensus"] for k in range(5))
    assert got[11]["text"] == WANT and got[12]["text"] == got[13]["text"] == "" and got[13]["n_chars"] == 0
    assert got[14]["text"] == "unclosed markup <tag> l" and got[15]["text"] == WANT
    assert "Much longer" in got[10]["text"]
    assert extract_pages(spark.createDataFrame([], frame.schema)).collect() == []


def test_inline_boilerplate_does_not_split_a_block():
    page = "<article><p>One <button>Go</button><span class='ad'>buy <i>now</i></span> two <span hidden>x</span>three.<p>Four</article>"
    assert extract(page, "body>article") == ("One two three.\nFour", True)


def test_long_page():
    body = "".join(f"<p>Paragraph number {k} of a very long article.</p>" for k in range(20_000))
    text, _ = extract(f"<body><article>{body}</article></body>", "body>article")
    assert text.count("\n") == 19_999


def test_small_table(spark):
    """Against a plain cut of the article element, by which the table's pages are laid out."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract_pages(pages).collect():
        inner = re.search(r"<article>(.*)</article>", raw[r["page_id"]], re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        plain = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in blocks]
        assert r["text"] == "\n".join(b for b in plain if b)
        assert r["n_chars"] == len(r["text"])


def test_nothing_is_left_behind_on_the_way_down(spark):
    long = "".join(f"<p>Paragraph {k} of the body, long enough to outweigh the rest.</p>" for k in range(20))
    text = "\n".join(f"Paragraph {k} of the body, long enough to outweigh the rest." for k in range(20))
    pages = {
        f"<body><nav>Menu</nav><article><h1>Title</h1><p>Lead.</p><div class=body>{long}</div></article></body>": "Title\nLead.\n",
        f"<main><p>Lead.</p><section>{long}</section></main>": "Lead.\n",
        f"<div class=page><div class=intro>Short introduction.</div><div class=body>{long}</div></div>": "Short introduction.\n",
        f"<div class=page><p>Short introduction.</p><section>{long}</section></div>": "Short introduction.\n",
        # a bare list of links does not hold the descent up
        f"<div class=top><a href=/>Home</a> | <a href=/x>More</a></div><div class=body>{long}</div>": "",
    }
    rows = [(k, f"http://h{n}.org/{k}", page) for n, page in enumerate(pages) for k in (3 * n, 3 * n + 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in extract_pages(frame).collect():
        assert r["text"] == list(pages.values())[r["page_id"] // 3] + text


def test_markup_that_ends_itself():
    for piece in ("<svg width=1 />", "<object data='x'/>", "<!-->", "<!--->", "<!-- x > y -->", "<svg><path/>no</svg>"):
        page = f"<main><p>One {piece} two.</p><p>Three, and so on.</p><!-- end --></main>"
        assert extract(page, None)[0] == "One two.\nThree, and so on.", piece


def test_names_are_suspicions():
    words = "".join(f"<p>Sentence {k} of the article, which is about many things.</p>" for k in range(6))
    text = "\n".join(f"Sentence {k} of the article, which is about many things." for k in range(6))
    for name in ("share-price-report", "side", "side-by-side", "ad-hoc related-work", "search", "form-of-government"):
        assert extract(f"<body><nav>Menu</nav><main><div class='{name}'>{words}</div></main></body>", None)[0] == text, name
    # the part of an article in such a container stays, a row of links or a button's words go
    rest = "<p>Rest of the article that is as long as a sentence can be.</p>" * 20
    kept = extract(f"<article>{rest}<div class='side-by-side'>{words}</div></article>", None)[0]
    assert kept.endswith(text)
    gone = "<div class='social-share'><p>Share this page with everyone that you know, now, today.</p></div><div class='share-this'><a href=/>All the places to share it</a></div>"
    assert extract(f"<article>{words}{gone}<div class=comments>{rest}</div></article>", None)[0] == text
    assert extract(f"<form id=aspnet>{'<article>' + words + '</article>'}</form>", None)[0] == text


def test_vote_overrules_names(spark):
    long = "".join(f"<p>Paragraph {k} of the body of the page, long enough.</p>" for k in range(9))
    odd = "<div class=top><p>A long text of another kind. %s</p></div>" % ("It goes on and on. " * 60)
    pages = [(k, f"http://n.org/{k}", f"<body><div class=related>{long}</div></body>") for k in range(4)]
    pages.append((9, "http://n.org/9", f"<body>{odd}<div class=related>{long}</div></body>"))
    got = extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len({r["text"] for r in got}) == 1 and got[0]["text"].startswith("Paragraph 0")


def test_deep_page_in_bounded_memory():
    page = "<div class=a>" * 40_000 + "<p>Deep down there is a sentence.</p>" + "</div>" * 40_000
    tracemalloc.start()
    path, _ = vote(page)
    assert extract(page, path) == ("Deep down there is a sentence.", True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6


def test_winners_too_large_to_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", PAGE) for k in range(20)], "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(html_extract, "BROADCAST_LIMIT_BYTES", 1)
    assert {(r["text"], r["by_consensus"]) for r in extract_pages(pages).collect()} == {(WANT, True)}
