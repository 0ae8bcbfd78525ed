import re
import time

import pytest

from augeval.llm.template import TEXT_PAGES, Reader, extract, main_text, templates

PAGE = ('<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{}}</style><script>var a="<p>";</script></head><body><nav><ul><li>'
        '<a href="/a">m{n}</a></li></ul></nav><!-- ad --><div class="ad">buy {n}</div><article><h1>Head {n}</h1><p><b>One &amp; two<br>three'
        '<p>Same line.</p></article><div id="comments"><p>nice {n}</p></div><footer>&copy; x</footer>')


@pytest.mark.parametrize("html,want", [
    ("", ""), ("plain  text\n here", "plain text here"), ("<p>x", "x"), ("a < b", "a < b"), ("<", "<"),
    ("<p>One</p>\n<p> two<b>th</b>ree&nbsp;x </p>", "One\ntwothree x"),
    ("<nav>m<article><p>in an unclosed menu</article>", "in an unclosed menu"),
    ("<main><p>a<aside>s</aside><form>f</form><script>1<2</script></main><p>out", "a"),
    ("<article><p>a<div class='sponsored-box'>x</div><section id=comments><article class=comment>c</article></section><p>b</article>", "a\nb"),
    ("<body><header><h1>Site</h1></header><div class='cookie-notice'>c</div><p>text</p><div hidden>h</div>", "text"),
    ("<article>" + "w " * 50000 + "</article>", ("w " * 50000).strip()),
])
def test_main_text(html, want):
    assert main_text(html, set()) == want


def test_extract_with_host_templates(spark, frame):
    rows = [(k, f"https://h.example/{k}", PAGE.format(n=k), "x") for k in range(8)]
    rows += [(100 + k, f"http://flat.example/{k}", f"<body><div>Our site</div><p>text {k}</p><p>and more {k}", "x") for k in range(TEXT_PAGES)]
    rows += [(None, None, None, None), (200, "http://one.example/", "<article><p>only</article>", None), (200, "http://one.example/", "<article><p>only</article>", None)]
    p = frame(rows, "page_id long, url string, html string, text string")
    got = extract(p).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert text[3] == "Head 3\nOne & two three\nSame line."
    assert text[102] == "text 2\nand more 2"  # text that stands on every page outside an article is template
    assert text[None] == "" and text[200] == "only"
    assert all(r.n_chars == len(r.text) for r in got)
    t = {r.host: r for r in templates(p).collect()}
    assert t["h.example"].n_pages == 8 and "body<article" in t["h.example"].root and "</footer" in t["h.example"].root
    assert extract(frame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("html,want", [
    ('<article class="post has-sidebar"><p>a</article>', "a"), ('<main class="no-sidebar"><p>a</main><p>b', "a"),
    ('<div class="content comments-open"><article><p>a</article></div>', "a"), ('<div class="sidebar-wrapper"><main><p>long text</main></div><p>x', "long text"),
    ('<article><p>a<section id="related-work"><p>b</section><section id="search-methods"><p>c</section></article>', "a\nb\nc"),
    ('<article><p>a<section id="search"><p>b</section><p>x <math><mi>y</mi><mo>=</mo><mn>1</mn></math></article>', "a\nb\nx y=1"),
    ('<article><p>a</article><div class="sidebar"><article><p>teaser</article></div>', "a"),
    ('<article class="teaser-box"><p>t</article><article><p>a</article><article class="comment"><p>c</article>', "a"),
    ('<article class="sidebar"><p>a<div class="ad-300">ad</div><div class="comment-list">c</div></article>', "a"),
])
def test_class_words_are_whole_tokens_and_keep_articles(html, want):
    assert main_text(html, set()) == want


@pytest.mark.parametrize("unit", ['<a "', "<a ", "<a '\"", "</a '", "<!", "<select>", "<textarea>\""])
def test_long_broken_pages_are_read_in_linear_time(unit):
    for tail in ("", "\">", ">"):
        began = time.process_time()
        main_text(unit * 100_000 + tail, set())
        assert time.process_time() - began < 4


def test_tag_ends_match_the_pattern():
    import random
    pattern = re.compile("(?:[^>\"']|\"[^\"]*\"|'[^']*')*>")
    r = random.Random(3)
    for _ in range(400):
        page = "".join(r.choice("<ab\"'> ") for _ in range(r.randrange(30)))
        reader = Reader(page)
        for at in range(len(page) + 1):
            m = pattern.match(page, at)
            reader.ahead = (0, -1)
            assert reader.tag_end(at) == (m.end() if m else -1), (page, at)


@pytest.mark.parametrize("repeat", ["twice", "often"])
def test_repeated_pages_change_no_text(spark, frame, repeat):
    rows = plain_host()
    want = {r.page_id: r.text for r in extract(frame(rows, "page_id long, url string, html string")).collect()}
    more = rows if repeat == "twice" else [(1000 + i, *rows[0][1:]) for i in range(40)]
    got = extract(frame(rows + more, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) + len(more)
    assert all(r.text == want[r.page_id if r.page_id < 1000 else rows[0][0]] for r in got)


def plain_host():
    words = lambda k, n: " ".join(f"w{(k * 31 + i * 17) % 997}x{k}" for i in range(n))
    rows = []
    for k in range(12):
        box = f"<div class=x1><a href=/a>link {k} to</a> <a href=/b>page {k}</a></div><div class=x2>buy {k} now</div>"
        talk = "<div class=x5>" + "".join(f"<div class=x6><p>{words(900 + k * 5 + i, 12)}</div>" for i in range(2 + k % 3)) + "</div>"
        rows.append((k, f"http://plain.example/{k}", f"<body>{box}<div class=x3><h1>Head {k}</h1><div class=x4><p>{words(k, 60)}<p>{words(k + 50, 60)}</div></div>{talk}<div class=x7>by {k}</div></body>"))
        inner = f"<div class=y1>Read this first.</div><section id=related><a href=/{k}>other {k}</a></section><section id=search><p>{words(k + 400, 50)}</section>"
        rows.append((100 + k, f"http://held.example/{k}", f"<body>{box}<article class='p-{k} has-sidebar'><p>{words(k, 60)}<p>Shared passage.{inner}</article>{talk}</body>"))
    return rows


def test_slots_choose_where_names_and_texts_say_nothing(spark, frame):
    words = lambda k, n: " ".join(f"w{(k * 31 + i * 17) % 997}x{k}" for i in range(n))
    got = {r.page_id: r.text for r in extract(frame(plain_host(), "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == f"Head {k}\n{words(k, 60)}\n{words(k + 50, 60)}"
        assert got[100 + k] == f"{words(k, 60)}\nShared passage.\n{words(k + 400, 50)}"
