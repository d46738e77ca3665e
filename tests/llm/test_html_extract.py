import random
import re
import time
from collections import Counter

from chunkwright.llm import html_extract

PAGES = "page_id long, url string, html string"


def page(i, body, extra="", wrap=("<article>", "</article>")):
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><style>p{{a:b}}</style><script>var t="</p><article>x</article>";</script></head><body>'
        f'<header id="top">Site {i}</header><nav><ul><li><a href="/a">Home</a></li><li>Link {i}</li></ul></nav><!-- c {i} --><div class="ad">Buy {i} now</div>'
        f'<div class="cookie-notice">We use cookies</div><div class="layout">{wrap[0]}{body}{wrap[1]}<aside>See also {i}</aside>{extra}</div>'
        f'<form><label>Mail</label><input name="q"></form><footer>&copy; {i}</footer>'
    )


def article(r, n):
    words = ["alpha", "beta", "gam&amp;ma", "d&eacute;lta", "&#x4e2d;", "zeta"]
    return [" ".join(r.choice(words) for _ in range(r.randint(3, 30))) for _ in range(n)]


def plain(parts):
    return " ".join(parts).replace("&amp;", "&").replace("&eacute;", "é").replace("&#x4e2d;", "中")


def test_article_with_its_surroundings_removed(spark, tables):
    r = random.Random(1)
    rows, expected = [], {}
    for i in range(30):
        parts = article(r, 6)
        body = f"<h1>{parts[0]}</h1><p><b>{parts[1]}<br><p>{parts[2]}</p><p>\n {parts[3]} \t</p><ul><li>{parts[4]}<li>{parts[5]}</ul><div class='share'>Share</div><script>x()</script>"
        wrap = (("<article>", "</article>"), ('<div class="post-body" id="p1">', "</div>"), ("<main>", "</main>"))[i % 3]
        rows.append((i, f"http://h{i % 3}.example/{i}", page(i, body, f'<section id="comments"><p>{"nice " * 40}</p></section>', wrap)))
        expected[i] = plain(parts)
    rows += [(100, None, None), (101, "http://h0.example/", ""), (102, "x", "just text"), (103, "http://h0.example/q", "<p>one</p><p>two<b>three</b></p>"), (3, rows[3][1], rows[3][2])]
    got = html_extract.op2(spark, tables(pages=(rows, PAGES))).collect()
    assert len(got) == len(rows)
    for x in got:
        if x["page_id"] in expected:
            assert x["text"] == expected[x["page_id"]], x["page_id"]
        assert x["n_chars"] == len(x["text"])
    texts = {x["page_id"]: x["text"] for x in got}
    assert (texts[100], texts[101], texts[102], texts[103]) == ("", "", "just text", "one twothree")


def test_copies_on_a_host_keep_their_article():
    same = page(1, "<p>words of the article</p>")
    assert html_extract.extract_block([same] * 5) == ["words of the article"] * 5


def test_classes_have_equal_vectors_and_one_order():
    pages = [html_extract.Page(page(i, "<p>a</p>" * (i + 1))) for i in range(4)] + [html_extract.Page("")]
    classes = html_extract.equivalence_classes(pages)
    for on, tokens in classes:
        for i in on:
            assert [t for t in pages[i].order if t in set(tokens)] == tokens
    skeleton, nested = html_extract.template(pages)
    key = pages[0].keys[pages[0].tags.index("article")]
    assert key in skeleton and pages[0].keys[pages[0].tags.index("p")] not in skeleton
    assert html_extract.main_slot(pages)[0] == key


def plain_page(r, i):
    """No article tag, no telling name: two columns, a part before and one after that vary, and a notice on every page."""
    words = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet elit sed do magna".split()) + str(r.randrange(99)) for _ in range(n))
    parts = [words(30) for _ in range(r.randint(2, 5))]
    blocks = [f"<p>{x}</p>" for x in parts]
    blocks.insert(1, '<div class="kf">All texts are free to use, see the terms.</div>')
    optional = '<div class="kg"><p>Read on tomorrow</p></div>' if i % 5 else ""
    html = f"<html><body><div class=ka><span>{words(4)}</span><span>One site of many</span></div><div class=kb><div class=kc>{words(8)}</div><div class=kd>{''.join(blocks)}{optional}</div></div><div class=ke>{words(6)}</div></body></html>"
    return html, " ".join(parts)


def deduced(sources):
    """Brute force by text alone: of the div with most that varies, the paragraphs and divs that no other page has."""
    found = [re.findall(r"<(p|div)(?: class=\"?(\w+)\"?)?>([^<]+)", s) for s in sources]
    times = Counter(x for f in found for x in set(f))
    held = Counter()
    for f in found:
        for tag, name, text in f:
            held[tag if tag == "p" else name] += len(text) * (times[tag, name, text] == 1)
    best = held.most_common(1)[0][0]
    return [" ".join(x[2] for x in f if (x[0] if x[0] == "p" else x[1]) == best and times[x] == 1) for f in found]


def test_template_alone_finds_the_text_of_plain_pages(monkeypatch):
    r = random.Random(5)
    sources, expected = map(list, zip(*(plain_page(r, i) for i in range(20)), strict=True))
    assert html_extract.extract_block(sources) == expected == deduced(sources)
    odd = ["", "<html><body><h1>404</h1></body></html>"]
    got = html_extract.extract_block([odd[0], *sources, odd[1]])
    assert got == ["", *expected, "404"]
    monkeypatch.setattr(html_extract, "_is_other", lambda *a: False)
    assert html_extract.extract_block(sources) == expected
    monkeypatch.setattr(html_extract, "template", lambda pages: ([], {}))
    assert all(a != b for a, b in zip(html_extract.extract_block(sources), expected, strict=True))


def test_article_tag_does_not_override_the_slot():
    r = random.Random(6)
    sources, expected = zip(*(plain_page(r, i) for i in range(12)), strict=True)
    framed = [s.replace("<div class=ka>", "<article><p>Pinned: how to write for us</p></article><div class=ka>") for s in sources]
    assert html_extract.extract_block(framed) == list(expected)


def test_near_copies_keep_their_article():
    words = " ".join(f"w{i}" for i in range(200))
    sources = [page(i, f"<p>{words} {i}</p><p>{words[::-1]}</p>") for i in range(8)]
    assert html_extract.extract_block(sources) == [f"{words} {i} {words[::-1]}" for i in range(8)]


def test_deep_and_unclosed_markup_takes_linear_time():
    def seconds(source):
        at = time.perf_counter()
        html_extract.extract_block([source])
        return time.perf_counter() - at

    for unit in ("<div>", "<a ", "<b>x<p></p>", "<li>x", '<a "', "<!", "</x>", "<i></b>"):
        assert seconds(unit * 16_000) < 10 * seconds(unit * 4_000) + 0.5, unit


def test_large_host_is_many_blocks(spark):
    r = random.Random(2)
    rows = [(i, "http://one.example/" + str(i), page(i, "<p>" + " ".join(article(r, 2)) + "</p>")) for i in range(300)]
    out = html_extract.extract_main_text(spark.createDataFrame(rows, PAGES), block=16).collect()
    assert len(out) == 300 and all(x["text"] and "cookies" not in x["text"] and "Buy" not in x["text"] for x in out)


def test_long_and_broken_markup():
    texts = html_extract.extract_block(["<article>" + "<p>w" * 20000, "<div><<<>> & &bogus; </div", "<p>a<!-- never closed"])
    assert texts[0].count("w") == 20000 and texts[2] == "a"


def test_empty_table(spark, tables):
    assert html_extract.op2(spark, tables(pages=([], PAGES))).collect() == []
