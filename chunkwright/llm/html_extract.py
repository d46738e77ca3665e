"""Main text of web pages by equivalence-class template deduction.

Pages of one host are read together, in blocks of at most ``BLOCK`` pages.  A
page is a sequence of tokens: elements, told apart by their path from the root
(names, classes and ids), and words, told apart by the path they stand in.
Tokens that occur equally often on every page of a block (the same occurrence
vector, zeros included, so odd pages only add zeros) form an equivalence class.
Classes of tokens that occur once on at least ``SUPPORT`` of the pages, in the
same order on each, are valid.  The largest is the skeleton of the template;
valid classes that lie whole inside one gap of it are nested there.  What lies
between template tokens are slots.

The main slot is that of the innermost skeleton element that still holds most
of what varies over the pages.  Inside it, elements of nested classes whose
words all belong to the template (a notice or a byline that every page
repeats) go, unless that were most of the slot, as on copies of one page.  What
varies and yet is no article (reader comments, adverts, forms, menus, sidebars)
no template can tell; such subtrees go by tag, ARIA role, class or id.

A page alone in its block, or one that lacks the main element, is its own
template: its ``article``, ``main`` or the element with most text is taken.

Blocks are dealt by (host, part of host), where a host has as many parts as
its pages need (counted first, map-side), so a frequent host is many blocks.

Defined cases: null html is the empty page with empty text; pages without a
host form blocks of their own; identical rows are extracted alike, one row
each; broken markup is read as far as it goes (unclosed tags, no body), in time
linear in its length; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwright.llm.common import materialise, pick, shuffle_partitions, table, tidied
from chunkwright.llm.runs import whole_runs

BLOCK = 64
#: Of what varies, the share that the main element must hold; of the pages, the share that a class must occur on; of the
#: main slot, the share that template words may have.
SHARE, SUPPORT, LITTLE = 0.6, 0.6, 0.5
_SCHEMA = "page_id long, url string, text string, n_chars long"

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/><]*+)((?:[^><\"']++|<(?![A-Za-z/!])|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text in a line; all others begin and end blocks.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag closes if it is still open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: End tags that close nothing outside the nearest of these three: article, main, body.
_STRAY = frozenset("b i p span em strong a font".split())
_SCOPE = frozenset("table ul ol dl body html article section div main td th li blockquote".split())
_OTHER_TAGS = frozenset("nav header footer aside form button select dialog menu head".split()) | _RAW
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside "
    "related recommended recommendations comment comments commentlist respond reply replies discussion disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social pagination pager skip disclaimer paywall survey poll".split()
)
#: These count outside articles only, and not beside a word for content.
_PAGE_NAMES = frozenset("banner header masthead topbar footer colophon rail widget widgets alert toolbar copyright legal tags search".split())
_CONTENT_NAMES = frozenset("article body content entry main post story text".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}


def _is_other(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether an element's role is not the article's."""
    if tag in _OTHER_TAGS and not (tag == "header" and inside_article):
        return True
    if attributes.get("role", "").lower() in _OTHER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(names)}
    return bool(words & _OTHER_NAMES) or bool(words & _PAGE_NAMES) and not inside_article and not words & _CONTENT_NAMES


class Page:
    """Elements in order of their opening: key of the path, parent, depth, role; and text pieces with their element."""

    def __init__(self, source: str):
        self.keys, self.parents, self.depth, self.other, self.tags = [0], [-1], [0], [False], [""]
        self.pieces: list[tuple[int, str, bool]] = []  # element, text, a block begins before it
        self.order: list = []  # tokens: element keys, (element key, word)
        stack, at, raw, fresh = [0], 0, None, True
        open_: dict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        scopes, borders, articles = [0], [0], [0]  # places that an implied end does not pass, that a stray end tag does not pass, and a count

        def close(to: int) -> None:
            for place in range(len(stack) - 1, to - 1, -1):
                open_[self.tags[stack[place]]].pop()
                for marks in (scopes, borders):
                    if marks[-1] == place:
                        marks.pop()
                articles[0] -= self.tags[stack[place]] in ("article", "main")
            del stack[to:]

        for m in _TAG.finditer(source):
            if m.start() < at:
                continue
            closing, tag = m[1], (m[2] or "").lower()
            if raw and not (closing and tag == raw):
                continue
            if not raw and m.start() > at:
                fresh = self._text(stack[-1], source[at : m.start()], fresh)
            at = m.end()
            if not tag:
                continue
            if raw:
                raw = None
            if tag not in _INLINE:
                fresh = True
            if closing:
                if open_[tag] and not (tag in _STRAY and open_[tag][-1] < borders[-1]):
                    close(open_[tag][-1])
                continue
            if tag in _ENDS_P and open_["p"] and open_["p"][-1] > scopes[-1]:
                close(open_["p"][-1])
            nearest = max((open_[t][-1] for t in _CLOSES.get(tag, ()) if open_[t]), default=0)
            if nearest and nearest >= scopes[-1]:
                close(nearest)
            attributes = _attributes(m[3]) if m[3].strip(" /") else {}
            up = stack[-1]
            name = tag + "".join(f".{_DIGITS.sub('#', c)}" for c in sorted(attributes.get("class", "").split())) + (f"!{_DIGITS.sub('#', attributes['id'])}" if attributes.get("id") else "")
            self.keys.append(xxhash.xxh3_64_intdigest(name, self.keys[up]))
            self.parents.append(up)
            self.depth.append(self.depth[up] + 1)
            self.tags.append(tag)
            self.other.append(self.other[up] or _is_other(tag, attributes, articles[0] > 0))
            element = len(self.keys) - 1
            self.order.append(self.keys[element])
            if tag in _VOID or m[3].rstrip().endswith("/") and tag not in ("p", "div", "span", "a", "b", "i"):
                continue
            place = len(stack)
            stack.append(element)
            open_[tag].append(place)
            if tag in _SCOPE:
                scopes.append(place)
            if tag in ("article", "main", "body"):
                borders.append(place)
            articles[0] += tag in ("article", "main")
            if tag in _RAW:
                raw = tag
        if not raw and at < len(source):
            self._text(stack[-1], source[at:], fresh)

    def _text(self, element: int, source: str, fresh: bool) -> bool:
        text = html.unescape(source)
        if not text.strip():
            if text and self.pieces and not fresh:
                e, before, b = self.pieces[-1]
                self.pieces[-1] = (e, before + " ", b)
            return fresh
        self.pieces.append((element, text, fresh))
        key = self.keys[element]
        self.order += [(key, w) for w in text.split()]
        return False

    def within(self, element: int) -> list[bool]:
        """Whether each element is ``element`` or below it."""
        out = [False] * len(self.keys)
        for i, up in enumerate(self.parents):
            out[i] = i == element or (up >= 0 and out[up])
        return out

    def weights(self, known: frozenset = frozenset()) -> list[int]:
        """Length of text at or below each element, other roles and pieces of known words only left out."""
        out = [0] * len(self.keys)
        for e, text, _ in self.pieces:
            if not self.other[e] and not (known and all((self.keys[e], w) in known for w in text.split())):
                out[e] += len(text)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def text_of(self, elements: list[bool]) -> str:
        """Blocks of the chosen elements, joined by one space."""
        blocks: list[str] = []
        begin = True
        for e, text, fresh in self.pieces:
            begin = begin or fresh
            if self.other[e] or not elements[e]:
                begin = True
                continue
            if begin or not blocks:
                blocks.append(text)
            else:
                blocks[-1] += text
            begin = False
        return " ".join(x for x in (_SPACE.sub(" ", b).strip() for b in blocks) if x)


def equivalence_classes(pages: list[Page]) -> list[tuple[tuple[int, ...], list]]:
    """Valid classes of tokens that occur once: the pages they occur on, and the tokens in their order."""
    seen: dict = defaultdict(list)  # token -> pages, once for every time
    for i, p in enumerate(pages):
        for token in p.order:
            seen[token].append(i)
    least = max(2, SUPPORT * sum(bool(p.order) for p in pages))
    by_vector: dict[tuple[int, ...], set] = defaultdict(set)
    for token, on in seen.items():
        if len(on) >= least and len(set(on)) == len(on):
            by_vector[tuple(on)].add(token)
    out = []
    for on, tokens in by_vector.items():
        orders = [[t for t in pages[i].order if t in tokens] for i in on]
        if any(o != orders[0] for o in orders):  # words move; the elements may still agree
            orders = [[t for t in o if isinstance(t, int)] for o in orders]
        if orders[0] and all(o == orders[0] for o in orders):
            out.append((on, orders[0]))
    return out


def template(pages: list[Page]) -> tuple[list, dict[object, list[list]]]:
    """The skeleton's tokens, and the classes nested into the gap after each."""
    classes = equivalence_classes(pages)
    elements = lambda c: sum(isinstance(t, int) for t in c[1])
    best = max(classes, key=lambda c: (len(c[0]) * elements(c), len(c[1])), default=None)
    if best is None or not elements(best):
        return [], {}
    on, skeleton = best
    nested: dict = {}
    gap_of = []  # of each page, the skeleton token before each token
    for p in pages:
        gaps, last, own = {}, None, set(skeleton)
        for t in p.order:
            if t in own:
                last = t
            else:
                gaps[t] = last
        gap_of.append(gaps)
    for where, tokens in classes:
        if tokens is not skeleton:
            gaps = {gap_of[i].get(t) for i in where for t in tokens}
            if len(gaps) == 1 and None not in gaps:
                nested.setdefault(gaps.pop(), []).append(tokens)
    return skeleton, nested


def main_slot(pages: list[Page]) -> tuple[int | None, frozenset]:
    """Key of the skeleton element whose slot is the main one, and all tokens of the template."""
    skeleton, nested = template(pages)
    known = frozenset(skeleton).union(*(c for classes in nested.values() for c in classes))
    words = frozenset(t for t in known if not isinstance(t, int))
    weighed = [(p.weights(words), p.weights()) for p in pages]
    if 2 * sum(a[0] for a, _ in weighed) < sum(b[0] for _, b in weighed):  # copies of one page: all of it weighs
        weighed = [(b, b) for _, b in weighed]
    held: dict[int, int] = defaultdict(int)
    depth: dict[int, int] = {}
    elements = {t for t in skeleton if isinstance(t, int)}
    for p, (weights, _) in zip(pages, weighed, strict=True):
        for e, key in enumerate(p.keys):
            if key in elements and not p.other[e]:
                held[key] += weights[e]
                depth[key] = p.depth[e]
    whole = sum(w[0] for w, _ in weighed)
    enough = [key for key, n in held.items() if n and n >= SHARE * whole]
    return max(enough, key=lambda key: (depth[key], held[key]), default=None), known


def without_template(page: Page, main: int, known: frozenset) -> list[bool]:
    """Elements of the main slot, less those below it that are the template's with all their words."""
    inside = page.within(main)
    varies, length = [0] * len(page.keys), [0] * len(page.keys)
    for e, text, _ in page.pieces:
        if inside[e] and not page.other[e]:
            length[e] += len(text)
            varies[e] += any((page.keys[e], w) not in known for w in text.split())
    for i in range(len(length) - 1, 0, -1):
        length[page.parents[i]] += length[i]
        varies[page.parents[i]] += varies[i]
    gone = [False] * len(page.keys)
    dropped = 0
    for i in range(1, len(gone)):
        up = page.parents[i]
        gone[i] = gone[up]
        if not gone[i] and inside[i] and i != main and length[i] and not varies[i] and page.keys[i] in known:
            gone[i] = True
            dropped += length[i]
    if dropped > LITTLE * length[main]:
        return inside
    return [a and not b for a, b in zip(inside, gone, strict=True)]


def _own(page: Page) -> list[bool]:
    """Elements of the article of a page by itself."""
    weights = page.weights()
    for tag in ("article", "main"):
        found = [i for i, t in enumerate(page.tags) if t == tag and not page.other[i]]
        if found:
            best = max(found, key=lambda i: weights[i])
            if weights[best] >= 0.3 * weights[0]:
                return page.within(best)
    best = 0
    while True:
        below = [i for i, up in enumerate(page.parents) if up == best and page.tags[i] not in _INLINE | {"p", "ul", "ol", "table", "blockquote", "pre"}]
        inner = max(below, key=lambda i: weights[i], default=None)
        if inner is None or weights[inner] < SHARE * weights[0] or not weights[inner]:
            return page.within(best)
        best = inner


def extract_block(sources: list[str]) -> list[str]:
    """The main text of each page of a block."""
    pages = [Page(s) for s in sources]
    main, known = main_slot(pages) if len(pages) > 1 else (None, frozenset())
    out = []
    for p in pages:
        if main is not None and main in p.keys:
            out.append(p.text_of(without_template(p, p.keys.index(main), known)))
        else:
            out.append(p.text_of(_own(p)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in whole_runs(batches, ["host", "part"], 256):
        rows = list(zip(part["host"].to_pylist(), part["part"].to_pylist(), part["id"].to_pylist(), part["url"].to_pylist(), part["html"].to_pylist(), strict=True))
        blocks = defaultdict(list)
        for r in rows:
            blocks[r[0], r[1]].append(r)
        out = []
        for own in blocks.values():
            for at in range(0, len(own), 2 * BLOCK):  # a block may hold a few pages more than planned
                some = own[at : at + 2 * BLOCK]
                for r, text in zip(some, extract_block([x[4] or "" for x in some]), strict=True):
                    out.append((r[2], r[3], text, len(text)))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", block: int = BLOCK) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pick(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), "url", "html", host.alias("host"))
    parts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    large = materialise(parts.filter("parts > 1"), "hosts")
    sized = rows.join(large, "host", "left")
    own = F.pmod(F.xxhash64("id", "url"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    n = 2 * shuffle_partitions(pages.sparkSession)
    dealt = sized.select("host", own, "id", "url", "html").repartition(n, "host", "part").sortWithinPartitions("host", "part", "id")
    return dealt.mapInArrow(tidied(_extract), _SCHEMA)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
