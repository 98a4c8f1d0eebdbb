"""Main text of web pages by block rules in two passes.

A page is read once, tag by tag, and falls into blocks at block-level tags. First pass: blocks
of menus, headers, footers, sidebars, notices, adverts, forms and comments, told by tags, roles, class
names and headings, are bad; so are blocks mostly of links and long blocks with few stop words; long blocks
with many are good. Short blocks and those in between stay open. Second pass: an open block inherits the
label of its nearest decided neighbours. Within <article> or <main> a block is open rather than bad
for want of stop words, the ends of such a part count as good, and one good neighbour is enough;
elsewhere ends count as bad and the nearer neighbour decides. If the articles of a page hold a fair
share of its good text, nothing outside them is kept.

Stop words are those of the language of which the page has most; where a page has next to none of any, they decide
nothing. If nothing on a page is good, parts set aside only for their class name or as a form are opened, and if that gives
nothing either, its open blocks are kept.

Rows: one for each row, also for repeated ones; a null or empty page gives an empty text. Broken markup is read
to its end: tags that are never closed, end tags that were never opened, stray ``<`` and ``&``, quotes without end.
White space is what Python's str.split takes for it, no-break spaces included. Time is linear in the page's length.
Extra columns are left aside.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, released

#: Characters under which a block is short, and over which it is good by itself; shares of stop words; share of characters in links.
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.1, 0.2, 0.35
#: Share of stop words under which a page's language is unknown; share of all good characters from which on articles exclude the rest.
UNKNOWN, TRUSTED = 0.03, 0.25

# Frequent function words.
STOP_WORDS = {
    "en": "the of and to a in is that it for was on with be as by are this at from or an have not they which you had but his her we has were their",
    "de": "der die und in den von zu des sich das mit auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "fr": "de la le et les des en un du une que est pour dans qui par au sur pas avec il plus ne se ce sont mais ou son cette aux ont",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque esta",
    "it": "di e il la che in un a per è una sono non con del si da le della dei come più ma anche al nel alla questo gli",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu",
    "nl": "de het een van en in is dat op te zijn met voor niet die aan er ook als maar om dan bij nog uit werd naar door over",
}
# HTML's elements by what they mean here.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
OPAQUE = frozenset("noscript template svg math object canvas video audio select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("html body div section nav aside header footer form fieldset article main ul ol dl menu table thead tbody tfoot tr td th figure details dialog center blockquote li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of class names and ids, roles and headings of what is not an article.
AWAY_TAGS = frozenset("nav aside footer menu dialog".split())
AWAY = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside rail footer copyright comment comments commentlist respond replies discussion disqus related recommended recommendations widget widgets toolbar share sharing social skip".split())
ASIDE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox banner sponsor sponsored sponsors promo promos promotion promoted header masthead topbar cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login search paywall disclaimer".split())
AWAY_ROLES = frozenset("navigation contentinfo complementary menu menubar toolbar dialog alertdialog".split())
ASIDE_ROLES = frozenset("banner search form alert status".split())
OF_ARTICLES = frozenset("article entry post content story main".split())
ENDINGS = frozenset(["comments", "reader comments", "user comments", "leave a comment", "leave a reply", "post a comment", "discussion", "responses", "kommentare", "kommentar schreiben", "commentaires", "laisser un commentaire", "comentarios", "deja un comentario", "commenti", "comentários", "reacties", "related articles", "related posts", "related stories"])

_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
# A quote opens a value only behind an equals sign; one that is never closed is a character like others.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MODIFIER = re.compile(r"(?:has|with|without|no|is)[-_A-Z]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_COUNTED = re.compile(r"^\(?\d+\)?\s+|\s*\(\d+\)$|:$")
_STOPS = {lang: frozenset(words.split()) for lang, words in STOP_WORDS.items()}
_ANY_STOP = frozenset().union(*_STOPS.values())

KEPT, SOFT, FIRM = 0, 1, 2


@dataclass
class Block:
    text: str
    linked: int  # characters within links, white space left out
    heading: bool
    article: bool
    away: int  # KEPT, SOFT or FIRM
    n_words: int = 0
    stops: Counter = field(default_factory=Counter)
    density: float = 0.0
    label: str = ""  # good, bad, or open: "near" with some stop words, else "short"

    @property
    def link_density(self) -> float:
        return self.linked / (len(self.text) - self.text.count(" "))


@functools.lru_cache(1 << 14)
def _hint(attributes: str) -> tuple[int, bool, bool]:
    """What attributes say: KEPT, SOFT or FIRM, whether only by the word header, and whether they call it the main part."""
    found, only_header, main = KEPT, False, False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return FIRM, False, False
        if name == "role":
            roles = set(value.lower().split())
            main |= "main" in roles
            found = max(found, FIRM if roles & AWAY_ROLES else SOFT if roles & ASIDE_ROLES else KEPT)
        elif name in ("class", "id"):
            for word in value.split():
                if _MODIFIER.match(word):
                    continue
                parts = {p.lower() for p in _PART.findall(word)}
                if parts & AWAY:
                    found = FIRM
                elif parts & ASIDE:
                    if parts & ASIDE == {"header"}:
                        if parts & OF_ARTICLES:
                            continue
                        only_header |= found == KEPT
                    found = max(found, SOFT)
    return found, only_header and found == SOFT, main


class _Reader:
    """Reads one page into blocks."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        #: Open elements: tag, state of what is inside (away, article).
        self.stack: list[tuple[str, int, bool]] = []
        self.open = Counter()
        self.away, self.article, self.links = KEPT, False, 0
        self.parts: list[str] = []
        self.linked, self.heading = 0, None

    def read(self) -> list[Block]:
        page, at, absent = self.page, 0, set()
        while True:
            m = _OPEN.search(page, at)
            if m is None:
                self.said(page[at:])
                break
            start = m.start()
            if start > at:
                self.said(page[at:start])
            if page.startswith("<!--", start):
                at = start + 5 if page.startswith("<!-->", start) else page.find("-->", start + 4) + 3
                if at == 2:
                    break
                continue
            tag = _TAG.match(page, start)
            if tag is None:
                # A declaration, a bogus comment, or a tag without end.
                at = page.find(">", start) + 1
                if not at:
                    break
                continue
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                self.closed(name)
                continue
            if name in RAW or name in OPAQUE:
                if name in ("svg", "math") and tag[3].endswith("/"):
                    continue
                end = None if name in absent else re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if end is None:
                    absent.add(name)
                    if name in RAW and name != "title":
                        break
                    continue
                at = end.start()
                if name == "title" or name not in INLINE:
                    self.cut()
                continue
            self.opened(name, tag[3])
        self.cut()
        return self.blocks

    def said(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.links:
            self.linked += len("".join(text.split()))

    def cut(self) -> None:
        """Ends a block."""
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.heading is not None, self.article, self.away))
            if self.heading and self.stack and _COUNTED.sub("", text.lower()) in ENDINGS:
                # What follows under such a heading goes, to the end of the element around it.
                tag, _, article = self.stack[-1]
                self.blocks[-1].away = self.away = FIRM
                self.stack[-1] = (tag, FIRM, article)
        self.parts, self.linked = [], 0

    def _push(self, name: str, away: int, article: bool) -> None:
        self.stack.append((name, away, article))
        self.open[name] += 1
        self.away, self.article = away, article

    def _pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        _, self.away, self.article = self.stack[-1] if self.stack else ("", KEPT, False)
        return name

    def opened(self, name: str, attributes: str) -> None:
        if name == "br":
            self.parts.append("\n")
            return
        if name == "a":
            self.links = 1
        block = name not in INLINE
        if block:
            self.cut()
            self.links = 0
            while self.stack and (self.stack[-1][0] in INLINE or self.stack[-1][0] == "p" or self.stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd")):
                self._pop()
            self.heading = name if name in HEADINGS else None
        if name in VOID:
            return
        hint, header, main = _hint(attributes) if "=" in attributes or "hidden" in attributes.lower() else (KEPT, False, False)
        if not hint and name not in CONTAINERS:
            return
        away, article = self.away, self.article
        if name in ("html", "body"):
            hint = KEPT
        elif name == "main" or main:
            away, article, hint = KEPT, True, KEPT
        elif name == "article" and hint < FIRM and away < FIRM:
            away, article, hint = KEPT, True, KEPT
        elif header and article:
            hint = KEPT
        if name in AWAY_TAGS:
            hint = FIRM
        elif name in ("form", "fieldset") or name == "header" and not article:
            hint = max(hint, SOFT)
        self._push(name, max(away, hint), article)

    def closed(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name == "br":
            self.parts.append("\n")
            return
        if name not in INLINE:
            self.cut()
            self.heading = None
        if self.open[name]:
            while self._pop() != name:
                pass


def _words(blocks: list[Block]) -> None:
    """Shares of stop words in the language of which the blocks have most."""
    for b in blocks:
        if not b.n_words:
            words = _WORD.findall(b.text.lower())
            b.n_words, b.stops = len(words), Counter(filter(_ANY_STOP.__contains__, words))
    held = Counter()
    for b in blocks:
        held.update(b.stops)
    by_language = {lang: sum(n for w, n in held.items() if w in stops) for lang, stops in _STOPS.items()}
    lang = max(by_language, key=by_language.get)
    known = by_language[lang] >= UNKNOWN * max(1, sum(b.n_words for b in blocks))
    for b in blocks:
        hits = sum(n for w, n in b.stops.items() if w in _STOPS[lang])
        b.density = (hits / b.n_words if b.n_words else 0.0) if known else 1.0


def _first(b: Block) -> str:
    if b.link_density > LINKS:
        return "bad"
    if b.heading or len(b.text) < SHORT:
        return "short"
    if b.density >= HIGH:
        return "good" if len(b.text) > LONG else "near"
    return "near" if b.density >= LOW or b.article else "bad"


def _nearest(labels: list[str], edge: str) -> list[tuple[str, int]]:
    """For each block the label of the last decided one before it and how far off that is."""
    out, label, off = [], edge, 0
    for x in labels:
        off += 1
        out.append((label, off))
        if x in ("good", "bad"):
            label, off = x, 0
    return out


def _second(blocks: list[Block], edge: str, either: bool) -> list[str]:
    labels = [b.label for b in blocks]
    before, behind = _nearest(labels, edge), _nearest(labels[::-1], edge)[::-1]
    out = []
    for x, (left, i), (right, j) in zip(labels, before, behind, strict=True):
        if x in ("good", "bad"):
            out.append(x)
        elif left == right:
            out.append(left)
        elif either:
            out.append("good")
        else:
            out.append(left if i < j else right if j < i else "good" if x == "near" else "bad")
    return out


def labelled(blocks: list[Block], level: int = KEPT) -> bool:
    """Labels blocks good or bad; level: SOFT opens parts set aside as such. Tells whether any is good."""
    inside = [b for b in blocks if b.away <= level]
    _words(inside)
    for b in blocks:
        b.label = "bad" if b.away > level else _first(b)
    held = [b for b in inside if b.article]
    # A run of blocks inside articles, or outside them, is judged by itself.
    runs, last = [], None
    for b in inside:
        if last is None or last.article != b.article:
            runs.append([])
        runs[-1].append(b)
        last = b
    found = [x for run in runs for x in (_second(run, "good", True) if run[0].article else _second(run, "bad", False))]
    for b, x in zip(inside, found, strict=True):
        b.label = x
    good = sum(len(b.text) for b in inside if b.label == "good")
    if good and sum(len(b.text) for b in held if b.label == "good") >= TRUSTED * good:
        for b in inside:
            if not b.article:
                b.label = "bad"
    return good > 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, each labelled good or bad."""
    blocks = _Reader(page).read()
    if not labelled(blocks) and not labelled(blocks, SOFT):
        for b in blocks:
            b.label = "good" if not b.away and _first(b) != "bad" else "bad"
    return blocks


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in blocks_of(page) if b.label == "good") if page else ""


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points); pages: page_id, url, html."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])
        released()

    prepared(pages.sparkSession)
    kinds = dict(pages.select("page_id", "url").dtypes)
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, position, text, kept, stop_density, link_density: every block of every page with what decided it."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i, page in enumerate(b.column(1).to_pylist()):
                found = blocks_of(page or "")
                columns = [[x.text for x in found], [x.label == "good" for x in found], [x.density for x in found], [x.link_density for x in found]]
                ids = b.column(0).take(pa.array([i] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(range(len(found)), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.float64(), pa.float64()), strict=True))], names=["page_id", "position", "text", "kept", "stop_density", "link_density"])
        released()

    kind = dict(pages.select("page_id").dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, position int, text string, kept boolean, stop_density double, link_density double")
