"""HTML extraction by two-pass block rules (operator 5).

Contract.  ``extract(pages)`` returns ``page_id``, ``url``, ``text`` (the article's blocks in page
order, joined by an empty line; empty if none) and ``n_chars`` (code points) for every row.

Method.  A linear scanner splits the page into blocks at block-level tags, with the characters that
stand in links and the elements around them.  Pass one decides blocks: those inside menus, asides,
page headers, footers, forms, adverts, notices and comments (by element, role, or a class or id whose
whole name says so) and, outside an article, those made of links are boilerplate; long blocks rich in stop words are text.  Short blocks and those
poor in stop words stay ambiguous.  Pass two gives each ambiguous block the label of the nearest
decided blocks of its own article (or, outside any, of the page); text wins a tie.  If an article
or main element holds text, blocks outside it are boilerplate.

Edge cases: null and empty pages have no text; unclosed elements, comments and quotes, stray ``<``
and unknown tags are read as browsers do, to the end of the page at most; a page without a decided
block keeps its ambiguous blocks; text inside formulas, objects and media is text; buttons go, but for
those in a sentence; deep nesting and stray tags take time linear in the page; text without any markup is one block; a null url stays null;
repeated rows are all returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import chunks

#: Characters of a long block, stop-word shares of text, link share of boilerplate.
LONG, STOP_SHARE, STOP_SHARE_ARTICLE, LINK_SHARE = 70, 0.28, 0.12, 0.5

# Stop words, element names, class and role words.
STOP_WORDS = frozenset(
    """the of and to a in is it that for was on are as with his they be at one have this from or had by not but what all
were when we there can an your which their said if do will each how them then she many some so these would into has more
le la les de des du un une et est en que qui dans pour pas sur au avec se ce il elle sont par ne plus ou son sa ses nous
vous mais comme der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an er sie dem des im war
hat aus bei wird oder wie el los las y que del se por con para una su al lo como más o pero sus este esta está entre""".split()
)
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead title tr ul""".split()
)
RAW = frozenset("script style title textarea noscript template iframe noframes noembed xmp svg select button".split())
#: Elements whose buttons are part of a sentence.
SENTENCE = frozenset("p li dd dt td th blockquote figcaption caption h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav aside footer form menu dialog fieldset label head".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Names of classes and ids, of one word or more, that say what an element holds.
BOILER_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion
nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer masthead cookie cookies consent gdpr
notice notices banner popup modal overlay newsletter subscribe subscription signup login sharing related recommended
recommendations pagination pager toolbar""".split()
)
#: Those of reader comments; no article inside them is the page's.
COMMENT_WORDS = frozenset("comment comments disqus reply replies respond commentlist".split())
#: Words that may stand before and after those above in one name; with any other word the name says something else.
BEFORE = frozenset(
    """site page post article entry blog main global top bottom left right header primary secondary js wp mobile desktop sticky
fixed floating side inline user reader google dfp gpt your the block region section module component elementor-location""".split()
)
AFTER = frozenset(
    """area author bar bars block blocks body bottom box button buttons btn column container count divider foot form heading
icon icons inner item items label leaderboard link links list message messages meta module outer pane panel
placeholder posts articles stories rectangle region row section slot slots space spot text thread title toggle top unit units wrap
wrapper""".split()
)
#: Names that count as they stand only, as their words say other things elsewhere.
WHOLE = frozenset(
    """menu menubar main-menu nav-menu top-menu site-menu mobile-menu side-menu footer-menu menu-bar menu-toggle share social
social-links social-share social-icons social-media social-media-links social-buttons share-buttons share-links share-bar
share-this share-tools addtoany sharedaddy skip-link skip-links skip-to-content skip-to-main-content sr-only visually-hidden
screen-reader-text is-hidden""".split()
)
#: Names that hide an element, unless another name of it shows it again at some width (md:block, d-lg-flex).
HIDING = frozenset(("hidden", "d-none"))
SCOPE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: How an element holds boilerplate: by class or id or as a form, which a nested article overrides, or by element, role, hiding or as comments.
SOFT, HARD = 1, 2

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[_-]+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """One block of text and what decides its label."""

    text: str
    link: int
    boiler: bool
    scope: int
    element: str = ""
    label: bool | None = None


@dataclass
class _State:
    stack: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    blocks: list = field(default_factory=list)
    link: int = 0
    anchors: int = 0
    breaks: int = 0
    open: dict = field(default_factory=dict)

    def push(self, name: str, level: int, scope: int) -> None:
        self.stack.append((name, level, scope))
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.open[name] -= 1
        return name


@lru_cache(4096)
def _name_says(name: str) -> int:
    """SOFT or HARD if one name of a class or id value names boilerplate, else 0.

    The whole name has to say so: words that name boilerplate, with only words of place around them.
    Modifiers (``block--left``) and elements of a named block (``footer__links``) follow their block.
    """
    block = name.split("--")[0].split("__")[0]
    low = _CAMEL.sub("-", block).lower().replace("_", "-").strip("-")
    if low in WHOLE:
        return SOFT
    words = [w for w in _SPLIT.split(low) if w and not w.isdigit()]
    while len(words) > 1 and (words[0] in BEFORE or len(words[0]) == 1):
        words = words[1:]
    own = [w in BOILER_WORDS or w in COMMENT_WORDS for w in words]
    if not words or not own[0] or not all(o or w in AFTER for o, w in zip(own, words)):
        return 0
    return HARD if any(w in COMMENT_WORDS for w in words) else SOFT


def _named(value: str) -> int:
    """SOFT or HARD if one of the names of a class or id value names or hides boilerplate, else 0."""
    names = value.split()
    found = max(map(_name_says, names), default=0)
    hides = not HIDING.isdisjoint(names) and not any(":" in n or n.startswith("d-") and n != "d-none" for n in names)
    return HARD if hides else found


def _attrs(attrs: str) -> list[tuple[str, str]]:
    """The attributes that are read, each with its own value."""
    return [(k, v.strip("\"'")) for name, v in _ATTR.findall(attrs) if (k := name.lower()) in _READ]


def _marked(name: str, attrs: str, in_scope: bool) -> int:
    """SOFT or HARD if an element holds boilerplate by its name or attributes, else 0."""
    if name == "form":
        return SOFT  # some pages stand in one form
    if name in BOILER or name == "header" and not in_scope:
        return HARD
    if not attrs or name in ("html", "body", "main"):
        return 0
    found = 0
    for key, value in _attrs(attrs):
        if key in ("class", "id"):
            found = max(found, _named(value))
            continue
        value = value.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return HARD
        if key == "role" and value in BOILER_ROLES:
            return HARD
    return found


def _opens(name: str, level: int, own: int, scope: int) -> bool:
    """Whether an article or main element without a mark of its own ends the mark that a wrapper's class set."""
    return name in SCOPE and level == SOFT and not own and not scope


def _flush(s: _State) -> None:
    if s.parts:
        text = " ".join("".join(s.parts).split())
        if text:
            top = s.stack[-1] if s.stack else ("", 0, 0)
            s.blocks.append(Block(text, s.link, top[1] > 0, top[2], top[0]))
    s.parts, s.link, s.breaks = [], 0, 0


def blocks(page: str) -> list[Block]:
    """The blocks of a page, by one scan from left to right."""
    s, at, n, scopes = _State(), 0, len(page), 0
    low = None

    def text(raw):
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            if not raw.isspace():
                s.breaks = 0
                if s.anchors:
                    s.link += len(" ".join(raw.split()))
            s.parts.append(raw)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt) and (end := page.find("]]>", lt)) >= 0:
            if not page[lt + 9 : end].isspace():
                s.parts.append(page[lt + 9 : end])
            at = end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            after = page[lt + 1 : lt + 3].lstrip("/")[:1]
            if not ("a" <= after.lower() <= "z"):
                text("<")
                at = lt + 1
                continue
            end = page.find(">", lt)
            if end < 0:
                break
            close, name, attrs = page[lt + 1] == "/", re.match(r"[^\s/>]*", page[lt + 1 : lt + 40].lstrip("/"))[0].lower(), ""
            at = end + 1
        else:
            close, name, attrs = bool(m[1]), m[2].lower(), m[3]
            at = m.end()
        if name == "br":
            s.breaks += 1
            s.parts.append(" ")
            if s.breaks > 1:
                _flush(s)
            continue
        if name in RAW and not (name == "button" and s.stack and s.stack[-1][0] in SENTENCE):
            if not close and not attrs.rstrip().endswith("/"):
                low = page.lower() if low is None else low
                if len(low) != n:  # lower-casing can change lengths outside ASCII
                    low = "".join(c.lower() if c < "\x80" else c for c in page)
                end = low.find("</" + name, at)
                end = n if end < 0 else low.find(">", end)
                at = n if end < 0 else end + 1
            if name in BLOCK:
                _flush(s)
            continue
        if name == "a":
            s.anchors = max(0, s.anchors - 1) if close else 1
            continue
        marks = not close and bool(attrs) and name not in VOID
        if name in BLOCK or marks or close and any(e[0] == name for e in s.stack[-1:]):
            top = s.stack[-1] if s.stack else ("", 0, 0)
            boiler = marks and _marked(name, attrs, top[2] > 0) or not close and _marked(name, "", top[2] > 0)
            if name not in BLOCK and not boiler and not (close and top[0] == name):
                continue  # an inline element with harmless attributes
            _flush(s)
            s.anchors = 0
            if name in VOID:
                continue
            if close:
                while s.open.get(name) and s.pop() != name:
                    pass
            else:
                if top[0] == name and name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
                    s.pop()
                    top = s.stack[-1] if s.stack else ("", 0, 0)
                elif top[0] == "p" and name in BLOCK:
                    s.pop()
                    top = s.stack[-1] if s.stack else ("", 0, 0)
                scope, level = top[2], max(top[1], boiler)
                if _opens(name, top[1], int(boiler), scope):
                    level = 0
                if name in SCOPE:
                    scopes += 1
                    scope = scopes
                s.push(name, level, scope)
    _flush(s)
    return s.blocks


def decide(found: list[Block]) -> None:
    """Both passes; sets the labels."""
    for b in found:
        size = len(b.text)
        linked = not b.scope and b.link > LINK_SHARE * size  # an article's links are its own
        if b.boiler or linked and b.element != "p" and b.element not in HEADINGS:
            b.label = False
        elif size >= LONG:
            w = _WORD.findall(b.text.lower())
            share = sum(x in STOP_WORDS for x in w) / max(len(w), 1)
            if share >= (STOP_SHARE_ARTICLE if b.scope else STOP_SHARE):
                b.label = True
        elif linked and b.element == "p":
            b.label = False  # a short paragraph of links
    if any(b.label and b.scope for b in found):
        for b in found:
            if not b.scope:
                b.label = False
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(found):
        groups.setdefault(b.scope, []).append(i)
    for own in groups.values():
        # links and asides inside an article say nothing of the paragraphs beside them
        known = [(k, found[i].label) for k, i in enumerate(own) if found[i].label is not None and not (found[i].scope and found[i].label is False)]
        before, last = [None] * len(own), None
        marks = dict(known)
        for k in range(len(own)):
            last = (k, marks[k]) if k in marks else last
            before[k] = last
        last = None
        for k in range(len(own) - 1, -1, -1):
            last = (k, marks[k]) if k in marks else last
            b = found[own[k]]
            if b.label is None:
                near = [(abs(x[0] - k), not x[1], x[1]) for x in (before[k], last) if x]
                b.label = min(near)[2] if near else True


def main_text(page: str | None) -> str:
    """The main text of a page."""
    if not page:
        return ""
    found = blocks(page)
    decide(found)
    return "\n\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """See the module's docstring."""

    def run(batches):
        for b in chunks(batches, "html"):
            text = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return df.mapInArrow(run, "page_id long, url string, text string, n_chars long")
