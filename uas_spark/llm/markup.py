"""Tolerant reading of one HTML page into block elements and text blocks (helper of operator 11).

A page becomes a tree of block elements; inline elements vanish and their texts run together.
An element's *path* is the sequence of labels from the root; a label is the tag with the role
words of its class, id and role attributes, so labels come from a fixed vocabulary. For every
path the page yields the order of the children as a folded expression (see ``expression``).
"""

from __future__ import annotations

import re
from html import unescape

import xxhash

from .expression import Chain

# fixed values: HTML element names
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre
search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog dir footer form frameset head iframe map math menu nav
noembed noframes noscript object optgroup option search select svg template textarea title video""".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption".split())
# an open element that a new one closes, and the elements this does not reach across
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
          "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"caption"}, {"table"})}

# words of class, id and role that name what is not the article, and what is
BOILER = frozenset("""ad ads adbox adslot advert adverts advertisement advertising adsbygoogle alert banner banners
breadcrumb breadcrumbs byline card cards comment commentlist comments consent cookie cookiebar cookies copyright
disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice
notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related
replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription
taboola tags teaser toolbar topbar widget widgets contentinfo complementary""".split())
CONTENT = frozenset("article articlebody blog body content entry main post story text".split())
# a compound such as has-sidebar or no-ads tells of a thing, it does not name one
_ABOUT = frozenset("has no with without not hide show is".split())

ARTICLE, MAIN, NAMED, OTHER = 1, 2, 3, 4

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)([^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+)>|(!--)|([!?/]))""")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]*+))?+""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CLOSE = {t: re.compile(rf"</{t}(?![a-zA-Z0-9-])[^>]*>?", re.I) for t in RAW}


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        out.setdefault(name.lower(), unescape(value.strip("\"'")))
    return out


def _roles(raw: str) -> tuple[set[str], bool]:
    """Role words of a tag's attributes, and whether the element is hidden."""
    a = attributes(raw)
    found: set[str] = set()
    for token in " ".join(a.get(k, "") for k in ("class", "id", "role", "itemprop")).split():
        ws = [w.lower() for w in _WORD.findall(token)]
        if not _ABOUT.intersection(ws):
            found.update(w for w in (*ws, "".join(ws)) if w in BOILER or w in CONTENT)
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(a.get("style", "")))
    return found, hidden


class Path:
    """One label path of a page, with what the page holds there."""

    __slots__ = ("key", "parent", "tag", "label", "level", "boiler", "children", "chains", "texts", "chars", "linked")

    def __init__(self, parent: Path | None, tag: str, label: str, level: int, boiler: bool):
        self.key = xxhash.xxh64_intdigest(label, parent.key if parent else 0)
        self.parent, self.tag, self.label, self.level, self.boiler = parent, tag, label, level, boiler
        self.children: dict[str, Path] = {}
        self.chains: dict[str, int] = {}
        self.texts: list[str] = []
        self.chars = self.linked = 0


class Page:
    """``paths``: every path outside boilerplate; ``blocks``: (path, text) in page order."""

    def __init__(self, html: str):
        self.root = Path(None, "", "", OTHER, False)
        self.paths: list[Path] = [self.root]
        self.blocks: list[tuple[Path, str]] = []
        self._stack: list[tuple[Path, Chain]] = [(self.root, Chain())]
        self._open: dict[str, int] = {}
        self._pieces: list[str] = []
        self._linked = 0
        self._inline: list[tuple[str, bool]] = []  # open inline elements of the block, and whether they hide text
        self._hiding = self._links = 0
        self._labels: dict[tuple[str, str], tuple[str, int, bool]] = {}
        self._read(html)
        self._flush()
        while self._stack:
            self._pop()

    def _read(self, html: str) -> None:
        at, absent = 0, set()
        for_match = _TAG.search
        while m := for_match(html, at):
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            if m.group(4) or m.group(5):
                end = html.find("-->", max(at - 2, 0)) if m.group(4) else html.find(">", at)
                if end < 0:
                    return
                at = end + (3 if m.group(4) else 1)
                continue
            tag = m.group(2).lower()
            if m.group(1):
                self._end(tag)
                continue
            if tag in RAW and tag not in absent:
                close = _CLOSE[tag].search(html, at)
                if close:
                    at = close.end()
                    continue
                if tag in ("script", "style"):
                    return
                absent.add(tag)
            self._start(tag, m.group(3))
        rest = html[at:]
        cut = re.search(r"<[a-zA-Z]", rest)  # a tag that never ends takes the rest, as in a browser
        self._text(rest[:cut.start()] if cut else rest)

    def _text(self, raw: str) -> None:
        if self._hiding:
            return
        if "head" in self._open and raw.strip():
            self._end("head")
        text = unescape(raw) if "&" in raw else raw
        self._pieces.append(text)
        if self._links:
            self._linked += sum(map(len, text.split()))

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            path, chain = self._stack[-1]
            if text and not path.boiler:
                chain.push("#")
                path.texts.append(text)
                path.chars += len(text)
                path.linked += self._linked
                self.blocks.append((path, text))
            self._pieces, self._linked = [], 0
        self._inline, self._hiding, self._links = [], 0, 0

    def _label(self, tag: str, raw: str) -> tuple[str, int, bool]:
        """(label, region level, whether the element itself is boilerplate)."""
        known = self._labels.get((tag, raw))
        if known is None:
            roles, hidden = _roles(raw) if raw.strip() else (set(), False)
            boiler = tag in DROPPED or hidden or (tag not in ("html", "body", "main") and bool(roles & BOILER))
            level = (ARTICLE if tag == "article" or "articlebody" in roles else MAIN if tag == "main" or "main" in roles
                     else NAMED if roles & CONTENT and tag not in ("html", "body") else OTHER)
            known = self._labels[tag, raw] = (".".join([tag, *sorted(roles)]), level, boiler)
        return known

    def _start(self, tag: str, raw: str) -> None:
        if "head" in self._open and tag not in IN_HEAD and tag != "head":
            self._end("head")
        if tag == "br":
            self._pieces.append(" ")
            return
        if tag not in BLOCKS and tag not in DROPPED:
            if tag not in VOID and not raw.endswith("/"):
                hides = self._label(tag, raw)[2] if raw else False
                self._inline.append((tag, hides))
                self._hiding += hides
                self._links += tag == "a"
            return
        self._flush()
        if tag in ("html", "body") and self._open.get(tag):
            return
        if self._stack[-1][0].tag == "p":
            self._pop()
        if tag in CLOSES:
            closed, walls = CLOSES[tag]
            for depth in range(len(self._stack) - 1, 0, -1):
                open_tag = self._stack[depth][0].tag
                if open_tag in walls:
                    break
                if open_tag in closed:
                    while len(self._stack) > depth:
                        self._pop()
                    break
        if tag in VOID or (raw.endswith("/") and tag in DROPPED):
            return
        label, level, boiler = self._label(tag, raw)
        parent, chain = self._stack[-1]
        if tag == "header" and not boiler:
            # a page's header goes; an article's keeps its headings
            boiler = parent.level > ARTICLE
            label = "header" if boiler else label
        chain.push(label)
        path = parent.children.get(label)
        if path is None:
            headless = parent.tag == "header" and not tag.startswith("h")
            path = Path(parent, tag, label, min(level, parent.level), boiler or parent.boiler or headless)
            parent.children[label] = path
            if not parent.boiler:
                self.paths.append(path)
        self._stack.append((path, Chain()))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in ("br", "p") and not self._open.get("p"):
            self._flush() if tag == "p" else self._pieces.append(" ")
            return
        if tag not in BLOCKS and tag not in DROPPED:
            for k in range(len(self._inline) - 1, -1, -1):
                if self._inline[k][0] == tag:
                    for name, hides in self._inline[k:]:
                        self._hiding -= hides
                        self._links -= name == "a"
                    del self._inline[k:]
                    return
            return
        if not self._open.get(tag):
            return
        self._flush()
        if tag in ("body", "html"):  # what follows still belongs to the page
            return
        while self._pop() != tag:
            pass

    def _pop(self) -> str:
        path, chain = self._stack.pop()
        if not path.boiler:
            text = str(chain.close())
            path.chains[text] = path.chains.get(text, 0) + 1
        if path.tag in self._open:
            self._open[path.tag] -= 1
            if not self._open[path.tag]:
                del self._open[path.tag]
        return path.tag
