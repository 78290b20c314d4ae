"""HTML extraction by line-block distribution.

Markup is stripped into lines, one for each block of text.  Parts that are
never main text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, reader comments) and the edges of the page's sections leave
blank lines behind; a line that is mostly link text weighs nothing.  The weights
are summed over sliding windows of lines.  A surge is where a window rises from
nothing, a dive where one falls to nothing again, and the lines between the two
are a block of text.  The block of the most text is the main one.  Others are
kept if their highest window reaches a share of the page's highest, and whatever
their size if they stand in the same article or main element, or in the same box,
as the main one.  A block in an article of its own needs the share of the main
block's text as well.

A class, id or role names a part that goes if it is one of the known words
(``sidebar``) or, of elements that hold others, begins or ends with one
(``site-footer``, ``ad-slot``; not ``no-sidebar``).  Names are no proof: a part
named by a compound stays if it holds the article or the block of most text, and
any named part stays if the page would have no text without it.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3          # lines that a window sums over
SHARE = 0.25        # of the highest window that a block must reach
LINKED = 0.5        # of a line's or block's text that may be link text

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
# Element names of HTML by what they mean here.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_DROPPED = {"nav", "header", "footer", "aside", "form", "select", "button", "dialog", "menu", "head", "svg", "math",
            "object", "canvas", "audio", "video", "map", "datalist", "label", "fieldset"}
_MAIN = {"article", "main"}
_SECTIONS = _MAIN | {"section", "body"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
           "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub",
           "sup", "time", "tt", "u", "var", "wbr", "img", "label", "button", "input"}
# Words in class, id or role that name parts which are not main text.
_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "sponsor", "sponsored", "promo",
          "promotion", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert",
          "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer",
          "header", "masthead", "topbar", "toolbar", "comment", "comments", "disqus", "respond", "reply", "replies",
          "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup",
          "login", "search", "pagination", "pager", "contentinfo", "complementary", "dialog", "form", "widget"}
# The first words of an article's classes that say it is not main text.
_NO_ARTICLE = {"comment", "reply", "ad", "advert", "advertisement", "sponsor", "sponsored", "promo", "related",
               "recommended", "teaser", "sidebar", "widget", "popup", "modal", "newsletter"}
# Parts that follow the main text, so an article in them is never what was meant.
_AFTER = {"aside", "footer"}
_AFTER_NAMES = {"aside", "footer", "contentinfo", "complementary", "comment", "comments", "disqus", "respond", "reply",
                "replies", "related", "recommended"}
# Elements that hold text themselves, and first words that turn a name round.
_TEXTS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figure",
          "figcaption", "caption", "address"} | _INLINE
_NEGATED = {"no", "not", "non", "with", "without", "has", "hide"}
_SPLIT = re.compile(r"[^a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


COMPOUND, TOKEN, SURE = 1, 2, 3  # why a part may go: begins or ends with a name, is one, or by its element


def _unwanted(name: str, attributes: str) -> int:
    if name in _DROPPED:
        return SURE
    if not attributes or name in ("main", "html", "body"):
        return 0
    why = 0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "style":
            why = max(why, SURE * bool(_HIDDEN.search(value)))
        elif key == "hidden" or key == "aria-hidden":
            found = key == "hidden" and not value == "until-found" or value == "true"
            why = max(why, SURE * found)
        else:
            words = [_SPLIT.split(w) for w in value.split()]
            if name == "article":
                why = max(why, SURE * any(w == ["comments"] or w[0] in _NO_ARTICLE for w in words))
            elif not _NAMES.isdisjoint(value.split()):
                why = max(why, TOKEN)
            elif name not in _TEXTS:
                ends = ({w[0], w[-1]} for w in words if w[0] not in _NEGATED)
                why = max(why, COMPOUND * any(not _NAMES.isdisjoint(e) for e in ends))
    return why


def _follows(name: str, attributes: str) -> bool:
    return name in _AFTER or any(
        m[1].lower() in ("class", "id", "role") and not _AFTER_NAMES.isdisjoint(_SPLIT.split((m[2] or "").lower()))
        for m in _ATTRIBUTE.finditer(attributes))


def _never_closed(page: str) -> set[int]:
    """Places after the start tags that no end tag belongs to."""
    opened: dict[str, list[int]] = {}
    at = 0
    while m := _MARKUP.search(page, at):
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closes = m[1] or m[4]
        if name in _RAW and not closes:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif closes:
            if opened.get(name):
                opened[name].pop()
        elif name and name not in _VOID:
            opened.setdefault(name, []).append(at)
    return {k for places in opened.values() for k in places}


class _Lines:
    """Lines of text with their link text and where they stand: article (0: none), box, named part (0: none)."""

    def __init__(self):
        self.texts, self.linked, self.places = [], [], []
        self.parts, self.link = [], 0
        self.around, self.why, self.holds = {0: 0}, {}, set()  # named parts: the one around, why, those that hold an article

    def end(self, place):
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.texts.append(text)
            self.linked.append(self.link)
            self.places.append(place)
        self.parts, self.link = [], 0

    def blank(self, place):
        self.end(place)
        self.texts += [""] * WINDOW
        self.linked += [0] * WINDOW
        self.places += [(0, 0, 0)] * WINDOW

    def outer(self, part):
        """The named part and those around it."""
        while part:
            yield part
            part = self.around[part]


def _strip(page: str) -> _Lines:
    lines, stack, at, dropped, links = _Lines(), [], 0, 0, 0
    held, boxes, parts = [0], [0], [0]  # the article and main elements, boxes and named parts around
    n_seen, unclosed = 0, None

    def place():
        return held[-1], boxes[-1], parts[-1]

    def said(text):
        if text and not dropped:
            text = references.unescape(text)
            lines.parts.append(text)
            if links:
                lines.link += len(text.strip())

    def pop():
        nonlocal dropped, links
        name, why, *_ = stack.pop()
        links -= name == "a"
        if name in _SECTIONS or why:
            lines.blank(place())
        dropped -= why == SURE
        if why in (COMPOUND, TOKEN):
            parts.pop()
        if name in _MAIN:
            held.pop()
        if _is_box(name):
            boxes.pop()

    while True:
        m = _MARKUP.search(page, at)
        said(page[at: m.start() if m else len(page)])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                said(m[0][9:].removesuffix("]]>"))
            continue
        closes, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in _RAW:
            if not closes and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name not in _INLINE:
            lines.end(place())
        if name in _VOID:
            continue
        if closes:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                while len(stack) > depth:
                    pop()
            continue
        why = _unwanted(name, attributes)
        if name in _MAIN and (dropped or parts[-1]) and len(held) == 1 and not why:
            # an advert or menu that was never closed ends where the article begins
            unclosed = _never_closed(page) if unclosed is None else unclosed
            if all(spot in unclosed and not follows for _, no, spot, follows in stack if no):
                while dropped or parts[-1]:
                    pop()
        if name == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            inner = next((k for k in range(len(stack) - 1, -1, -1)
                          if stack[k][0] == name or stack[k][0] not in _INLINE), None)
            if inner is not None and stack[inner][0] == name:
                while len(stack) > inner:
                    pop()
        if attributes.endswith("/") and name not in _SECTIONS:
            continue
        if name in _SECTIONS or why:
            lines.blank(place())
        follows = bool(why) and _follows(name, attributes)
        n_seen += 1
        if name in _MAIN and not why and not dropped:
            if not any(no and behind for _, no, _, behind in stack):
                lines.holds.update(lines.outer(parts[-1]))
        stack.append((name, why, at, follows))
        dropped += why == SURE
        if why in (COMPOUND, TOKEN):
            lines.around[n_seen], lines.why[n_seen] = parts[-1], TOKEN if follows else why
            parts.append(n_seen)
        if name in _MAIN:
            held.append(n_seen)
        if _is_box(name):
            boxes.append(n_seen)
        links += name == "a"
    lines.end(place())
    return lines


def _is_box(name: str) -> bool:
    """Elements whose sections and paragraphs belong together."""
    return name not in _TEXTS and name not in ("section", "body", "html", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot")


def _blocks(weight, window):
    """(first, after last) of the lines between a surge and the next dive."""
    text = np.flatnonzero(weight)
    if not len(text):
        return []
    # a block ends where the window after its last line has dived to nothing
    dive = np.array([i + 1 >= len(weight) or window[i + 1] == 0 for i in text], bool)
    ends = np.flatnonzero(dive)
    if not len(ends) or ends[-1] < len(text) - 1:
        ends = np.r_[ends, len(text) - 1]
    return [(int(text[a]), int(text[b]) + 1) for a, b in zip(np.r_[0, ends[:-1] + 1], ends, strict=True)]


def main_text(page: str | None) -> str:
    """The main text: its blocks in page order, joined by line ends; empty if there is none.

    Of blocks of equal text the first is the main one.  A page whose only text
    is links has that of its article, if it has one.
    """
    lines = _strip(page or "")
    if not any(lines.texts):
        return ""
    size, linked = np.array([len(t) for t in lines.texts]), np.array(lines.linked)
    held, box, part = (np.array(x) for x in zip(*lines.places, strict=True))
    whole = np.where(linked <= LINKED * size, size, 0)
    if not whole.any():
        whole = np.where(held > 0, size, 0)

    def summed(gone):
        """Weights and windows of the lines whose named parts all stay, and their blocks."""
        out = np.array([any(x in gone for x in lines.outer(p)) for p in part])
        weight = np.where(out, 0, whole)
        window = np.convolve(weight, np.ones(WINDOW, int))[WINDOW - 1:]  # the sum of a line and the next WINDOW - 1
        return out, weight, window, _blocks(weight, window)

    def most(weight, blocks):
        return max((int(weight[a:b].sum()) for a, b in blocks), default=0)

    gone = {p for p, why in lines.why.items() if why == TOKEN or p not in lines.holds}
    out, weight, window, blocks = summed(gone)
    for kind in (COMPOUND, TOKEN):  # names that would take the main text are no names
        sure = {p for p in gone if lines.why[p] > kind}
        _, w, _, b = summed(sure)
        need = SHARE * most(w, b) if kind == COMPOUND else 1
        if gone != sure and most(weight, blocks) < need:
            first, last = max(b, key=lambda x: int(w[x[0]:x[1]].sum()))
            gone = gone - {x for p in part[first:last] for x in lines.outer(p)}
            out, weight, window, blocks = summed(gone)
    if not blocks:
        return ""
    mass = [int(weight[a:b].sum()) for a, b in blocks]
    peak = [int(window[a:b].max()) for a, b in blocks]
    best = int(np.argmax(mass))
    a, b = blocks[best]
    heaviest = a + int(np.argmax(weight[a:b]))
    home, own = int(held[heaviest]), int(box[heaviest])
    kept = []
    for k, (a, b) in enumerate(blocks):
        beside = home and held[a] == home or own and box[a] == own
        if not beside and peak[k] < SHARE * max(peak):
            continue
        if k != best and held[a] and not beside and mass[k] < SHARE * mass[best]:
            continue
        kept += [t for t, no in zip(lines.texts[a:b], out[a:b], strict=True) if t and not no]
    return "\n".join(kept)


def extract_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of ``pages``.

    A null or empty page has an empty text.  Whole pages are read, however
    long; nulls in ``page_id`` and ``url`` stay; other columns are left out.
    """
    def extract(batches):
        for batch in batches:
            texts = [main_text(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", out, "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col(html).cast("string").alias("html")).mapInArrow(
        extract, f"page_id long, url string, {out} string, n_chars long")
