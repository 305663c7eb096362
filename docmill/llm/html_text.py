"""Main text of HTML by line-block distribution.

Markup is stripped to lines, one for each block of text. A line weighs the characters that the tags around it speak for:
those outside links in a page without an article, all inside the article of a page that marks one (with text that is no
furniture), none elsewhere and none in furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments).
The weights are summed over sliding windows of 2 * REACH + 1 lines. A stretch of text surges at its first line of weight
whose window reaches SURGE after one that did not, and dives at its last line of weight before a window that falls below
it. All stretches are kept, with all their lines but furniture: so lines of links between two paragraphs stay, and
those of a menu before the surge go. SURGE is one character: the contract keeps every paragraph, however short or far
from others, and any higher threshold loses some.

Defined cases: null or empty html, or html without text, gives an empty text; unclosed and cut-off markup ends where
the page does; a self-closed element ends there; the text of math stays; '<' that opens no tag is text; unknown
character references stay as they are; pages are independent, so ties, repeated rows and null ids need no rule; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import focus, trimmed

#: Attributes of a tag, and those of a self-closed one to its '/' (that of an unquoted value is the value's).
ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
CLOSED = r"""(?:[^>"'=/]|/(?!>)|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?|"[^"]*+"|'[^']*+')*+/"""
#: Elements whose text is not the page's. One that closes itself ends there; a script or style only where no end tag
#: comes before the next of its kind.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?:(?:noscript|template|svg|iframe|object|textarea|title|canvas|video|audio|select)(?=[\s/>]){CLOSED}>|(script|style)(?=[\s/>]){CLOSED}>(?!(?:(?!<\1[\s/>]).)*?</\1\s*>))"
    rf"|<(script|style|noscript|template|svg|iframe|object|textarea|title|canvas|video|audio|select)(?=[\s/>]){ATTRIBUTES}(?:>.*?(?:</\2\s*>|\Z)|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form button dialog menu head fieldset".split())
NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Names of furniture, and names that say nothing more of what they stand with.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar rail widget widgets related recommended recommendations share sharing social follow breadcrumb breadcrumbs menu nav navbar navigation topbar toolbar masthead footer pagination pager comment comments comment-list respond replies reply disqus reader-comments search searchbox skip-link navigation contentinfo complementary dialog form".split()
)
PLAIN = frozenset("site page main global post article bar box button buttons link links list block blocks section container wrapper wrap area panel unit slot item items icon icons tool tools top bottom left right inner outer group body header head content text title row col column primary secondary policy law settings us media reader user js the".split())
#: Elements of running text: in an article, only a whole name makes one furniture.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tr td th figure figcaption span b i em strong a code".split())
#: Lines on either side of one that its window takes; weight from which a window counts as text.
REACH, SURGE = 1, 1


def _names_furniture(word: str, whole: bool) -> bool:
    if word in NAMES or whole:
        return word in NAMES
    parts = [p for p in re.split(r"[-_0-9]+", word) if p]
    return any(p in NAMES for p in parts) and all(p in NAMES or p in PLAIN for p in parts)


def _is_furniture(name: str, attributes: str, inside: bool) -> bool:
    if name in FURNITURE or (name == "header" and not inside):
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes, re.I):
        return True
    whole = inside and name in RUNNING
    return any(_names_furniture(word, whole) for m in NAMED.finditer(attributes) for word in (m[1] or m[2] or m[3] or "").lower().split())


def blocks(page: str) -> list[tuple[str, bool, bool, int]]:
    """(text, in the article, furniture, characters in links) of each block of a page, in its order."""
    out: list[tuple[str, bool, bool, int]] = []
    open_: list[tuple[str, bool, bool, bool]] = []  # name, in the article, furniture, link
    parts: list[str] = []
    linked: list[str] = []
    now = ("", False, False, False)

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, now[1], now[2], len(" ".join(html.unescape(" ".join(linked)).split()))))
        parts.clear()
        linked.clear()

    at = 0
    for m in TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if now[3]:
                linked.append(page[at : m.start()])
        at = m.end()
        name = (m[4] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if m[3]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    del open_[k:]
                    break
                if open_[k][0] in ("article", "main", "body") and name not in BLOCKS:
                    break
        elif name not in VOID and not m[5].rstrip().endswith("/"):
            if name in BLOCKS and open_:  # a block ends an open paragraph, and what is open in it
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == "p" or (name == "li" and open_[k][0] == "li"):
                        del open_[k:]
                        break
                    if open_[k][0] in BLOCKS:
                        break
            now = open_[-1] if open_ else ("", False, False, False)
            inside = now[1] or name in ("article", "main") or re.search(r"""role\s*=\s*["']?main\b""", m[5]) is not None
            open_.append((name, inside, now[2] or _is_furniture(name, m[5], inside), now[3] or name == "a"))
        now = open_[-1] if open_ else ("", False, False, False)
    parts.append(page[at:])
    flush()
    return out


def weights(found: list[tuple[str, bool, bool, int]]) -> list[int]:
    """What each line weighs."""
    marked = any(inside and not furniture for _, inside, furniture, _ in found)
    weigh = lambda text, inside, links: (len(text) if inside else 0) if marked else max(0, len(text) - links) if 2 * links <= len(text) else 0
    return [0 if furniture else weigh(text, inside, links) for text, inside, furniture, links in found]


def stretches(size: list[int]) -> list[tuple[int, int]]:
    """The first and last line of each stretch between a surge and a dive."""
    before = [0]
    for s in size:
        before.append(before[-1] + s)
    n = len(size)
    text = [before[min(n, i + REACH + 1)] - before[max(0, i - REACH)] >= SURGE for i in range(n)]
    out, first, last = [], None, None
    for i, on in enumerate([*text, False]):
        if on and size[i]:
            first, last = (i if first is None else first), i
        elif not on and first is not None:
            out.append((first, last))
            first = None
    return out


def main_text(page: str | None) -> str:
    """The text of all stretches between a surge and a dive."""
    found = blocks(page or "")
    size = weights(found)
    marked = any(inside and not furniture for _, inside, furniture, _ in found)
    kept = [found[i] for a, b in stretches(size) for i in range(a, b + 1)]
    return "\n\n".join(text for text, inside, furniture, _ in kept if not furniture and (inside or not marked))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        focus("html_text")
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
