"""Main text of web pages by line-block distribution.

Markup is stripped to one line per block element. Lines in menus, headers, footers,
sidebars, notices, adverts, forms and comment sections, and lines that are mostly
links, count no text; what stands apart inside a line is left out of it. Text lengths
are summed over sliding windows of ``WINDOW`` lines: text begins where a window surges
over the threshold and ends where the windows after it dive to nothing; the text lines
between are kept.

Structure goes before names. Where article elements hold text that surges and at least
half of the page's, all their lines that count are the text, short ones behind an advert
too, and nothing outside them. Inside them captions and paragraphs made of links count,
and a name sets an element apart only if every word of it tells of such a part
(``related-posts``, but not ``related-work``).

Defined cases: null, empty and textless pages give an empty text; unclosed or cut-off
markup ends with the page; repeated rows are extracted each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bound_batches

WINDOW, SURGE = 3, 86
#: Share of a line's text inside links from which the line is navigation.
LINK_SHARE = 0.6

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|select|svg|iframe|object|head)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)|</?[a-z][^<>]*(?:>|\Z)""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements that never hold the article's text.
_APART = frozenset("nav header footer aside form dialog button menu".split())
#: Elements that hold the whole page or article; names like has-sidebar tell of what is beside the text.
_WHOLE = frozenset("html body main article".split())
#: Names of classes, ids and roles of such elements.
_APART_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search"
    r"|nav\w*|menus?|breadcrumbs?|side-?bar|aside|footer|header|masthead|toolbar|share|sharing|social|related|recommend\w*|comments?|comment-?list|replies|reply|disqus|widgets?|complementary|contentinfo|navigation)(?=$|[\s_-])",
    re.I,
)
#: Words that may stand beside such a name in one name of an element inside an article.
_BESIDE = frozenset(
    "area articles bar block blocks body box button buttons cards center col column container content entry feed foot form global google head icons in inline inner item items left link links list main mid middle mini mobile module native"
    " outer page panel post posts primary right row secondary section site slot small stories sticky text thread title top bottom unit user wide wrap wrapper".split()
)
#: Blocks of prose, which count inside an article even if they are links.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())
#: How an owner's line begins.
_OWNER = re.compile(r"(?:©|\(c\)|copyright\b)", re.I)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul button".split()
)
#: Blocks whose end tag is often left out: the next block ends them.
_LOOSE = frozenset("p li dd dt td th tr option".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _names_apart(value: str, in_article: bool) -> bool:
    if not in_article:
        return bool(_APART_NAME.search(value))
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", re.sub("side-bar", "sidebar", name, flags=re.I)) if w]
        told = [w for w in words if _APART_NAME.search(w)]
        if _APART_NAME.search(name) and all(w in told or w.lower() in _BESIDE or w.isdigit() for w in words):
            return True
    return False


def _is_apart(tag: str, rest: str, in_article: bool) -> bool:
    if tag in _APART or tag == "figcaption" and not in_article:
        return True
    for name, value in _ATTRIBUTE.findall(rest) if rest else ():
        value = value.strip("\"'")
        name = name.lower()
        if name in ("class", "id", "role"):
            if tag not in _WHOLE and _names_apart(value, in_article):
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool]]:
    """(text, text that counts, whether in an article element) of each block of a page, in order."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool]] = []
    apart = inside = 0
    parts: list[str] = []
    beside: list[str] = []
    in_link = linked = 0
    at = 0

    def end_line() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        counts = len(text)
        if not inside:
            counts = 0 if linked > LINK_SHARE * counts or counts < SURGE and _OWNER.match(text) else counts
        elif not (stack and stack[-1][0] in _PROSE):
            counts = 0 if linked > LINK_SHARE * counts else counts
        out.append((text or " ".join("".join(beside).split()), counts, inside > 0))
        parts.clear()
        beside.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            (beside if apart else parts).append(text)
            if in_link and not apart:
                linked += len(" ".join(text.split()))

    def pop_to(i: int) -> None:
        nonlocal apart, inside
        while len(stack) > i:
            name, own = stack.pop()
            apart -= own
            inside -= name == "article"

    for m in _MARKUP.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if tag == "a":
            in_link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _BLOCKS:
            end_line()
            in_link = 0
            if not closing and stack and stack[-1][0] in _LOOSE and (tag == stack[-1][0] or stack[-1][0] == "p"):
                pop_to(len(stack) - 1)
        elif not closing and not apart and not _is_apart(tag, m["rest"] or "", inside > 0):
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
        elif tag not in _VOID and not (m["rest"] or "").endswith("/"):
            own = _is_apart(tag, m["rest"] or "", inside > 0)
            stack.append((tag, own))
            apart += own
            inside += tag == "article"
    add(page[at:])
    end_line()
    return out


def main_text(page: str | None) -> str:
    """The kept blocks of a page, joined by newlines."""
    rows = lines(page or "")
    total = sum(counts for _, counts, _ in rows)
    if not total:
        return ""
    window = _windows([counts for _, counts, _ in rows])
    # a page with little text surges at half of its fullest window
    surge = min(SURGE, (max(window) + 1) // 2)
    inside = [counts if own else 0 for _, counts, own in rows]
    if 2 * sum(inside) >= total and max(_windows(inside)) >= surge:
        return "\n".join(text for (text, _, _), counts in zip(rows, inside) if counts)
    n = len(rows)
    kept: list[str] = []
    i = 0
    while i < n:
        if not window[i]:
            i += 1
            continue
        dive = i
        while dive < n and window[dive]:
            dive += 1
        if max(window[i:dive]) >= surge:
            kept += [text for text, counts, _ in rows[i:dive] if counts]
        i = dive
    return "\n".join(kept)


def _windows(counts: list[int]) -> list[int]:
    """Text of the ``WINDOW`` lines from each line on."""
    sums = [0, *accumulate(counts)]
    n = len(counts)
    return [sums[min(n, i + WINDOW)] - sums[i] for i in range(n)]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages`` (page_id, url, html)."""
    bound_batches(pages.sparkSession)

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    from shelfwise.llm.common import table

    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))
