"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped into lines, one per block element; an element's weight is the length of its text outside links,
and nothing where the markup says what it is: menus, headers, footers, sidebars, notices, adverts, forms, comments.
A class, id or role alone says nothing of an element that holds most of the text of the page's articles (of all its text,
where it marks none), or an article's h1.
Where the page marks an article, each of its lines is kept, links too. Elsewhere weights are summed over sliding windows of
lines: the text surges where the sum rises from nothing and dives where it falls back, and every stretch between is kept,
without its lines of no weight, if its highest sum is comparable to the page's: `DENSE` of the median of all
sums above zero.

The page is read once from left to right, in time linear in its length. Markup is read as browsers do, but leniently where
it is broken: a quote that is never closed is a character like others, a tag that is never closed is text that is left out.
Null and empty pages have an empty text, pages of any length are read whole. Rows are judged one by one, repeated rows and
null ids too; an empty table gives no rows; columns other than page_id, url, html play no part.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never article text.
ASIDE = frozenset("nav footer aside form button select dialog menu head fieldset datalist".split())
#: Words in class, id or role that say the same of any element.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies"
    " complementary disqus dialog footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup promo promoted promotion"
    " related recommended replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Elements whose content is no markup, and ones whose content is no text of the page.
RAW = frozenset("script style textarea iframe noembed noframes xmp title".split())
ASIDE_ALWAYS = frozenset("noscript template svg object canvas audio video math".split())
#: Lines of a window on either side of a line; share of the median sum that a stretch reaches.
REACH, DENSE = 1, 0.125
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>=\"']*")
_VALUE = re.compile(r"\s*([\"']?)")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup, from left to right; comments and the like have no name.

    Elements of `RAW` are one piece with their content, and that piece has no name either.
    """
    at, size = 0, len(page)
    missing: set[str] = set()  # what does not stand anywhere behind

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        found = page.find(what, start)
        if found < 0:
            missing.add(what)
        return found

    while (start := page.find("<", at)) >= 0:
        following = page[start + 1 : start + 2]
        if following in ("!", "?"):
            comment = page.startswith("<!--", start)
            end = find("-->" if comment else ">", start + 4 if comment else start)
            at = size if end < 0 else end + (3 if comment else 1)
            yield start, at, False, "", ""
            continue
        named = _NAME.match(page, start + 1 + (following == "/"))
        if not named:
            at = start + 1
            continue
        if find(">", named.end()) < 0:
            yield start, size, False, "", ""
            return
        end = named.end()
        while True:
            end = _PLAIN.match(page, end).end()
            if page[end] == ">":
                break
            if page[end] == "=":  # a value: quoted, or up to white space or the tag's end
                value = _VALUE.match(page, end + 1)
                closed = find(value[1], value.end()) if value[1] else -1
                if closed >= 0 and find(">", closed) >= 0:
                    end = closed + 1
                else:
                    end = value.end()
                    while page[end] != ">" and not page[end].isspace():
                        end += 1
            else:
                end += 1
        name, closing = named[0].lower(), following == "/"
        at = end + 1
        if name in RAW and not closing:
            close = re.compile(f"</{name}\\b[^>]*>?", re.I).search(page, at) if f"</{name}" not in missing else None
            if close:
                yield start, close.end(), False, "", ""
                at = close.end()
                continue
            missing.add(f"</{name}")
            if name in ("script", "style"):
                yield start, size, False, "", ""
                return
            yield start, at, False, "", ""
            continue
        if name in ASIDE_ALWAYS and page[end - 1] == "/":
            name = ""  # closes itself
        yield start, at, closing, name, page[named.end() : end]


def held(page: str) -> tuple[int, int, dict[int, tuple[int, bool, int]]]:
    """Lengths of a page's text outside links: within article or main, and of all; the same by the end of each start tag, with whether the element holds an h1 between."""
    counts = [0, 0, 0]  # text in articles, h1 and text until here
    linked, end = False, 0
    stack: list[tuple[str, int, tuple[int, ...]]] = []
    opened: Counter[str] = Counter()
    found_in: dict[int, tuple[int, bool, int]] = {}

    def read(text: str) -> None:
        if not linked:
            n = len(" ".join(text.split()))
            counts[0] += n * (opened["article"] + opened["main"] > 0)
            counts[2] += n

    def close() -> str:
        tag, at, before = stack.pop()
        opened[tag] -= 1
        inside, titles, text = (now - then for now, then in zip(counts, before))
        found_in[at] = (inside, titles > 0, text)
        return tag

    for start, behind, closing, tag, _ in tags(page):
        read(page[end:start])
        end = behind
        if not tag or tag in VOID:
            continue
        if tag in BLOCKS and stack and stack[-1][0] == "p" and not closing:
            close()
        if tag == "a":
            linked = not closing
        if closing:
            while opened[tag] and close() != tag:
                pass
        else:
            counts[1] += tag == "h1"
            stack.append((tag, end, tuple(counts)))
            opened[tag] += 1
    read(page[end:])
    while stack:
        close()
    return counts[0], counts[2], found_in


def set_aside(tag: str, attributes: str, in_article: bool, main: Callable[[], bool]) -> bool:
    """Whether an element is set aside; a word of its class, id or role alone doesn't do if it holds `main` content."""
    if tag in ASIDE or tag in ASIDE_ALWAYS or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main") and not _NAMED.search(attributes):
        return False
    if _HIDDEN.search(attributes):
        return True
    for _, a, b, c in _NAMED.findall(attributes):
        parts = {p.lower() for p in _PART.findall(a or b or c)}
        if tag in ("html", "body", "main") or in_article and tag in ("h1", "h2", "header"):
            continue
        if parts & WORDS:
            return not main()
    return False


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, within an article) of each line in the page's order."""
    lines: list[tuple[str, int, bool]] = []
    pieces: list[str] = []
    linked = 0
    aside, depth, article, links = "", 0, 0, 0
    whole: tuple[int, int, dict[int, tuple[int, bool, int]]] | None = None

    def main() -> bool:
        nonlocal whole
        whole = whole or held(page)
        marked, total, found_in = whole
        inside, titles, text = found_in.get(end, (0, False, 0))
        return article > 0 and titles or (2 * inside > marked if marked else 2 * text > total)

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if aside or text:  # an element that is set aside is one line without text
            lines.append((text if not aside else "", 0 if aside else max(0, len(text) - linked), article > 0))
        pieces.clear()
        linked = 0

    end = 0
    for start, behind, closing, tag, attributes in tags(page):
        text = page[end:start]
        end = behind
        if text and not aside:
            pieces.append(text)
            if links:
                linked += len(" ".join(entities.unescape(text).split()))
        if not tag:
            continue
        block = tag in BLOCKS
        if aside:
            if aside == "p" and block and not (closing and tag == "p"):
                aside = ""  # a paragraph ends where the next block begins
            elif tag == aside:
                depth += -1 if closing else 1
                if depth <= 0:
                    flush()
                    aside = ""
                continue
            elif tag == "body" and aside == "head":
                aside = ""
            else:
                continue
        if block:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if tag == "a":
            links = 0 if closing else 1
        elif tag in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        if not closing and tag not in VOID and set_aside(tag, attributes, article > 0, main):
            if tag in ("article", "main"):
                article -= 1
            if not block:
                flush()
            aside, depth = tag, 1
    if not aside:
        pieces.append(page[end:])
    flush()
    return lines


def main_text(page: str | None) -> str:
    lines = lines_of(page or "")
    if any(article and weight for _, weight, article in lines):
        return "\n\n".join(text for text, _, article in lines if article and text)
    weights = [weight for _, weight, _ in lines]
    sums = [sum(weights[max(0, k - REACH) : k + REACH + 1]) for k in range(len(weights))]
    above = sorted(n for n in sums if n)
    least = DENSE * above[len(above) // 2] if above else 0
    kept: list[str] = []
    for surge, stretch in groupby(range(len(lines)), key=lambda k: sums[k] > 0):
        among = list(stretch)
        if surge and max(sums[k] for k in among) >= least:
            kept += [lines[k][0] for k in among if lines[k][1]]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars long."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 1000) for whole in batches for k in range(0, len(whole), 1000)):
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(go, "page_id long, url string, text string, n_chars long")
