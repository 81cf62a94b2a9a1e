"""Main text of web pages by tag-path ratios.

Every piece of text belongs to the path of tags from the root to it. Per path the text
length, the punctuation, the number of pieces and the share of link text are aggregated
over the page. Two ratios follow: characters for each piece, and punctuation marks for
each piece. Both are smoothed along the page's order of paths, fused by multiplication,
and paths above a share of the page's deviation are content, unless they are mostly links.
An ``article`` or ``main`` element adds as much as that share to the ratios of its paths, so
short lines and lists in it stay; paths outside it are content by their own ratios.

Text of elements that stand for something else by their tag (menus, headers and footers of
the page, asides, forms) or are hidden never is content. A word of a class or id that stands
for something else (side bars, notices, adverts, comments of readers) lowers the ratios of
all below it. It does not on an ``article`` or ``main``, above most of their text, nor on an
element with most of the page's text (nine tenths where an ``article`` or ``main`` has text
outside it, as readers' comments can be longer than what they are about).

Each page is read whole on its own, so nothing is shuffled and a page may have any length.

Defined results: null or empty html gives an empty text; a page without tags is one block
of text; unclosed and stray tags are closed as a browser would close them; repeated rows
and extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.frames import append

WINDOW = 1
SHARE = 0.35
MOST_LINKS = 0.6
# What a word that stands for something else leaves of a ratio.
LOWERED = 0.02
SCHEMA = "text string, n_chars bigint"
# Fixed values of the language of pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select button canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
OTHER = frozenset("nav footer aside form head menu dialog".split())
HEADER = frozenset(["header"])
MAIN = frozenset(["article", "main"])
OTHER_WORDS = re.compile(
    r"(?:^|[\s_-])(?<!\bhas[_-])(?<!\bno[_-])(?<!\bwith[_-])(?<!\bwithout[_-])"
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav(?:bar|igation|list|menu)?|menu\w*|breadcrumbs?|sidebar|widget|footer|"
    r"masthead|site-header|page-header|cookie\w*|consent|notices?|gdpr|popup|modal|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommend\w*|comments?|comment-\w+|replies|reply|disqus|respond|feedback|"
    r"pagination|pager|search|copyright|disclaimer|toolbar|tags)(?:$|[\s_-])|"
    # These stand for something else only as a whole name.
    r"(?:^|\s)(?:side|legal|tag)(?:$|\s)",
    re.I,
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|"
    r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+(?=>)|[^<>]*(?=>))>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?¿¡。、，！？…]")
_SPACE = re.compile(r"\s+")
# An opening tag ends these open elements, as end tags of theirs are often left out.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol dl table tbody thead tfoot article section main div body".split())


@dataclass
class Named:
    """An element whose class or id has a word that stands for something else."""

    above: Named | None
    # An article or main; inside one
    is_main: bool
    in_main: bool
    chars: int = 0
    main_chars: int = 0


@dataclass
class Path:
    """What a page has under one tag path."""

    chars: int = 0
    marks: int = 0
    pieces: int = 0
    link_chars: int = 0
    other: bool = False
    main: bool = False
    named: Named | None = None


@dataclass
class Page:
    paths: dict[str, Path] = field(default_factory=dict)
    # (block number, path, text) in page order
    pieces: list[tuple[int, str, str]] = field(default_factory=list)


def _raw_end(source: str, name: str, at: int) -> int:
    found = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(source, at)
    return found.end() if found else len(source)


def _attributes(rest: str) -> tuple[str, bool]:
    """The class, id and role of a tag, and whether it is hidden."""
    names, hidden = [], False
    for key, *values in _ATTRIBUTE.findall(rest):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id", "role"):
            names += [value] if value else []
        elif key == "hidden":
            hidden = hidden or value.lower() != "until-found"
        elif key == "aria-hidden":
            hidden = hidden or value.lower() == "true"
        elif key == "style":
            hidden = hidden or bool(_NO_DISPLAY.search(value))
    return " ".join(names), hidden


def read_page(source: str) -> Page:
    """Cuts a page into pieces of text with their paths."""
    page = Page()
    # tag, whether it stands for something else, in the main part, in a link, path, innermost named element
    stack: list[tuple[str, bool, bool, bool, str, Named | None]] = [("", False, False, False, "", None)]
    # One for each path, however often it opens.
    named: dict[str, Named] = {}
    block, at = 0, 0

    def add(raw: str) -> None:
        _, other, main, link, path, word = stack[-1]
        if not raw or raw.isspace():
            if raw:
                page.pieces.append((block, path, " "))
            return
        text = html.unescape(raw)
        page.pieces.append((block, path, text))
        seen = page.paths.setdefault(path, Path(other=other, main=main, named=word))
        size = len(text.strip())
        seen.chars += size
        seen.link_chars += size * link
        seen.marks += len(_PUNCTUATION.findall(text))
        seen.pieces += 1

    def close_to(depth: int) -> None:
        nonlocal block
        if any(e[0] in BLOCKS for e in stack[depth:]):
            block += 1
        del stack[depth:]

    while at < len(source):
        token = _TOKEN.search(source, at)
        if token is None:
            add(source[at:])
            break
        add(source[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        name, rest = token[2].lower(), token[3] or ""
        if token[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == name:
                    close_to(depth)
                    break
            else:
                block += name in BLOCKS
            continue
        if name in RAW:
            at = at if rest.rstrip().endswith("/") else _raw_end(source, name, at)
            continue
        if name in VOID:
            if name == "br":
                page.pieces.append((block, stack[-1][4], " "))
            elif name == "hr":
                block += 1
            continue
        if name in BLOCKS:
            block += 1
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == "p":
                    close_to(depth)
                    break
                if stack[depth][0] in HOLDERS or stack[depth][0] in ("td", "th", "li", "blockquote"):
                    break
        if name in ENDS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in ENDS[name]:
                    close_to(depth)
                    break
                if stack[depth][0] in HOLDERS:
                    break
        names, hidden = _attributes(rest) if rest else ("", False)
        _, other, main, link, path, word = stack[-1]
        inner_header = name in HEADER and not main
        other = other or name in OTHER or inner_header or hidden
        path = f"{path}/{name}" + (f".{names}" if names else "") + ("!" if hidden else "")
        if names and name not in ("html", "body") and OTHER_WORDS.search(names):
            word = named.setdefault(path, Named(word, name in MAIN, main))
        stack.append((name, other, main or name in MAIN, link or name == "a", path, word))
    return page


def _chain(named: Named | None):
    while named is not None:
        yield named
        named = named.above


def _lowered(paths: list[Path]) -> list[bool]:
    """Whether a word on or above each path lowers it."""
    total = sum(x.chars for x in paths)
    main = sum(x.chars for x in paths if x.main)
    for x in paths:
        for e in _chain(x.named):
            e.chars += x.chars
            e.main_chars += x.chars * x.main

    def counts(e: Named) -> bool:
        around = not e.in_main and 2 * e.main_chars > main
        most = 0.9 if main > e.main_chars else 0.5
        return not (e.is_main or around or e.chars > most * total)

    return [any(counts(e) for e in _chain(x.named)) for x in paths]


def content_paths(page: Page) -> set[str]:
    """The paths that hold content: smoothed, fused and thresholded ratios."""
    paths = [p for p, x in page.paths.items() if not x.other]
    if not paths:
        return set()
    per = [page.paths[p] for p in paths]
    lengths = np.array([x.chars / x.pieces for x in per])
    marks = np.array([x.marks / x.pieces for x in per])
    kernel = np.ones(2 * WINDOW + 1) / (2 * WINDOW + 1)
    smooth = lambda v: (v + np.convolve(np.pad(v, WINDOW, "edge"), kernel, "valid")) / 2
    left = np.where(_lowered(per), LOWERED, 1.0)
    fused = smooth(lengths) * (1 + smooth(marks)) * left
    least = SHARE * fused.std()
    links = np.array([x.link_chars / max(1, x.chars) for x in per])
    inside = np.array([x.main for x in per])
    good = (fused + least * inside * left >= least) & (inside | (links <= MOST_LINKS))
    return {p for p, ok in zip(paths, good, strict=True) if ok}


def main_text(source: str | None) -> str:
    page = read_page(source or "")
    content = content_paths(page)
    # Links inside a content block belong to it.
    blocks: dict[int, list[str]] = {}
    wanted = {b for b, path, _ in page.pieces if path in content}
    for block, path, text in page.pieces:
        if block in wanted and not (path in page.paths and page.paths[path].other):
            blocks.setdefault(block, []).append(text)
    texts = (_SPACE.sub(" ", "".join(parts)).strip() for _, parts in sorted(blocks.items()))
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, the main text and its length for each row of pages."""

    def work(batch):
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        return [texts, [len(t) for t in texts]]

    return append(pages.select("page_id", "url", "html"), SCHEMA, lambda: work).drop("html")
