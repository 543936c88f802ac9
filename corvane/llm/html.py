"""HTML extraction by tag-path ratios.

A page's text nodes are aggregated by their root-to-leaf tag path: the characters and
the punctuation marks that a node of the path has on average. Both ratios are
smoothed over the tree of paths, where a path at distance d counts ``DECAY``**d (two passes
over the tree give the exact sums), and fused by their geometric mean. Paths whose
fused ratio reaches ``LAMBDA`` times the standard deviation that it has over the
characters of the page, but no more than the page's best path, are content; so are text
nodes of inline elements in a block of content. Script, style and comments are no text.

Paths are nodes of a tree, not strings, so deep nesting costs no more than wide pages.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.arrowtext import arrow_batches, pieces

DECAY = 0.25
LAMBDA = 1.5

# A quoted value ends before the next "<" at the latest, so that a lone quote costs one tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/>]*+)(?:[^>"']|"[^"<]*"|'[^'<]*')*+>|<(/?)([A-Za-z][^\s/>]*+)[^>]*(?:>|\Z)""",
    re.S,
)
_RAW = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in ("script", "style", "noscript", "template", "iframe", "svg")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
#: Open elements that a start tag closes, up to the container that holds both.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_HOLDS = frozenset("article aside blockquote body button caption div footer form header html li main nav object section table td th".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？«»„“”]")
_SPACES = re.compile(r"\s+")


class Page:
    """Text nodes of one page: (path, text, is it the first after a break)."""

    def __init__(self, source: str):
        self.parent, self.inline = [-1], [False]
        self.nodes: list[tuple[int, str, bool]] = []
        kids: dict[tuple[int, str], int] = {}
        names: list[str] = []
        # depths at which each name is open, so that no tag looks through the open elements
        open_at: dict[str, list[int]] = {}
        path = [0]
        at, size, broken = 0, len(source), True

        def take(end: int) -> None:
            nonlocal broken
            if at < end:
                text = source[at:end]
                if not text.isspace():
                    self.nodes.append((path[-1], html.unescape(text) if "&" in text else text, broken))
                    broken = False

        def close(depth: int) -> None:
            for gone in names[depth:]:
                open_at[gone].pop()
            del names[depth:], path[depth + 1 :]

        def deepest(of: Iterable[str]) -> int:
            return max((open_at[n][-1] for n in of if open_at.get(n)), default=-1)

        while match := _TOKEN.search(source, at):
            take(match.start())
            at = match.end()
            name = match[2] or match[4]
            if not name:
                continue
            name = name.lower()
            closing = (match[1] or match[3]) == "/"
            if name not in _INLINE:
                broken = True
            if closing:
                if open_at.get(name):
                    close(open_at[name][-1])
                continue
            if name in _VOID:
                continue
            if name in _RAW and not source.endswith("/>", match.start(), at):
                end = _RAW[name].search(source, at)
                at = end.end() if end else size
                continue
            shut, within = ({"p"}, _HOLDS) if name in _BLOCK else _CLOSES.get(name, ((), ()))
            if shut and (depth := deepest(shut)) > -1 and depth > deepest(within):
                close(depth)
            key = (path[-1], name)
            if key not in kids:
                kids[key] = len(self.parent)
                self.parent.append(path[-1])
                self.inline.append(name in _INLINE)
            open_at.setdefault(name, []).append(len(names))
            names.append(name)
            path.append(kids[key])
        take(size)


def smoothed(value: list[float], used: list[bool], parent: list[int], decay: float = DECAY) -> list[float]:
    """Mean of the values of used paths, weighted by decay ** distance, at each path."""
    n = len(parent)
    low = [[v if u else 0.0 for v, u in zip(value, used)], [1.0 if u else 0.0 for u in used]]
    out = []
    for total in low:
        below = total[:]
        for i in range(n - 1, 0, -1):
            below[parent[i]] += decay * below[i]
        whole = below[:]
        for i in range(1, n):
            # the parent's sum without what came from here
            whole[i] = below[i] + decay * (whole[parent[i]] - decay * below[i])
        out.append(whole)
    return [a / b if b else 0.0 for a, b in zip(*out)]


def content(source: str, decay: float = DECAY, strict: float = LAMBDA) -> tuple[str, int, int]:
    """(content, paths with text, content paths)."""
    page = Page(source)
    n = len(page.parent)
    count, chars, marks = [0] * n, [0] * n, [0] * n
    for path, text, _ in page.nodes:
        count[path] += 1
        chars[path] += len(_SPACES.sub(" ", text).strip())
        marks[path] += len(_PUNCTUATION.findall(text))
    used = [c > 0 for c in count]
    paths = sum(used)
    if not paths:
        return "", 0, 0
    texts = smoothed([t / max(c, 1) for t, c in zip(chars, count)], used, page.parent, decay)
    points = smoothed([m / max(c, 1) for m, c in zip(marks, count)], used, page.parent, decay)
    # a page without any mark is judged by text alone
    plain = not any(marks)
    fused = [math.sqrt(t * (1 if plain else p)) for t, p in zip(texts, points)]
    total = sum(chars)
    mean = sum(f * c for f, c in zip(fused, chars)) / total
    spread = math.sqrt(sum(c * (f - mean) ** 2 for f, c in zip(fused, chars)) / total)
    best = max(f for f, u in zip(fused, used) if u)
    good = [u and f >= min(strict * spread, best) for f, u in zip(fused, used)]
    for i in range(1, n):
        if page.inline[i]:
            good[i] = good[i] or good[page.parent[i]]
    out: list[str] = []
    broken = False
    for path, text, first in page.nodes:
        broken |= first
        if good[path]:
            if broken and out:
                out.append("\n")
            out.append(_SPACES.sub(" ", text))
            broken = False
    lines = (_SPACES.sub(" ", line).strip() for line in "".join(out).split("\n"))
    return "\n".join(line for line in lines if line), paths, sum(g and u for g, u in zip(good, used))


def extract(pages: DataFrame, decay: float = DECAY, strict: float = LAMBDA) -> DataFrame:
    """(page_id, text, n_paths, n_content), one row for each row of pages: the text of the
    content paths, a line for each block; the number of paths with text; of those the content.

    A null html has a null text and 0 paths; an empty page, or one without text, an empty
    text. Text without any tag is one path and content. Null ids stay null, repeated rows
    have a row each, other columns are not looked at. Broken markup is read on as far as
    it goes: what is never closed ends with its container or the page, and an end tag that
    nothing open has is passed over. The time is linear in the page, whatever is unmatched."""
    arrow_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                rows = [(None, 0, 0) if source is None else content(source, decay, strict) for source in piece.column(1).to_pylist()]
                text, paths, good = zip(*rows) if rows else ((),) * 3
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(text, pa.string()), pa.array(paths, pa.int64()), pa.array(good, pa.int64())], ["page_id", "text", "n_paths", "n_content"])

    return pages.select(pages["page_id"].cast("long"), pages["html"]).mapInArrow(run, "page_id long, text string, n_paths long, n_content long")
