"""Line-block distribution: the main text of a page lies between a surge and a dive of its line-block lengths.

Markup is stripped: comments, scripts, styles and the head go whole, block tags become line ends, other tags vanish
and character references are resolved. Line breaks of the source count within ``pre`` and in pages without any tag;
elsewhere they are white space. A block is ``width`` consecutive lines from a line on; its length is that of
their text without white space. Text begins at a surge (a block longer than ``surge`` with text in the next block)
and ends at a dive (a block of at most ``dive`` characters); what lies between is kept, and all kept runs are joined.

Defined cases: a null html gives null text and no lines; an empty page, or one with no surge, gives an empty text;
tags and comments that never close are taken to end at the next ``<`` or the end of the page; a script or style that
never closes runs to the end of the page, a head to ``<body`` or, without one, to the end of its tag, and other elements that go whole count as tags if
they never close; a very long page takes time in proportion to its length, whatever it holds; of equally good places
the first surge and the first dive count; repeated rows are handled one by one; an empty table gives no rows; other
columns, whatever their names, are ignored and page_id may be null.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetweave.llm._spark import Batches, tidy

WIDTH, SURGE, DIVE = 3, 86, 0

_OPEN = re.compile(r"<!--|<(script|style|noscript|template|head|svg|iframe)\b[^<>]*>?|<!\w[^<>]*>?", re.I)
_CLOSE = {n: re.compile(p, re.I) for n, p in {
    "<!--": "-->", "head": r"</head\s*>?|(?=<body\b)", **{n: rf"</{n}\s*>?" for n in ("script", "style", "noscript", "template", "svg", "iframe")},
}.items()}
_PRE, _PRE_END = re.compile(r"<pre\b[^<>]*>?", re.I), re.compile(r"</pre\b", re.I)
_BLOCK = re.compile(
    r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|thead|tbody|tfoot|tr|td|th|section|article|aside|nav|header|footer|main|body|html|blockquote|pre|form|fieldset|figure|figcaption|address|title|option|select)\b[^<>]*>?", re.I
)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>?")
_SPACE = re.compile(r"\s+")

SCHEMA = "page_id long, n_lines int, n_runs int, kept_lines int, text string"


def without_whole(page: str) -> str:
    """The page without comments, declarations and the elements that go whole.

    One forward pass: what a closer was found for is left behind, and a closer that isn't found isn't looked for again.
    """
    out, at, gone = [], 0, set()
    while m := _OPEN.search(page, at):
        out.append(page[at : m.start()])
        kind, at = (m[1] or m[0][:4]).lower(), m.end()
        if kind not in _CLOSE:
            out.append(" ")
            continue
        end = None if kind in gone else _CLOSE[kind].search(page, at)
        if end is None:
            gone.add(kind)
        if end:
            out.append(" ")
            at = end.end()
        elif kind == "<!--":
            out.append(" ")
            at = nxt if (nxt := page.find("<", at)) >= 0 else len(page)
        elif kind in ("script", "style"):
            at = len(page)
    return "".join([*out, page[at:]])


def pre_breaks(page: str) -> str:
    """The page with the line breaks within pre as tags; a pre that never closes runs to the end."""
    out, at = [], 0
    while m := _PRE.search(page, at):
        end = _PRE_END.search(page, m.end())
        stop = end.start() if end else len(page)
        out += [page[at : m.end()], page[m.end() : stop].replace("\n", "<br>")]
        at = stop
    return "".join([*out, page[at:]])


def lines(page: str) -> list[str]:
    """The lines of a page without markup, blank ones included, white space folded."""
    if not _TAG.search(page) and "<!" not in page:
        return [_SPACE.sub(" ", x).strip() for x in entities.unescape(page).split("\n")]
    page = _SPACE.sub(" ", pre_breaks(without_whole(page.replace("\r\n", "\n"))))
    page = _TAG.sub("", _BLOCK.sub("\n", page))
    return [_SPACE.sub(" ", x).strip() for x in entities.unescape(page).split("\n")]


def runs(lengths: np.ndarray, width: int = WIDTH, surge: int = SURGE, dive: int = DIVE) -> list[tuple[int, int]]:
    """Line ranges between surges and dives."""
    n = len(lengths)
    total = np.concatenate(([0], np.cumsum(lengths)))
    block = (total[np.minimum(np.arange(n) + width, n)] - total[:n]).tolist() + [0]
    found, start = [], -1
    for i in range(n):
        if start < 0 and block[i] > surge and (block[i + 1] > dive or i + 1 == n or n == 1):
            start = i
        if start >= 0 and block[i] <= dive:
            found.append((start, i))
            start = -1
    if start >= 0:
        found.append((start, n))
    return found


def main_text(page: str | None, width: int = WIDTH, surge: int = SURGE, dive: int = DIVE) -> tuple:
    if page is None:
        return 0, 0, 0, None
    rows = lines(page)
    found = runs(np.fromiter((len(x) - x.count(" ") for x in rows), np.int64, len(rows)), width, surge, dive)
    kept = [x for a, b in found for x in rows[a:b] if x]
    return len(rows), len(found), len(kept), "\n".join(kept)


def extract(pages: DataFrame, width: int = WIDTH, surge: int = SURGE, dive: int = DIVE) -> DataFrame:
    """One row a page: its number of lines and runs, and the text kept."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            cols = list(zip(*(main_text(x.as_py(), width, surge, dive) for x in b.column(1)))) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.string())))], ["page_id", "n_lines", "n_runs", "kept_lines", "text"])

    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(tidy(run), SCHEMA)
