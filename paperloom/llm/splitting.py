"""Texts over a size limit as overlapping pieces, cut at natural boundaries by recursive bisection.

A stretch still longer than the limit less the overlap is cut at the strongest boundary near its middle, and both
halves again; then each piece after the first is given up to `overlap` characters of the end of the one before. An
unbroken stretch that fits the limit is never cut: its overlap shrinks instead. Only stretches without white space
longer than the limit are cut by force.

Sizes are in Unicode code points. Only texts over the limit reach Python (the filter is pushed to the scan's stage);
every text is handled whole in its own partition.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import map_batches

#: Strength of a boundary, from the end of a paragraph to any white space; 0 is no boundary.
PARAGRAPH, SENTENCE_LINE, SENTENCE, LINE, CLAUSE, SPACE = 6, 5, 4, 3, 2, 1
_space = re.compile(r"\s+")
_blank_line = re.compile(r"\n\s*\n")
_CLOSING = "\"'”’»)]"


def boundaries(text: str, limit: int) -> tuple[list[int], list[int]]:
    """Positions after white space, ascending, and their strengths. White space longer than half the limit may also
    be cut within."""
    at, strength = [], []
    for m in _space.finditer(text):
        s, e = m.span()
        run = m[0]
        last = text[s - 1] if s else ""
        if last in _CLOSING and s > 1:
            last = text[s - 2]
        ended = last in ".!?…"
        if "\n" in run or "\r" in run:
            kind = PARAGRAPH if run.count("\n") > 1 and _blank_line.search(run) else SENTENCE_LINE if ended else LINE
        else:
            kind = SENTENCE if ended else CLAUSE if last in ",;:–—" else SPACE
        if e - s > limit // 2:
            inner = range(s + limit // 2, e, limit // 2)
            at.extend(inner)
            strength.extend([SPACE] * len(inner))
        at.append(e)
        strength.append(kind)
    return at, strength


def _cut(at: list[int], strength: list[int], a: int, b: int) -> int | None:
    """The strongest boundary near the middle of [a, b): within a quarter of it, else anywhere; the nearest of equals."""
    middle, quarter = (a + b) // 2, (b - a) // 4
    for lo, hi in ((middle - quarter, middle + quarter), (a + 1, b - 1)):
        first, last = bisect_left(at, max(lo, a + 1)), bisect_right(at, min(hi, b - 1))
        if first < last:
            return at[min(range(first, last), key=lambda i: (-strength[i], abs(at[i] - middle)))]
    return None


def split_text(text: str, limit: int = 3000, overlap: int = 200) -> list[tuple[int, int, int, bool]]:
    """(start with overlap, start, end, forced) of each piece; forced tells that the cut before it was by force.

    A text within the limit is one piece; the empty text none.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if len(text) <= limit:
        return [(0, 0, len(text), False)] if text else []
    at, strength = boundaries(text, limit)
    todo, leaves = [(0, len(text), False)], []
    while todo:  # left halves first
        a, b, forced = todo.pop()
        if b - a <= limit - overlap:
            leaves.append((a, b, forced))
            continue
        cut, by_force = _cut(at, strength, a, b), False
        if cut is None and b - a > limit:
            end = a + len(text[a:b].rstrip())  # a stretch that fits but for the white space after it
            by_force = not a < end < b
            cut = (a + b) // 2 if by_force else end
        if cut is None:
            leaves.append((a, b, forced))
        else:
            todo += [(cut, b, by_force), (a, cut, forced)]
    pieces = []
    for n, (a, b, forced) in enumerate(leaves):
        back = min(overlap, limit - (b - a), a - leaves[n - 1][0]) if n else 0
        pieces.append((_overlap_start(at, strength, a - back, a), a, b, forced))
    return pieces


def _overlap_start(at: list[int], strength: list[int], lo: int, a: int) -> int:
    """Where the overlap before `a` begins: the earliest end of a sentence from `lo` on, else the earliest word."""
    first, last = bisect_left(at, lo), bisect_left(at, a)
    for i in range(first, last):
        if strength[i] >= SENTENCE:
            return at[i]
    return at[first] if first < last else lo


def split(df: DataFrame, key: str, text: str, limit: int = 3000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """`key`, piece_no, body_start, piece_start, piece_end, forced[, piece] of the texts longer than `limit`.

    piece is the text from piece_start (with overlap) to piece_end; body_start is where its own part begins. Null and
    short texts give no rows; repeated rows repeat; null keys stay; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out, texts = [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                pieces = split_text(value, limit, overlap)
                rows += [row] * len(pieces)
                out += [(n, *p) for n, p in enumerate(pieces)]
                if with_text:
                    texts += [value[p[0] : p[2]] for p in pieces]
            number, start, body, end, forced = map(list, zip(*out)) if out else ([], [], [], [], [])
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int32()) for x in (number, body, start, end)), pa.array(forced, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=names)

    names = ["key", "piece_no", "body_start", "piece_start", "piece_end", "forced"] + ["piece"] * with_text
    kept = df.where(F.length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kept.schema['key'].dataType.simpleString()}, piece_no int, body_start int, piece_start int, piece_end int, forced boolean" + ", piece string" * with_text
    return map_batches(kept, run, schema).withColumnRenamed("key", key)
