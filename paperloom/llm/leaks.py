"""Held-out items in a corpus, by winnowed fingerprints of word k-grams and extension of the hits.

A span counts when at least `least` consecutive words of an item, from one that is there to one that is there, stand in
a text in order and at most one word in `per_edit` of them is changed, added or left out. With 25 words and one in eight, some run of `run` = 6 words is
untouched (22 words kept in 4 runs, 28 in 5, and so on), so fingerprints that are the minimum of every window of
w = run - k + 1 k-grams meet on both sides for every such span, and all alignments around a hit are looked at: no span
is missed.

The held-out side is small in practice. Its size is measured first: up to `broadcast_chars` characters its index is
broadcast and looked up where the corpus is read, so nothing of the corpus is shuffled; beyond, fingerprints of both
sides are joined by a shuffle and the pairs are extended after a join with the texts. Both ways give the same rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import map_batches

BROADCAST_CHARS = 20_000_000
#: Distinct raw words whose hashes a worker remembers before it starts anew; memory only.
REMEMBERED = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)

_tag = re.compile(r"<[/!]?[A-Za-z][^<>]{0,300}>")
_link = re.compile(r"\]\([^()\s]*\)")
_broken = re.compile(r"(?<=[^\W\d_])[-­]\r?\n[ \t>]*(?=[^\W\d_])")


def plain_word(raw: str) -> str:
    """A word without case, accents, punctuation and markup; empty if nothing is left."""
    if raw.isascii():
        return "".join(c for c in raw.lower() if c.isalnum())
    return "".join(c for c in unicodedata.normalize("NFKD", raw.casefold()) if c.isalnum())


class _Hashes(dict):
    """Raw word to the 63-bit hash of its plain form, 0 where nothing is left of it."""

    def __missing__(self, raw: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        word = plain_word(raw)
        value = self[raw] = (xxhash.xxh64_intdigest(word) >> 1 or 1) if word else 0
        return value


def _words(text: str) -> list[str]:
    if "<" in text:
        text = _tag.sub(" ", text)
    if "](" in text:
        text = _link.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-\n" in text or "-\r" in text or "­" in text:
        text = _broken.sub("", text)
    if "—" in text or "–" in text:
        text = text.replace("—", " ").replace("–", " ")
    return text.split()


def word_hashes(text: str | None, known: dict[str, int]) -> np.ndarray:
    """The hashes of a text's words in order."""
    if not text:
        return np.empty(0, np.int64)
    values = np.fromiter(map(known.__getitem__, _words(text)), np.int64)
    return values[values != 0]


def winnow(words: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are the (last) minimum of some window of w k-grams.

    A sequence of fewer than w k-grams keeps its minimum, one of fewer than k words nothing.
    """
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * _BASE + words[j : j + n].astype(np.uint64)
    grams ^= grams >> np.uint64(29)
    w = min(w, n)
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)
    at = np.unique(np.arange(n - w + 1) + (w - 1 - windows[:, ::-1].argmin(1)))
    return at, grams[at]


_FAR = 1 << 40
_DEAD = 1 << 30
#: Diagonals and item words that are aligned at a time; a bound on memory, results don't depend on it.
_WIDEST = 1000


def _holds(same: np.ndarray, least: int, per_edit: int) -> bool:
    """Whether some stretch of aligned words has `least` words and one edit in `per_edit` at most.

    It begins and ends with the same word: what is missing beyond its ends doesn't make it longer.
    """
    if len(same) < least:
        return False
    score = np.concatenate(([0], np.cumsum(np.where(same, 1, 1 - per_edit))))
    low = np.minimum.accumulate(np.where(same, score[:-1], _FAR))
    return bool((same[least - 1 :] & (low[: len(same) - least + 1] <= score[least:])).any())


def _spans(item: np.ndarray, text: np.ndarray, first: int, width: int, least: int, per_edit: int, most: int) -> bool:
    """Whether item words stand in the text in order, `least` at least and with one edit in `per_edit` at most, from a
    word that is there to one that is there. Exact for the alignments of `most` edits at most on the `width` diagonals
    from `first` on.

    Diagonal d pairs item[i] with text[i + first + d]. For each number of edits, words[i, d] is the largest number of
    item words that an alignment ending there can have; with the edits given, more words are never worse.
    """
    m = len(item)
    at = np.arange(m)[:, None] + (first + np.arange(width))
    inside = (at >= 0) & (at < len(text))
    same = inside & (text[np.clip(at, 0, len(text) - 1)] == item[:, None])
    row = np.arange(m)[:, None]
    # within a run of equal words on a diagonal the words grow by one a row; runs are kept apart by their number
    run = np.cumsum(~same, axis=0, dtype=np.int64) * (4 * _DEAD) - row
    words = np.where(same, 1, -_DEAD).astype(np.int64)
    for edits in range(most + 1):
        if edits:
            before, words = words, np.full_like(words, -_DEAD)
            words[1:] = before[:-1] + 1  # a changed word
            np.maximum(words[1:, :-1], before[:-1, 1:] + 1, out=words[1:, :-1])  # a word left out
            np.maximum(words[:, 1:], before[:, :-1], out=words[:, 1:])  # a word added
        words = np.maximum.accumulate(words + run, axis=0) - run
        if (same & (words >= max(least, edits * per_edit))).any():
            return True
    return False


def shares_span(item: np.ndarray, text: np.ndarray, hits: list[tuple[int, int]], least: int, per_edit: int) -> bool:
    """Whether a text holds a span of the item; hits are (position in the text, position in the item).

    Where there is a span, there is one of fewer than 2 * least * per_edit / (per_edit - 1) words: a longer one falls
    into two of `least` words or more, cut after a word that is there, and one of them has few enough edits. So all
    alignments of that many edits around a hit are looked at, and nothing farther away.
    """
    m = len(item)
    if m < least:
        return False
    longest = (2 * least * per_edit - 1) // (per_edit - 1)
    most = longest // per_edit
    groups: list[list[tuple[int, int]]] = []
    for shift, at in sorted({(a - b, b) for a, b in hits}):
        if groups and shift - groups[-1][-1][0] <= 2 * most and shift - groups[-1][0][0] < _WIDEST:
            groups[-1].append((shift, at))
        else:
            groups.append([(shift, at)])
    for group in groups:
        first, last = group[0][0] - most, group[-1][0] + most
        lo, hi = max(0, min(at for _, at in group) - longest), min(m, max(at for _, at in group) + longest)
        for begin in range(lo, max(lo + 1, hi - longest), _WIDEST):  # spans of `longest` words lie within one part
            end = min(hi, begin + _WIDEST + longest)
            part = item[begin:end]
            near = text[max(0, begin + first) : max(0, end + last)]
            if not len(near) or not _holds(np.isin(part, near), least, per_edit):
                continue  # too many of the item's words aren't there at all
            if _spans(part, text, begin + first, last - first + 1, least, per_edit, most):
                return True
    return False


class Index:
    """The items' words and their winnowed fingerprints, sorted for look-up."""

    def __init__(self, items: list[tuple[int, str | None]], k: int, w: int):
        known = _Hashes()
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(text, known) for _, text in items]
        found = [winnow(words, k, w) for words in self.words]
        grams = np.concatenate([g for _, g in found] or [np.empty(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        self.grams = grams[order]
        self.item = np.repeat(np.arange(len(found)), [len(a) for a, _ in found])[order]
        self.at = np.concatenate([a for a, _ in found] or [np.empty(0, np.int64)])[order]
        self.distinct = np.unique(self.grams)

    def hits(self, at: np.ndarray, grams: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item number to its hits, for the fingerprints of one text."""
        out: dict[int, list[tuple[int, int]]] = {}
        if not len(self.distinct):
            return out
        here = self.distinct[np.minimum(np.searchsorted(self.distinct, grams), len(self.distinct) - 1)] == grams
        for position, gram in zip(at[here].tolist(), grams[here]):
            lo, hi = np.searchsorted(self.grams, gram, "left"), np.searchsorted(self.grams, gram, "right")
            for x in range(lo, hi):
                out.setdefault(int(self.item[x]), []).append((position, int(self.at[x])))
        return out


def _by_broadcast(docs: DataFrame, items: list[tuple[int, str]], k: int, w: int, least: int, per_edit: int, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = Index(shared.value, k, w), _Hashes()
        for batch in batches:
            doc, item = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = word_hashes(text, known)
                for number, hits in index.hits(*winnow(words, k, w)).items():
                    if shares_span(index.words[number], words, hits, least, per_edit):
                        doc.append(row)
                        item.append(index.ids[number])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(item, pa.int64())], names=["doc_id", "item_id"])

    return map_batches(docs, run, schema)


def _fingerprints(df: DataFrame, key: str, text: str, k: int, w: int, out: str) -> DataFrame:
    """`out` (the key), gram: the distinct winnowed fingerprints of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            found = [np.unique(winnow(word_hashes(t, known), k, w)[1]) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(g) for g in found])
            grams = np.concatenate(found or [np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(grams)], names=[out, "gram"])

    kept = df.select(F.col(key).alias(out), text)
    return map_batches(kept, run, f"{out} {kept.schema[out].dataType.simpleString()}, gram long")


def _by_shuffle(docs: DataFrame, items: DataFrame, k: int, w: int, least: int, per_edit: int, schema: str) -> DataFrame:
    """The same rows where the items are too many to broadcast. Fingerprints only say which texts and items meet, so
    however often one of them stands in a text it is one row; where it stands is looked up again once the two are side
    by side. Fingerprints of many items are not dropped."""
    a = _fingerprints(docs, "doc_id", "text", k, w, "doc_id")
    b = _fingerprints(items, "item_id", "item_text", k, w, "item_id")
    pairs = a.join(b, "gram").select("doc_id", "item_id").distinct()
    full = pairs.join(items.select("item_id", "item_text"), "item_id").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "item_id", "item_text", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of, words, found = _Hashes(), None, None, None
        for batch in batches:
            kept = []
            for ident, item, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "item_text", "text"))):
                if text is not of:  # a text's pairs mostly follow each other
                    if text != of:
                        words = word_hashes(text, known)
                        found = winnow(words, k, w)
                    of = text
                index = Index([(ident, item)], k, w)
                kept.append(shares_span(index.words[0], words, index.hits(*found).get(0, []), least, per_edit))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id")], names=["doc_id", "item_id"]).filter(pa.array(kept, pa.bool_()))

    return map_batches(full, run, schema)


def find(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text",
    least: int = 25, per_edit: int = 8, k: int = 5, run: int = 6, broadcast_chars: int = BROADCAST_CHARS,
) -> DataFrame:
    """doc_id, item_id of every text that holds a span of an item, each pair once.

    Null and empty texts and items hold nothing; items of fewer than `least` words are never found; repeated rows and
    several spans of an item in a text give one row; other columns are not read. `run` is the length of the untouched
    run that the definition guarantees (see the module); k must not exceed it.
    """
    if not 1 <= k <= run:
        raise ValueError("k must be between 1 and run")
    w = run - k + 1
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.length("text") > 0)
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).where(F.length("item_text") > 0)
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, item_id long"
    chars = tests.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    if chars <= broadcast_chars:
        rows = [(r.item_id, r.item_text) for r in tests.collect()]  # bounded: just measured
        found = _by_broadcast(kept, rows, k, w, least, per_edit, schema)
    else:
        found = _by_shuffle(kept, tests, k, w, least, per_edit, schema)
    return found.distinct()
