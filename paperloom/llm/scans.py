"""Texts read from scanned pages: page furniture removed, divided words joined, misread words corrected.

1. A linear conditional model labels the lines of a text as body, header, page number or break by layout features
   (repetition at page distance, place next to a page break, indentation, whether the line continues a wrapped
   paragraph, number patterns that count up); the best label sequence is found by dynamic programming.
2. Body lines are reassembled into paragraphs across the furniture. Line ends with a hyphen give candidates for
   divided words, unknown words candidates for misread ones.
3. The words of all texts are counted in Spark, apart for texts with and without traces of a scan. Candidates are
   deduplicated, their possible readings (with and without hyphen; confused characters undone) are joined with the
   counts, and the best reading is joined back to the rows.

No text is collected or shuffled: what leaves a partition are furniture lines, candidates and pre-aggregated counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.languages import ANY
from paperloom.session import cut, map_batches, spread

BODY, HEADER, NUMBER, BREAK = range(4)
#: Repaired words up to this number are broadcast to the texts, more are joined by a shuffle; the rows are the same.
BROADCAST_WORDS = 200_000
#: Distinct words a task counts before it passes its counts on.
COUNTED = 300_000
#: A reading must occur this often in texts without traces of a scan, and a misread form at most this share as often.
SUPPORT, RARE = 2, 0.05
#: In texts with such traces a misread form must not come more often than this share of the word, beyond 3 times.
SHARE = 0.2

#: Likeness of two headers of different length.
ALIKE = 0.86

_HYPHENS = "-¬\xad‐"
_lines = re.compile(r"\r?\n|\f")
_divided = re.compile(rf"([^\W\d_][\w'’]*(?:[-‐][\w'’]+)*)[{_HYPHENS}][ \t]*$")
_any_divided = re.compile(rf"[^\W\d_][{_HYPHENS}][ \t]*\r?(?:\n|\f)")
_first_word = re.compile(r"\s*([^\W\d_][\w'’]*(?:-[\w'’]+)*)")
_page_word = r"(?:page|seite|página|pagina|pág\.|pag\.|p\.|s\.|blatt|feuille|hoja|sheet)"
_N = r"[\dlIOoSsBg|]{1,9}"
_numbers = [
    ("word", re.compile(rf"^[^\w.,;]{{0,2}}{_page_word}\s*({_N})(?:\s*(?:of|von|de|sur|/|out of|of a total of)\s*({_N}))?[^\w.,;]{{0,2}}$", re.I)),
    ("dashes", re.compile(rf"^([-–—~*·])\s*({_N})\s*\1$")),
    ("brackets", re.compile(rf"^[\[(<{{]\s*({_N})\s*[\])>}}]$")),
    ("fraction", re.compile(r"^(\d{1,9})\s*/\s*(\d{1,9})$")),
    ("bare", re.compile(r"^(\d{1,9})$")),
]
_any_number = re.compile(rf"(?im)^[ \t]*(?:\W{{0,2}}{_page_word}\s*{_N}(?:\s+\w+\s+{_N})?|([-–—])\s*\d{{1,4}}\s*\1|\[\d{{1,3}}\]|\d{{1,3}}/\d{{1,3}})[ \t]*$")
_long_line = re.compile(r"(?m)^(?=[^\n]{111})[^\s]{0,60}[ \t]")  # beyond any page's width, and no unbroken string
_wrapped = re.compile(r"[^\W_]\r?\n[ \t]*[a-zß-öø-ÿ]{2}")
_COMPANY_END = re.compile(r"\b(?:Inc|Co|Corp|Ltd|S\.A|S\.L|S\.p\.A|B\.V|N\.V|e\.V|Bros)\.$")
_continued = re.compile(r"(?i),?\s*\(?(?:continued|cont['’.]?d?\.?|fortsetzung|fortgesetzt|suite|continuación|continuation)\)?$")
_item = re.compile(r"\d\s*[x×*]\s*[$€£A-Z]{0,3}\s?\d|[$€£]\s?\d|\d[.,]\d\d\b|:\s|@")
_read_as = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "g": "9"})
_word = re.compile(r"^[^\w]*((?:[^\W_]|[|!$€@])+(?:['’\-][^\W_]+)*)[^\w]*$")

# How characters are misread (what is read, what it may be), for words that are unknown as they stand.
CONFUSED = {
    "0": "oO", "1": "liIt", "2": "zZ", "3": "eE", "4": "aA", "5": "sS", "6": "bG", "7": "tT", "8": "B", "9": "gqol", "|": "lI", "!": "li", "$": "sS", "€": "eE", "@": "a",
    "c": "eo", "e": "co", "f": "t", "t": "fl", "l": "it", "i": "lj", "b": "h", "h": "b", "o": "c", "a": "o", "u": "n", "n": "u", "v": "y", "y": "v", "g": "q", "q": "g", "I": "l", "B": "ß", "S": "5",
    "á": "a", "à": "a", "â": "a", "ä": "a", "é": "e", "è": "e", "ê": "e", "í": "i", "ì": "i", "ó": "o", "ò": "o", "ö": "o", "ú": "u", "ù": "u", "ü": "u", "ñ": "n", "ç": "c",
}
CONFUSED_PAIRS = {"ri": "n", "rn": "m", "cl": "d", "ci": "d", "ii": "u", "vv": "w", "li": "h", "nn": "m", "iu": "m", "in": "m", "fi": "h", "lc": "k", "lo": "b", "ol": "d", "ij": "y"}
CONFUSED_SINGLE_TO_PAIR = {"m": ("rn", "nn"), "d": ("cl",), "n": ("ri",), "w": ("vv",), "h": ("li",), "u": ("ii",)}
_UNDIVIDED = frozenset("and or und oder et ou y o e bis to sowie noch aber".split())


def page_number(line: str) -> tuple[str, int] | None:
    """The style and value of a line that may hold only a page's number; misread digits are read as digits."""
    for style, pattern in _numbers:
        m = pattern.match(line)
        if m:
            value = (m[2] if style == "dashes" else m[1]).translate(_read_as)
            if value.isdigit():
                running = style == "word" and line[:1].islower() and not line.lower().startswith(("p.", "s.", "pág", "pag.")) and m[2] is None
            return "bare" if running else style, int(value)  # "page 48" may be the end of a sentence
    return None


def _counting(found: list[tuple[int, str, int]]) -> dict[int, int]:
    """Line numbers of bare numbers and fractions that count the pages (1, 2, 3, ... or on from some number), with how
    many do: the longest chain whose numbers grow by one from line to line, not next to each other."""
    kept: dict[int, int] = {}
    for style in ("bare", "fraction"):
        own = [(at, v) for at, s, v in found if s == style]
        best: dict[int, list[tuple[int, int]]] = {}  # last value to its chains: (length, index of the last line), the latest two
        before: list[int | None] = []
        lengths: list[int] = []
        for n, (at, v) in enumerate(own):
            length, last = max(((x, i) for x, i in best.get(v - 1, ()) if at - own[i][0] >= 2), key=lambda c: (c[0], -c[1]), default=(0, None))
            before.append(last)
            lengths.append(length + 1)
            best[v] = sorted([*best.get(v, ()), (length + 1, n)], key=lambda c: (-c[0], c[1]))[:2]
        ends = [(lengths[n], -n) for n in range(len(own)) if lengths[n] >= 2 or own[n][1] == 1]
        if ends:
            length, n = max(ends)
            at: int | None = -n
            while at is not None:
                kept[own[at][0]] = length
                at = before[at]
    return kept


def _end(n: int) -> int:
    """The power of two within half of a length: so much of two headers of different length must be equal at one end."""
    return 1 << max(1, (n // 2).bit_length() - 1)


def _apart(a: int, b: int) -> bool:
    return abs(a - b) > min(9, 3 + min(a, b) // 20)


def _same(a: str, b: str) -> bool:
    """Whether two lines are one header: alike but for a few misread characters and the page's number."""
    if a == b:
        return True
    if _apart(len(a), len(b)):
        return False
    if len(a) == len(b):
        wrong = sum(x != y for x, y in zip(a, b))
        if wrong <= max(2, len(a) // 8) and not (_digits_moved(a, b) and _item.search(a)):
            return len("".join(re.findall(r"\d+", a))) < 0.5 * len(a) or wrong <= 2
    n = _end(min(len(a), len(b)))
    if a[:n] != b[:n] and a[-n:] != b[-n:] or _item.search(a):
        return False
    shared = sum(min(a.count(c), b.count(c)) for c in set(a))  # no alignment matches more
    return 2 * shared >= ALIKE * (len(a) + len(b)) and SequenceMatcher(None, a, b, autojunk=False).ratio() >= ALIKE


def _likeness(text: str) -> set[tuple]:
    """Keys of which two lines that are `_same` share one: the beginning or end or, where they are equally long and n
    characters at most are wrong, one of n + 1 parts."""
    n = len(text)
    parts = max(2, n // 8) + 1
    cuts = [c * n // parts for c in range(parts + 1)]
    ends = {_end(m) for m in range(max(1, n - 9), n + 1)}
    return {(0, x, text[:x]) for x in ends} | {(-1, x, text[-x:]) for x in ends} | {(n, a, text[a:b]) for a, b in zip(cuts, cuts[1:])}


def _digits_moved(a: str, b: str) -> bool:
    return re.findall(r"\d+", a) != re.findall(r"\d+", b)


#: Weights of the line model: what speaks for a header and for a page number, against body text at 0. They are
#: stated for pages of business documents; `fit_weights` goes on from them, or from nothing, with labelled pages.
HEADER_WEIGHTS = {"bias": -3.0, "repeated": 5.0, "top": 1.2, "first": 0.5, "continued": 3.5, "indented": 1.3, "wrapped": -1.2, "sentence": -2.5, "lower": -3.5, "item": -2.5, "long": -1.5, "prose": -4.5}
NUMBER_WEIGHTS = {"decorated": 4.0, "counting": 3.5, "bare": -2.5, "labelled": -5.0}
#: The score of a line that has no number as a page number.
NEVER = -9.0
#: Transition scores between labels of neighbouring lines that are not blank.
TRANSITIONS = {(HEADER, HEADER): -1.5, (NUMBER, HEADER): 0.8, (HEADER, NUMBER): 0.8, (NUMBER, NUMBER): -4.0}


Weights = tuple[dict[str, float], dict[str, float], dict[tuple[int, int], float]]


def line_features(lines: list[str], fed: set[int]) -> tuple[list[int], list[dict[str, float]], list[dict[str, float]]]:
    """The numbers of the lines that are not blank, and of each what speaks for a header and for a page number (a single
    entry "none" where it can't be one). fed: numbers of lines that begin after a form feed."""
    stripped = [x.strip() for x in lines]
    full = [i for i, x in enumerate(stripped) if x]
    if not full:
        return [], [], []
    numbers = [(i, *p) for i in full if (p := page_number(stripped[i]))]
    of = {i: (s, v) for i, s, v in numbers}
    counting = _counting(numbers)
    position = {i: k for k, i in enumerate(full)}
    certain = {i for i, s, _ in numbers if s not in ("bare", "fraction")} | set(counting)
    width = sorted(len(lines[i].rstrip()) for i in full)[int(0.9 * (len(full) - 1))]
    body_indent = sorted(len(lines[i]) - len(lines[i].lstrip()) for i in full)[len(full) // 2]
    repeated = _repeated(lines, stripped, full, position, {i for i in full if i in of}, fed, certain, width)
    heads, nums = [], []
    for k, i in enumerate(full):
        text = stripped[i]
        before = full[k - 1] if k else None
        top = k == 0 or i in fed or before in certain or (k > 1 and full[k - 2] in certain and i - full[k - 2] <= 3)
        bottom = k + 1 == len(full) or full[k + 1] in certain or full[k + 1] in fed
        words = text.split()
        h = {
            "bias": 1, "repeated": i in repeated, "top": top or bottom, "first": k == 0, "continued": _continued.search(text) is not None and len(text) < 60,
            "indented": len(lines[i]) - len(lines[i].lstrip()) >= body_indent + 3, "sentence": text.endswith((".", "!", "?", ";")) and i not in repeated,
            "lower": text[0].islower(), "long": len(text) > width + 25, "wrapped": not top and _goes_on(lines, full, k, width), "item": _item.search(text) is not None,
        }
        h["prose"] = len(words) >= 5 and (h["repeated"] or top or bottom or h["continued"]) and (sum(w[:1].islower() for w in words) >= 0.5 * len(words) or sum(w.lower() in ANY for w in words) >= 2)
        heads.append({name: float(x) for name, x in h.items() if x})
        if i in of:
            loose = of[i][0] in ("bare", "fraction")
            labelled = before is not None and of[i][0] == "bare" and counting.get(i, 0) < 2 and i - before == 1 and before not in certain and len(stripped[before].split()) <= 3 and not stripped[before].endswith((".", ",")) and (k == 1 or before - full[k - 2] > 1)
            p = {"decorated": not loose, "counting": loose and i in counting, "bare": loose and i not in counting, "labelled": labelled}
            nums.append({name: float(x) for name, x in p.items() if x})
        else:
            nums.append({"none": 1.0})
    return full, heads, nums


def best_labels(heads: list[dict[str, float]], nums: list[dict[str, float]], weights: Weights) -> list[int]:
    """The best sequence of labels (BODY, HEADER, NUMBER) of the lines, by dynamic programming."""
    header, number, steps = weights
    scores = [(0.0, sum(header[f] * x for f, x in h.items()), sum(number.get(f, NEVER) * x for f, x in p.items())) for h, p in zip(heads, nums)]
    if not scores:
        return []
    best, back = list(scores[0]), []
    for s in scores[1:]:
        step, arg = [], []
        for state in (BODY, HEADER, NUMBER):
            options = [best[b] + steps.get((b, state), 0.0) for b in (BODY, HEADER, NUMBER)]
            b = max(range(3), key=options.__getitem__)
            step.append(options[b] + s[state])
            arg.append(b)
        best = step
        back.append(arg)
    out = [max(range(3), key=best.__getitem__)]
    for arg in reversed(back):
        out.append(arg[out[-1]])
    return out[::-1]


def label_lines(lines: list[str], fed: set[int], weights: Weights | None = None) -> list[int]:
    """The label of every line; blank lines are breaks."""
    full, heads, nums = line_features(lines, fed)
    labels = [BREAK] * len(lines)
    for i, label in zip(full, best_labels(heads, nums, weights or (HEADER_WEIGHTS, NUMBER_WEIGHTS, TRANSITIONS))):
        labels[i] = label
    return labels


def fit_weights(pages: list[tuple[list[str], list[int]]], start: Weights | None = None, rounds: int = 10, rate: float = 0.2) -> Weights:
    """Weights of the line model from labelled texts (lines, labels), by the averaged structured perceptron: where the
    best sequence is wrong, what is seen on the right one gains and what is seen on the wrong one loses."""
    start = start or (HEADER_WEIGHTS, NUMBER_WEIGHTS, TRANSITIONS)
    now = tuple(dict(w) for w in start)
    total, seen = tuple(dict.fromkeys(w, 0.0) for w in start), 0
    prepared = [(*line_features(lines, set())[1:], [x for x, line in zip(labels, lines) if line.strip()]) for lines, labels in pages]
    for _ in range(rounds):
        for heads, nums, right in prepared:
            got = best_labels(heads, nums, now)
            if got != right:
                for labels, sign in ((right, rate), (got, -rate)):
                    for k, label in enumerate(labels):
                        features, own = (heads[k], now[0]) if label == HEADER else (nums[k], now[1]) if label == NUMBER else ({}, {})
                        for f, x in features.items():
                            if f in own:
                                own[f] += sign * x
                        if k and (step := (labels[k - 1], label)) in now[2]:
                            now[2][step] += sign
            seen += 1
            for t, w in zip(total, now):
                for f, x in w.items():
                    t[f] += x
    return tuple({f: round(x / seen, 2) for f, x in t.items()} for t in total)


def _repeated(lines: list[str], stripped: list[str], full: list[int], position: dict[int, int], numbers: set[int], fed: set[int], certain: set[int], width: int) -> set[int]:
    """Lines that come again at page distance: the same, the same but for a number that grows, or nearly the same."""
    out: set[int] = set()
    maybe = [
        i for i in full
        if i not in numbers and len(stripped[i]) > 1 and not stripped[i][0].islower() and not (stripped[i].endswith((".", ";")) and not _COMPANY_END.search(stripped[i]))
    ]
    buckets: dict[str, list[int]] = {}
    for i in maybe:
        buckets.setdefault(stripped[i] if _item.search(stripped[i]) else re.sub(r"\d+", "#", stripped[i]), []).append(i)
    for group in buckets.values():
        if len(group) < 2 or max(position[group[-1]] - position[group[0]], 0) < 5:
            continue
        digits = [re.findall(r"\d+", stripped[i]) for i in group]
        steady = all(len(set(column)) == 1 or all(int(x) < int(y) <= int(x) + 9 for x, y in zip(column, column[1:])) for column in zip(*digits))
        if steady and all(position[y] - position[x] >= 5 for x, y in zip(group, group[1:])):
            out.update(group)
    heads: dict[tuple, list[int]] = {}
    for text, i in {stripped[i]: i for i in sorted(out)}.items():
        for key in _likeness(text):
            heads.setdefault(key, []).append(i)
    for i in maybe if heads else ():
        near = {h for key in _likeness(stripped[i]) for h in heads.get(key, ())} if i not in out else ()
        if any(abs(position[i] - position[h]) >= 5 and _same(stripped[i], stripped[h]) for h in near):
            out.add(i)
    loose = [i for i in maybe if i not in out and (len(lines[i]) - len(stripped[i]) >= 3 or i in fed or i - 1 in certain or not position[i] or not _goes_on(lines, full, position[i], width))]
    waiting: dict[tuple, list[int]] = {}
    for i in loose:
        keys = _likeness(stripped[i])
        for j in sorted({j for key in keys for j in waiting.get(key, ())}):
            if abs(position[i] - position[j]) >= 5 and _same(stripped[j], stripped[i]):
                out.update((i, j))
        for key in keys:
            waiting.setdefault(key, []).append(i)
    return out


def _goes_on(lines: list[str], full: list[int], k: int, width: int) -> bool:
    """Whether a line is part of a wrapped paragraph: the next line's first word would not have fitted."""
    i = full[k]
    if k + 1 == len(full) or full[k + 1] != i + 1:
        return False
    own = len(lines[i].rstrip())
    return own <= width + 8 and own + 1 + len(lines[i + 1].split(None, 1)[0]) > width - 4


class Page:
    """A text's labelled lines and what can be said of them without knowing other texts."""

    def __init__(self, text: str):
        self.lines, self.fed = [], set()
        for part in re.split(r"(\f)", text):
            if part == "\f":
                self.fed.add(len(self.lines))
            else:
                self.lines += re.split(r"\r?\n", part)
        self.labels = label_lines(self.lines, self.fed)
        self.body = [i for i, label in enumerate(self.labels) if label == BODY]
        self._divided: list[tuple[int, int, str, str]] | None = None

    def furniture(self) -> list[tuple[str, str]]:
        kinds = {HEADER: "running_header", NUMBER: "page_number"}
        return [(kinds[label], line.strip()) for line, label in zip(self.lines, self.labels) if label in kinds]

    def divided(self) -> list[tuple[int, int, str, str]]:
        """(line, next line, left part, right part) of words that may be divided between two body lines."""
        if self._divided is not None:
            return self._divided
        out = self._divided = []
        goes_on: tuple[int, str] | None = None  # the next body line that begins in lower case, with its first word
        for k in range(len(self.body) - 1, -1, -1):
            i, nxt = self.body[k], self.body[k + 1] if k + 1 < len(self.body) else None
            if nxt is not None:
                right = _first_word.match(self.lines[nxt])
                if right and right[1][0].islower():
                    goes_on = (nxt, right[1])
                if self.lines[i].rstrip()[-1:] in _HYPHENS and (m := _divided.search(self.lines[i])):
                    if right and (right[1][0].islower() or m[1][0].isupper()):
                        out.append((i, nxt, m[1], right[1]))
                    elif goes_on:  # past a box or an unknown header in between
                        out.append((i, goes_on[0], m[1], goes_on[1]))
        out.reverse()
        return out

    def tokens(self) -> Iterator[str]:
        """White-space tokens of body lines but for the parts of divided words."""
        skip_last = {i for i, *_ in self.divided()}
        skip_first = {j for _, j, *_ in self.divided()}
        for i in self.body:
            words = self.lines[i].split()
            yield from words[i in skip_first : len(words) - (i in skip_last)]


def is_scanned(text: str) -> bool:
    """Whether a text has traces of pages: form feeds, divided words, page numbers, or lines wrapped at a width."""
    if "\f" in text or _any_divided.search(text) or _any_number.search(text):
        return True
    return _wrapped.search(text) is not None and _long_line.search(text) is None


def core(token: str) -> str | None:
    """A token's word without surrounding punctuation; None for codes, addresses and numbers."""
    m = _word.match(token)
    if not m:
        return None
    word = m[1].strip("!$€@|") if not any(c.isalpha() for c in m[1][1:-1]) else m[1]
    letters = sum(map(str.isalpha, word))
    if letters < 2 or 2 * letters < len(word) or sum(map(str.isdigit, word)) > 2:
        return None
    return word


def once(w: str) -> set[str]:
    """What a misread word may be, with one confusion undone, in its neighbours' letter case."""
    out = set()
    for i, c in enumerate(w):
        low = c if not c.isalpha() or c.islower() or c in CONFUSED else c.lower()
        for r in CONFUSED.get(c, CONFUSED.get(low, "")):
            upper = c.isupper() or not c.isalpha() and (w[:i] + w[i + 1 :]).isupper()
            out.add(w[:i] + (r.upper() if upper else r.lower() if r not in "ßIO" or i else r) + w[i + 1 :])
        for r in CONFUSED_SINGLE_TO_PAIR.get(c, ()):
            out.add(w[:i] + r + w[i + 1 :])
        pair = w[i : i + 2]
        if pair in CONFUSED_PAIRS:
            out.add(w[:i] + CONFUSED_PAIRS[pair] + w[i + 2 :])
    return out - {w}


def twice(w: str) -> set[str]:
    """What a word may be with two confusions undone."""
    first = once(w)
    return {y for x in first for y in once(x)} - first - {w}


def _observe(df: DataFrame, key: str, text: str, table_name: str) -> DataFrame:
    """kind, table_name, row_key, a, b, n, words: furniture, divided words, the distinct body words of each scanned text
    ("words"), and counts of words by task ("clean", "scanned")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {"clean": Counter(), "scanned": Counter()}
        of = lru_cache(COUNTED)(core)

        def words_out() -> pa.RecordBatch:
            rows = []
            for kind, raw in counts.items():
                merged: Counter[str] = Counter()
                for token, n in raw.items():
                    if (word := of(token)) is not None:
                        merged[word.lower()] += n
                rows += [(kind, None, None, word, None, n) for word, n in merged.items()]
                raw.clear()
            return _batch(rows)

        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not value:
                    continue
                if not is_scanned(value):
                    counts["clean"].update(value.split())
                    continue
                page = Page(value)
                rows += [(kind, table_name, k, line, None, 1) for kind, line in dict.fromkeys(page.furniture())]
                rows += [("divided", table_name, k, a, b, 1) for a, b in dict.fromkeys((a, b) for *_, a, b in page.divided())]
                own = Counter(page.tokens())
                counts["scanned"].update(own)
                words = {w for t in own if (w := of(t)) is not None}
                if words:
                    rows.append(("words", table_name, k, None, None, 1, sorted(words)))
            if rows:
                yield _batch(rows)
            if sum(map(len, counts.values())) > COUNTED:
                yield words_out()
        yield words_out()

    kept = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return map_batches(kept, run, _OBSERVED)


_OBSERVED = "kind string, table_name string, row_key string, a string, b string, n long, words array<string>"
_ARROW = pa.schema([(c, pa.string()) for c in ("kind", "table_name", "row_key", "a", "b")] + [("n", pa.int64()), ("words", pa.list_(pa.string()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*(r if len(r) == 7 else (*r, None) for r in rows))) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _forms(candidates: DataFrame, second: bool) -> DataFrame:
    """a, b, form, rank: the readings of each candidate; rank 0 is the word as it stands or joined, 1 with its hyphen,
    2 with one confusion undone, and 3 (instead of 2) with two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = a if b is None else a + b
                rows.append((a, b, whole, 0))
                if b is not None:
                    rows.append((a, b, f"{a}-{b}", 1))
                rows += [(a, b, form, 3 if second else 2) for form in sorted(twice(whole) if second else once(whole))]
                if len(rows) > 50_000:  # long words have many
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["a", "b", "form", "rank"])
                    rows = []
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["a", "b", "form", "rank"])

    return map_batches(spread(candidates), run, "a string, b string, form string, rank int")


def _counted(candidates: DataFrame, vocabulary: DataFrame, second: bool) -> DataFrame:
    """a, b, plain, hyphen, undone: each candidate with its forms that are known best."""
    forms = _forms(candidates, second).withColumn("word", F.lower("form"))
    counted = forms.join(vocabulary, "word", "left").na.fill(0, ["clean", "scanned"])
    return counted.groupBy("a", "b").agg(
        F.max(F.when(F.col("rank") == 0, F.struct("clean", "scanned", "form"))).alias("plain"),
        F.max(F.when(F.col("rank") == 1, F.struct("clean", "scanned", "form"))).alias("hyphen"),
        F.max(F.when((F.col("rank") >= 2) & (F.col("clean") >= SUPPORT), F.struct("clean", "scanned", "form"))).alias("undone"),
    )


def _rare(word: Column) -> Column:
    """The share of what it may be that a misread word reaches at most: words with odd characters more than others."""
    return F.when(word.rlike(r"[\d|!$€@]"), RARE).otherwise(RARE / 25)


def _decide(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """a, b, repaired of each candidate that is to be repaired; b is null for single words. Two confusions are only
    tried where no word is known with one."""
    first = cut(_counted(candidates, vocabulary, second=False))
    left = first.where(F.col("undone").isNull())
    # letters alone after a capital may be a name that nobody knows: of these only one confusion is undone
    name = F.col("b").isNull() & F.col("a").rlike(r"^\p{Lu}\p{L}*$")
    again = _counted(left.where((F.length("a") >= 5) & ~name & (F.col("plain.clean") == 0)).select("a", "b"), vocabulary, second=True)
    best = first.where(F.col("undone").isNotNull()).unionByName(left.join(again.select("a", F.col("b").alias("_b"), F.col("undone").alias("_two")), (left.a == again.a) & left.b.eqNullSafe(F.col("_b")), "left").select(left.a, "b", "plain", "hyphen", F.col("_two").alias("undone")))
    # a word as it stands is misread if texts without traces of a scan hardly know it but know what it may be
    misread = (F.col("plain.clean") <= F.col("undone.clean") * _rare(F.col("a"))) & (F.col("plain.scanned") <= F.greatest(F.lit(3), (F.col("undone.clean") + F.col("undone.scanned")) * SHARE))
    single = F.when(misread, F.col("undone.form"))
    total = lambda c: F.col(f"{c}.clean") * 3 + F.col(f"{c}.scanned")
    right = F.col("b")
    capital = F.substring(right, 1, 1) != F.lower(F.substring(right, 1, 1))
    divided = (
        F.when((total("hyphen") > total("plain")) | (capital & (total("plain") == 0)), F.col("hyphen.form"))
        .when(total("plain") > 0, F.col("plain.form"))
        .when(F.lower(right).isin(*_UNDIVIDED), None)
        .otherwise(F.coalesce("undone.form", "plain.form"))
    )
    return best.select("a", "b", F.when(right.isNull(), single).otherwise(divided).alias("repaired")).where(F.col("repaired").isNotNull())


def find(sources: list[tuple[DataFrame, str, str, str]], broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """table_name, row_key, kind, original, repaired of every trace of a page in several tables, each once.

    sources: (table, key column, text column, name). kind is running_header, page_number (original = repaired = the
    line, trimmed), hyphenated (original is both parts) or misread. All tables share one vocabulary. Null and empty
    texts have no traces; rows sent twice give the same rows; other columns are not read.
    """
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    seen = cut(together([_observe(*s) for s in sources]))
    counts = seen.where("kind in ('clean', 'scanned')").groupBy(F.col("a").alias("word"))
    vocabulary = cut(counts.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("clean", "scanned")]))
    most = vocabulary.agg(F.coalesce(F.max("clean"), F.lit(0))).first()[0]
    words = seen.where("kind = 'words'").select("table_name", "row_key", F.explode("words").alias("a"))
    # words so common that no word is common enough to be meant instead need no readings
    forms = words.select("a").distinct().withColumn("word", F.lower("a")).join(vocabulary, "word", "left")
    forms = forms.where(F.coalesce("clean", F.lit(0)) <= _rare(F.col("a")) * most)
    divided = seen.where("kind = 'divided'").select("table_name", "row_key", "a", "b").distinct()
    candidates = cut(forms.select("a", F.lit(None).cast("string").alias("b")).unionByName(divided.select("a", "b").distinct()))
    decided = cut(_decide(candidates, vocabulary))
    single = decided.where("b is null").select("a", "repaired")
    few = single.count() <= broadcast_words
    misread = words.join(F.broadcast(single) if few else single, "a").select("table_name", "row_key", F.lit("misread").alias("kind"), F.col("a").alias("original"), "repaired")
    hyphenated = divided.join(decided.where("b is not null"), ["a", "b"]).select("table_name", "row_key", F.lit("hyphenated").alias("kind"), F.concat_ws("-", "a", "b").alias("original"), "repaired")
    furniture = seen.where("kind in ('running_header', 'page_number')").select("table_name", "row_key", "kind", F.col("a").alias("original"), F.col("a").alias("repaired"))
    return together([furniture, misread, hyphenated]).distinct()


def repair_text(text: str, fixes: dict[str, str]) -> str:
    """A text as continuous paragraphs: furniture left out, divided words joined, misread ones replaced.

    fixes: original (both parts of a divided word with a hyphen between) to repaired. Texts without traces of pages
    come back as they are.
    """
    if not text or not is_scanned(text):
        return text
    page = Page(text)
    joins = {i: (j, a, b) for i, j, a, b in page.divided() if f"{a}-{b}" in fixes}
    starts = {j: b for j, _, b in joins.values()}
    width = sorted(len(page.lines[i]) for i in page.body)[int(0.9 * (len(page.body) - 1))] if page.body else 0
    paragraphs: list[str] = []
    current = ""
    for k, i in enumerate(page.body):
        line = page.lines[i].strip()
        if i in starts:
            line = line[len(starts[i]) :].lstrip() if not re.match(r"[^\w\s]", line[len(starts[i]) :]) else line[len(starts[i]) :]
        line = " ".join(_fixed(t, fixes) for t in line.split(" "))
        glue = " " if not (line and re.match(r"[^\w\s(\[\"'“„«$€£-]", line) and i in starts) else ""
        current = f"{current}{glue}{line}" if current and line else current or line
        if i in joins:
            j, a, b = joins[i]
            current = current[: current.rindex(a)] + fixes[f"{a}-{b}"]
            continue
        nxt = page.body[k + 1] if k + 1 < len(page.body) else None
        gap = nxt is not None and any(page.labels[x] == BREAK for x in range(i + 1, nxt)) and not any(page.labels[x] in (HEADER, NUMBER) for x in range(i + 1, nxt))
        short = nxt is not None and len(page.lines[i].rstrip()) + 1 + len(page.lines[nxt].split(None, 1)[0]) <= width - 4
        if nxt is None or gap or short:
            paragraphs.append(current)
            current = ""
    if current:
        paragraphs.append(current)
    return "\n\n".join(p for p in paragraphs if p)


def _fixed(token: str, fixes: dict[str, str]) -> str:
    word = core(token)
    return token.replace(word, fixes[word]) if word is not None and word in fixes else token


def repair(source: tuple[DataFrame, str, str, str], found: DataFrame, once: bool = False) -> DataFrame:
    """row_key, repaired of every row of a source, by what `find` found. A null text stays null; repeated rows repeat, or
    come once where `once` is set: they are dropped where the join has put them, so that no text is shuffled again."""
    df, key, text, name = source
    fixes = found.where((F.col("table_name") == name) & F.col("kind").isin("hyphenated", "misread"))
    fixes = fixes.groupBy("row_key", "original").agg(F.min("repaired").alias("repaired"))  # a map takes a key once
    own = fixes.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("original", "repaired"))).alias("fixes"))
    rows = df.select(F.col(key).cast("string").alias("row_key"), F.col(text).alias("text")).join(own, "row_key", "left")
    if once:
        rows = rows.dropDuplicates(["row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else repair_text(t, dict(f or ())) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row_key", "repaired"])

    return map_batches(rows, run, "row_key string, repaired string")
