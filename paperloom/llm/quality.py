"""Per-document text statistics, and whether a text is prose, a list, a table or junk.

The basic counts are expressions of the JVM. For the kind, every token has a class (function word of certain languages,
other word, number or code, implausible string, symbols) and every line a shape (running text, short entry, row of
columns). A text is compared with the prose profile of each language by Jensen-Shannon divergence: its function words
with the language's, its characters by class with the language's, and its mass by class and shape with the language's
prose. The nearest language is the one whose function words count; the nearest structural profile in that language gives
the kind, so a mixed text has the kind of its greater part. Passages said before are a class of their own, whatever
part of a text they are.

Each text is read once, whole, in its own partition (`mapInArrow`); nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm.languages import ANY, FUNCTION_WORDS, WORDS
from paperloom.session import map_batches

REMEMBERED = 500_000
LANGUAGES = tuple(WORDS)
#: Token classes: one for each set of languages that have a function word in common, then the others.
_SETS = 1 << len(LANGUAGES)
WORD, NUMBER, IMPLAUSIBLE, SYMBOL = range(_SETS, _SETS + 4)
CLASSES = ("function", "word", "number", "implausible", "symbol")
SHAPES = ("running", "entry", "row")
#: Share of characters in function words of prose, by language.
FUNCTION_SHARE = {"en": (0.22, 0.11), "de": (0.2, 0.1), "fr": (0.2, 0.1), "es": (0.22, 0.11)}
#: Structural profiles: kind, then shares of characters by (class, shape), where "function" means the language's own
#: function words; "repeated" stands for text said before. The two of prose are added for each language.
PROFILES = [
    ("list", {("function", "entry"): 0.15, ("word", "entry"): 0.7, ("number", "entry"): 0.15}),
    ("list", {("word", "entry"): 0.55, ("number", "entry"): 0.45}),
    ("table", {("word", "row"): 0.45, ("number", "row"): 0.5, ("symbol", "row"): 0.05}),
    ("table", {("function", "row"): 0.1, ("word", "row"): 0.8, ("number", "row"): 0.1}),
    ("table", {("number", "row"): 0.9, ("symbol", "row"): 0.1}),
    ("junk", {("implausible", "running"): 1.0}),
    ("junk", {("implausible", "entry"): 1.0}),
    ("junk", {("implausible", "row"): 1.0}),
    ("junk", {("symbol", "running"): 0.9, ("number", "running"): 0.1}),
    ("junk", {("symbol", "entry"): 0.9, ("number", "entry"): 0.1}),
    ("junk", {("word", "running"): 1.0}),  # words in no sentence: no function words at all
    ("junk", {("repeated", ""): 1.0}),
]
#: Prose of each language by class of characters: small letters, capitals, letters beyond ASCII, digits, white space,
#: punctuation, other signs.
CHARACTERS = {
    "en": (0.76, 0.035, 0.0005, 0.015, 0.16, 0.025, 0.0045),
    "de": (0.745, 0.06, 0.018, 0.015, 0.135, 0.024, 0.003),
    "fr": (0.735, 0.03, 0.035, 0.015, 0.155, 0.027, 0.003),
    "es": (0.745, 0.03, 0.024, 0.015, 0.158, 0.025, 0.003),
}
#: How much the three divergences say about the language: structure, function words, characters.
PARTS = (1.0, 1.0, 1.0)
#: So many word triples in a row that were all said twice before are a passage said over and over.
TRIPLES = 8

_INDEX = {w: i + 1 for i, w in enumerate(sorted(ANY))}  # 0 stands for every other token
_MASK = {w: sum(1 << i for i, lang in enumerate(LANGUAGES) if w in WORDS[lang]) for w in ANY}
_KINDS = _SETS + 4
_WIDTH = len(CLASSES) * len(SHAPES) + 1

_letters = re.compile(r"[^\W\d_]+")
_vowel = re.compile("[aeiouyàáâäãåæèéêëìíîïòóôöõøœùúûüýÿAEIOUYÀÁÂÄÃÅÆÈÉÊËÌÍÎÏÒÓÔÖÕØŒÙÚÛÜÝ]")
_case = re.compile(r"[a-zß-ÿ][A-ZÀ-Þ]|[A-ZÀ-Þ]{2}[a-zß-ÿ]{1}|\d[a-zA-Z]|[a-zA-Z]\d")
_word = re.compile(r"^[(\[{\"'“”„«»‘’*_#>]*((?:[^\W\d_]++['’.\-/&@·+]?+)++)[)\]}\"'“”„«»‘’.,;:!?*_…]*$")
_odd = re.compile(r"[^\w\s.,;:!?'\"()\[\]{}/%&€$£+\-–—’‘“”„«»…@#*§°]|[¬-±¼-¿×÷�]")
_hex = re.compile(r"^\s*[0-9a-fA-F]{4,16}:?\s+(?:[0-9a-fA-F]{2,4}\s+){3,}")
_marker = re.compile(r"^\s*(?:[-*+•·‣⁃◦▪▫●○■□☐☑☒✓✔✗→➤»–—]|\(?\d{1,3}[.)]|\d{1,2}(?:\.\d{1,2})+\.?|\[[ xX]?\])\s+\S")
_lettered = re.compile(r"^\s*\(?(?:[a-zA-Z]|[ivxIVX]{1,5})[.)]\s+\S")
_label = re.compile(r"^\s*[^\W\d_][\w /.&'’()#-]{0,38}?\s*[:=]\s+\S")
_gap = re.compile(r"(?:^ {5}|\S) {3,}(?=\S)")
_divider = re.compile(r"[\s|;,]+")
_quoted = re.compile(r'"[^"]*"')


class _TokenClass(dict):
    """White-space token to its class and, times 32, the number of its function word; remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[token] = token_class(token)
        return value


def _function(word: str) -> int | None:
    index = _INDEX.get(word)
    return None if index is None else _MASK[word] + 32 * index


def token_class(token: str) -> int:
    """The set of languages (as bits) that have a token as a function word, plus 32 times its number, or one of WORD,
    NUMBER, IMPLAUSIBLE and SYMBOL."""
    if (found := _function(token.lower())) is not None:
        return found
    m = _word.match(token)
    if m:
        core = m[1].strip(".-/'’&@·+")
        if (found := _function(core.lower())) is not None:
            return found
        longest = max(map(len, _letters.findall(core)), default=0)
        if longest > 30:
            return IMPLAUSIBLE
        if "@" in core or "/" in core and "." in core:
            return NUMBER
        if longest <= 2 or core.isupper() and len(core) <= 6:  # initials, units, abbreviations, codes
            return NUMBER if core.isupper() else WORD if _vowel.search(core) or len(core) == 1 else IMPLAUSIBLE
        if not _vowel.search(core) or _odd.search(token):
            return IMPLAUSIBLE
        return IMPLAUSIBLE if len(_case.findall(core)) >= 3 else WORD
    letters = sum(map(str.isalpha, token))
    digits = sum(map(str.isdigit, token))
    if not letters and not digits:
        return SYMBOL
    if len(token) > 40 or _odd.search(token) and letters or len(_case.findall(token)) >= 4:
        return IMPLAUSIBLE
    return NUMBER if digits else (SYMBOL if 2 * letters < len(token) else WORD)


def _columns(line: str) -> tuple[str, int] | None:
    """The divider of a line that may be a row, and how often it stands there."""
    if "|" in line and (n := line.count("|")) >= 2:
        return "|", n
    if "\t" in line:
        return "\t", line.count("\t")
    if n := line.count(";"):
        if n >= 2 or n == 1 and " " not in line.strip():
            return ";", n
    if gaps := len(_gap.findall(line)):
        return " ", gaps
    if "," in line:
        bare = _quoted.sub("", line) if '"' in line else line
        tight = bare.count(",") - bare.count(", ")
        if tight >= 1 and tight == bare.count(",") and len(line.split()) <= 4 * (tight + 1):  # not "1,000" in a sentence
            return ",", tight
    return None


def _rows(lines: list[str]) -> list[bool]:
    """Which lines stand in a run of three or more with the same divider. Gaps vary by empty cells, and a line of a
    single cell doesn't end a run of them; other dividers stand equally often in most lines."""
    found = [_columns(x) for x in lines]
    out = [False] * len(lines)
    i = 0
    while i < len(found):
        if found[i] is None:
            i += 1
            continue
        sign = found[i][0]
        j = i + 1
        while j < len(found):
            if found[j] is None:
                if not (sign == " " and len(lines[j]) <= 40 and j + 1 < len(found) and found[j + 1] and found[j + 1][0] == " "):
                    break
            elif found[j][0] != sign:
                break
            j += 1
        counts = [found[x][1] for x in range(i, j) if found[x]]
        common = max(set(counts), key=counts.count)
        near = sum(c == common for c in counts)
        # one divider is not much: of a single one all lines must have the same
        if len(counts) >= 3 and (sign == " " or near >= 0.7 * len(counts) and common > 1 or near == len(counts)):
            out[i:j] = [True] * (j - i)
        i = j
    return out


def _wrapped(block: list[str]) -> bool:
    """Whether the lines of a block are one text: wrapped at a width, where the next word would not have fitted, or
    lines of some length of which many go on in lower case."""
    if len(block) < 2:
        return False
    width = max(map(len, block))
    if width < 24:
        return False
    full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width - 2 for a, b in zip(block, block[1:]))
    going_on = sum(b.lstrip()[:1].islower() for b in block[1:])
    return full >= 0.7 * (len(block) - 1) or going_on >= 0.4 * (len(block) - 1) and len(" ".join(block).split()) >= 5 * len(block)


def _sentence(line: str, words: int) -> bool:
    """Whether a line alone is running text: long, or of some length and closed like a sentence."""
    return words >= 12 or words >= 6 and line.rstrip().endswith((".", "!", "?", "…", '."', ".”", ".«", ".»"))


def line_shapes(lines: list[str]) -> list[int]:
    """Number in SHAPES of each (non-blank or blank) line; blank lines divide blocks and count nothing."""
    out = [0] * len(lines)
    full = [i for i, x in enumerate(lines) if x and not x.isspace()]
    for i, row in zip(full, _rows([lines[i] for i in full])):
        if row:
            out[i] = 2
    block: list[int] = []

    def close() -> None:
        texts = [lines[i].rstrip() for i in block]
        if not _wrapped(texts):
            for i, text in zip(block, texts):
                out[i] = 0 if _sentence(text, len(text.split())) else 1
        block.clear()

    letters = [bool(_lettered.match(lines[i])) for i in full]  # "V. Miller" alone is no list
    lettered = {i for n, i in enumerate(full) if letters[n] and (n and letters[n - 1] or n + 1 < len(full) and letters[n + 1])}
    last = -2
    for i in full:
        if i != last + 1:
            close()
        last = i
        if out[i] == 2:
            close()
        elif _marker.match(lines[i]) or i in lettered or (_label.match(lines[i]) and len(lines[i]) < 80):
            close()
            out[i] = 0 if len(lines[i].split()) > 14 else 1
        else:
            block.append(i)
    close()
    return out


def _repeats(words: list[str]) -> list[bool]:
    """Which words stand in a passage said for the third time or more: TRIPLES or more such triples in a row."""
    out = [False] * len(words)
    triples = list(zip(words, words[1:], words[2:]))
    if len(triples) - len(set(triples)) < TRIPLES:
        return out
    seen: dict[tuple[str, str, str] | None, int] = {}
    begin = 0
    for i, triple in enumerate([*triples, None]):
        times = seen[triple] = seen.get(triple, 0) + 1
        if times < 3:
            if i - begin >= TRIPLES:
                out[begin : i + 2] = [True] * (i + 2 - begin)
            begin = i + 1
    return out


def describe(text: str, known: dict[str, int]) -> tuple[list[int], list[int]]:
    """The characters of a text by class and shape (the last slot is what repeats itself), and the numbers of its
    function words."""
    mass = [0] * (_KINDS * 3 + 1)
    lines = text.split("\n")
    words: list[str] = []
    at: list[tuple[int, int]] = []
    functions: list[int] = []
    for line, shape in zip(lines, line_shapes(lines)):
        tokens = line.split() if shape != 2 else [x for x in _divider.split(line) if x]
        if not tokens:
            continue
        dump = _hex.match(line) is not None
        for token in tokens:
            code = known[token]
            kind = IMPLAUSIBLE if dump else code & 31
            slot, size = kind * 3 + shape, len(token)
            mass[slot] += size
            if kind <= WORD:
                if shape != 2:  # the cells of a table repeat each other anyway
                    words.append(token)
                    at.append((slot, size))
                if code > 31:
                    functions.append(code >> 5)
    if len(words) > TRIPLES + 2:
        repeated = _repeats(words)
        if any(repeated):
            for (slot, size), again in zip(at, repeated):
                if again:
                    mass[slot] -= size
                    mass[-1] += size
            if 2 * mass[-1] > sum(mass):  # what stands between copies of a passage belongs to them
                mass = [0] * (_KINDS * 3) + [sum(mass)]
    return mass, functions


def _character_classes() -> np.ndarray:
    out = np.full(0x2100, 6, np.int8)
    for code in range(0x2100):
        c = chr(code)
        out[code] = 4 if c.isspace() else 3 if c.isdigit() else (2 if code > 127 else 1 if c.isupper() else 0) if c.isalpha() else 5 if c in ".,;:!?'\"()-–—’‘“”„«»…" else 6
    return out


_CLASS_OF = _character_classes()


def character_shares(text: str) -> np.ndarray:
    """Shares of the classes of CHARACTERS in a text; letters beyond the table are letters beyond ASCII."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.zeros(7)
    beyond = codes >= len(_CLASS_OF)
    counts = np.bincount(_CLASS_OF[codes[~beyond]], minlength=7).astype(float)
    counts[2] += beyond.sum()
    return counts / len(codes)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence (bits) of each row of p from each row of q."""
    out = np.empty((len(p), len(q)))
    for i, row in enumerate(q):  # profiles are few
        m = (p + row) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(p > 0, p * np.log2(p / m), 0.0).sum(1)
            right = np.where(row > 0, row * np.log2(row / m), 0.0).sum(1)
        out[:, i] = (left + right) / 2
    return out


class Profiles:
    """The profiles of every language as matrices."""

    def __init__(self) -> None:
        slot = {(c, s): i * 3 + j for i, c in enumerate(CLASSES) for j, s in enumerate(SHAPES)} | {("repeated", ""): _WIDTH - 1}
        self.kinds = ["prose", "prose"] + [k for k, _ in PROFILES]
        self.merge, self.structure, self.words = [], [], []
        for n, lang in enumerate(LANGUAGES):
            # which slots of `describe` are the language's: its function words, and words of others as plain words
            merge = np.zeros((_KINDS * 3 + 1, _WIDTH))
            merge[-1, -1] = 1
            for kind in range(_KINDS):
                of = (0 if kind >> n & 1 else 1) if kind < _SETS else kind - _SETS + 1
                for shape in range(3):
                    merge[kind * 3 + shape, of * 3 + shape] = 1
            prose = [{("function", "running"): x, ("word", "running"): 0.92 - x, ("number", "running"): 0.08} for x in FUNCTION_SHARE[lang]]
            matrix = np.zeros((len(self.kinds), _WIDTH))
            for row, shares in zip(matrix, prose + [x for _, x in PROFILES]):
                for key, share in shares.items():
                    row[slot[key]] = share
            # frequent words come first in the language's list: shares by rank
            words = np.zeros(len(_INDEX) + 1)
            for rank, word in enumerate(FUNCTION_WORDS[lang].split()):
                words[_INDEX[word]] += 1 / (rank + 3)
            self.merge.append(merge)
            self.structure.append(matrix)
            self.words.append(words / words.sum())
        self.words = np.array(self.words)
        self.characters = np.array([CHARACTERS[lang] for lang in LANGUAGES])

    def nearest(self, mass: np.ndarray, functions: np.ndarray, characters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the number of its language, the divergence from that language's prose, and its kind's number."""
        shares = mass / np.maximum(mass.sum(1, keepdims=True), 1)
        said = functions.sum(1, keepdims=True)
        own = np.where(said > 0, functions / np.maximum(said, 1), 1 / functions.shape[1])
        far = [divergence(shares @ m, q) for m, q in zip(self.merge, self.structure)]
        prose = np.stack([f[:, :2].min(1) for f in far], 1)
        total = (PARTS[0] * prose + PARTS[1] * divergence(own, self.words) + PARTS[2] * divergence(characters, self.characters)) / sum(PARTS)
        lang = total.argmin(1)
        row = np.arange(len(lang))
        return lang, total[row, lang], np.stack([f.argmin(1) for f in far], 1)[row, lang]


# What counts as white space, as a character class of both engines.
_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Ends of lines that count as punctuation.
_CLOSED = rf"(?:[.!?…:;,]|[.!?…][\"”«»'’)])(?:{_SPACE})*$"


def counts(text: Column) -> list[Column]:
    """word_count, mean_word_length, symbol_ratio, punctuated_lines, common_words; null counts as empty, of which every
    count is 0. Words stand between white space; symbols are neither letters, digits nor white space."""
    full = F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(full, f"{_SPACE}+"), lambda w: w != ""))
    visible = F.length(F.regexp_replace(full, _SPACE, ""))
    symbols = F.length(F.regexp_replace(full, rf"[\p{{L}}\p{{N}}]|{_SPACE}", ""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.regexp_replace(x, _SPACE, "") != "")
    closed = F.size(F.filter(lines, lambda x: x.rlike(_CLOSED)))
    common = F.size(F.filter(F.split(F.lower(full), r"[^\p{L}\p{N}]+"), lambda w: w.isin(*sorted(ANY))))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return [
        words.cast("long").alias("word_count"), share(visible, words).alias("mean_word_length"), share(symbols, visible).alias("symbol_ratio"),
        share(closed, F.size(lines)).alias("punctuated_lines"), share(common, words).alias("common_words"),
    ]


def kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, language, jsd_prose, kind, and the columns of `df` beyond `key` and `text` as they are."""
    others = [f for f in df.schema.fields if f.name not in (key, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, profiles = _TokenClass(), Profiles()
        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = [describe(t, known) for t in texts]
            mass = np.array([m for m, _ in found] or np.zeros((0, _KINDS * 3 + 1)), float).reshape(-1, _KINDS * 3 + 1)
            functions = np.array([np.bincount(f, minlength=len(_INDEX) + 1) for _, f in found] or np.zeros((0, len(_INDEX) + 1)), float).reshape(-1, len(_INDEX) + 1)
            characters = np.array([character_shares(t) for t in texts] or np.zeros((0, 7))).reshape(-1, 7)
            lang, far, kind = profiles.nearest(mass, functions, characters)
            full = mass.sum(1) > 0
            arrays = [
                batch.column(key), pa.array([LANGUAGES[i] if x else None for i, x in zip(lang, full)], pa.string()), pa.array(np.where(full, far, 0.0)),
                pa.array([profiles.kinds[i] if x else "empty" for i, x in zip(kind, full)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(arrays + [batch.column(f.name) for f in others], names=[key, "language", "jsd_prose", "kind", *(f.name for f in others)])

    schema = ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}", "language string, jsd_prose double, kind string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)])
    return map_batches(df, run, schema)


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_words, language, jsd_prose, kind.

    Null, empty and blank texts have zero counts, no language and kind "empty"; other kinds are prose, list, table and
    junk. symbol_ratio is over visible characters, punctuated_lines over non-blank lines, common_words over words.
    jsd_prose is the mean divergence from the prose of the nearest language. Repeated rows repeat; null keys stay;
    other columns are not read.
    """
    kept = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *counts(F.col(text)))
    out = kinds(kept, "_key", "_text").withColumnRenamed("_key", key)
    return out.select(key, "word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "language", "jsd_prose", "kind")
