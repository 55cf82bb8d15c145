"""Freely typed values mapped to the entries of a reference list they mean, or reported as matching none.

Values are deduplicated first, so each distinct spelling is scored once however many rows have it. A spelling is
normalised into phrases (whole, and its parts without additions such as "department" or "(m/f/d)"); each phrase
retrieves candidates by its character n-grams, which include those of a word's consonants, so that "mgr" meets
"manager"; candidates are scored by the cosine of n-gram vectors weighted by inverse document frequency. The best entry
is accepted above a threshold and with a margin to the next one. An exact check follows for the lower scores: the
accepted entry must be near by edit distance too. Abbreviated words count as normalised if only one candidate fits.

A list up to a measured size is broadcast with its inverted index. A larger one stays a table: both sides are joined on
the n-grams that a pair above the threshold must share (the rarest of each, until what is left can't reach it), and
only such pairs are scored. Both ways give the same rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from paperloom.session import cut, map_batches, spread

#: Reference lists up to this many spellings together are broadcast; beyond, they are joined as tables.
BROADCAST_SPELLINGS = 20_000
#: Accepted from SURE cosine on; from POSSIBLE on if the exact check agrees; MARGIN to the next entry.
SURE, POSSIBLE, MARGIN = 0.5, 0.3, 0.02
#: Cosine from which an entry is a candidate, for words that are abbreviated.
FLOOR = 0.15
#: The exact check: least similarity by edit distance.
ALIKE = 0.55
#: No value at all, in any letter case.
NO_VALUE = ("", "n/a", "none", "unknown", "-")
# Words that people add around a value without changing what it means.
ADDITIONS = frozenset(
    "by via per paid pay with the in at of for our my a an and dept department division team unit group section office offices hq headquarters branch site "
    "remote hybrid onsite greater area region metro near city full part time permanent temporary contract m f d w x all genders days net "
    "scanned scan copy final draft new old custom type kind v1 v2 v3 v4 version pdf doc docx jpg png tiff txt file".split()
)

_camel = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])|(?<=[A-ZÀ-Þ])(?=[A-ZÀ-Þ][a-zà-ÿ]{2})")
_spelt_out = re.compile(r"(?<=[aou])e(?=[^aeiou]|$)")
_token = re.compile(r"[^\W_]+")
_bracketed = re.compile(r"[(\[{][^)\]}]*[)\]}]")
_part = re.compile(r"\s[/|–—-]+\s|[,;:|]|/")


def plain(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def tokens_of(text: str, camel: bool = True) -> tuple[str, ...]:
    """Words without case, accents and separators; camel case divides words unless the letter case is swapped."""
    if camel and not text[:1].islower():
        text = _camel.sub(" ", text)
    return tuple(_token.findall(plain(text)))


def phrases(value: str) -> list[tuple[str, ...]]:
    """What a value may say, as token tuples, the whole first."""
    forms = [value, _bracketed.sub(" ", value)]
    forms += [p for p in _part.split(forms[1]) if p.strip()]
    out: dict[tuple[str, ...], None] = {}
    for form in forms:
        for tokens in (tokens_of(form), tokens_of(form, camel=False)):
            out[tokens] = None
            out[tuple(t for t in tokens if t not in ADDITIONS)] = None
    return [t for t in out if t]


def _skeleton(word: str) -> str:
    """The first letter and the consonants after it, doubled ones once."""
    out = word[:1]
    for c in word[1:]:
        if c not in "aeiouy" and c != out[-1]:
            out += c
    return out


def grams(tokens: tuple[str, ...]) -> dict[str, float]:
    """Counts of the 2- and 3-grams of the words, marked at their ends, of the letters in one, of the pairs of the words'
    consonants, and of their first letters. Vowels spelt out (ue for ü) count as one."""
    out: dict[str, float] = defaultdict(float)
    folded = [_spelt_out.sub("", w) for w in tokens]
    for word in folded:
        marked = f"^{word}$"
        for n in (2, 3):
            for i in range(len(marked) - n + 1):
                out[marked[i : i + n]] += 1
        bones = _skeleton(word)
        for i in range(len(bones) - 1):
            out["~" + bones[i : i + 2]] += 1
        if len(bones) > 2:
            out["~" + bones[0] + bones[-1]] += 1
        out["<" + word[:1]] += 1
    joined = "".join(folded)
    for i in range(len(joined) - 2):
        out["=" + joined[i : i + 3]] += 1
    return out


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours as one edit; most + 1 if it is larger than `most`."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row, before = before, [i], row
        for j, y in enumerate(b, 1):
            d = min(row[j - 1] + 1, before[j] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1] if row[-1] <= most else most + 1


def alike(a: str, b: str) -> float:
    """1 - edits / length of the longer; 0 if more than half differs."""
    n = max(len(a), len(b))
    d = distance(a, b, n // 2)
    return 1 - d / n if d <= n // 2 else 0.0


def abbreviates(short: str, word: str) -> bool:
    """Whether a word is shortened: its beginning, or its letters in order without some vowels or the middle."""
    if word.startswith(short):
        return len(short) >= 2
    if short[:1] != word[:1] or len(short) < 2 or len(short) > 0.7 * len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short) and short[-1] in word[len(word) // 2 :]


def shortened(tokens: tuple[str, ...], words: tuple[str, ...]) -> bool:
    """Whether every word is there, some of them abbreviated."""
    if len(words) == 1:
        joined = "".join(tokens)
        return len(joined) >= 4 and abbreviates(joined, words[0])
    return len(tokens) == len(words) and all(a == b or abbreviates(a, b) for a, b in zip(tokens, words))


def similar(tokens: tuple[str, ...], words: tuple[str, ...]) -> float:
    """The exact check: similarity by edit distance, in any order of words."""
    out = alike("".join(tokens), "".join(words))
    if len(tokens) == len(words) > 1:
        out = max(out, alike("".join(sorted(tokens)), "".join(sorted(words))) - 0.05)
    return out


def idf(entries: int, having: int) -> float:
    """The weight of an n-gram that `having` of so many spellings have."""
    return math.log(1 + entries / having) if having else math.log(1 + entries)


def decide(top: int, score: float, second: float, near: float, short: int | None) -> tuple[int, float]:
    """The entry and score from the best entry, its cosine, the next entry's, the exact check of the best, and the only
    entry that is abbreviated, if any."""
    if short is not None:  # "Sr. Data Engineer" is nearer to "Data Engineer" by its n-grams alone
        return short, 0.95
    if score >= POSSIBLE and score - second >= MARGIN and (score >= SURE or near >= ALIKE):
        return top, score
    return -1, score


class Matcher:
    """One reference list: entries (id, spellings) behind an inverted index of n-grams."""

    def __init__(self, entries: list[tuple[int, list[str]]]):
        self.exact: dict[str, int] = {}
        self.spelled: list[tuple[int, tuple[str, ...]]] = []
        for ident, spellings in sorted(entries):
            for text in spellings:
                tokens = tokens_of(text, camel=False)
                if tokens:
                    self.exact.setdefault("".join(tokens), ident)
                    self.spelled.append((ident, tokens))
        df: dict[str, int] = defaultdict(int)
        vectors = [grams(tokens) for _, tokens in self.spelled]
        for vector in vectors:
            for gram in vector:
                df[gram] += 1
        self.idf = {g: idf(len(vectors), n) for g, n in df.items()}
        self.unseen = idf(len(vectors), 0)
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, vector in enumerate(vectors):
            weights = {g: n * self.idf[g] for g, n in vector.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for gram, weight in weights.items():
                self.postings[gram].append((i, weight / norm))

    def cosines(self, tokens: tuple[str, ...]) -> dict[int, float]:
        """Spelling number to weighted cosine, of all spellings that share an n-gram."""
        scores: dict[int, float] = defaultdict(float)
        square = 0.0
        for gram, n in grams(tokens).items():
            weight = n * self.idf.get(gram, self.unseen)
            square += weight * weight
            for i, other in self.postings.get(gram, ()):
                scores[i] += weight * other
        norm = math.sqrt(square)
        return {i: s / norm for i, s in scores.items()} if norm else {}

    def match(self, value: str) -> tuple[int, float]:
        """The entry that a value means and its score; (-1, best score) if none is meant."""
        said = phrases(value)
        for tokens in said:
            ident = self.exact.get("".join(tokens))
            if ident is not None:
                return ident, 1.0
        best: dict[int, tuple[float, float]] = {}
        short: set[int] = set()
        for tokens in said:
            for i, s in self.cosines(tokens).items():
                ident, words = self.spelled[i]
                if s < FLOOR or sum(map(len, words)) <= 3:
                    continue  # of initials only the exact form counts
                if shortened(tokens, words):
                    short.add(ident)
                near = similar(tokens, words) if POSSIBLE <= s < SURE else 1.0
                best[ident] = max(best.get(ident, (0.0, 0.0)), (s, near))
        if not best:
            return -1, 0.0
        ranked = sorted(((s, near, ident) for ident, (s, near) in best.items()), key=lambda x: (-x[0], x[2]))
        (score, near, top), second = ranked[0], ranked[1][0] if len(ranked) > 1 else 0.0
        return decide(top, score, second, near, next(iter(short)) if len(short) == 1 else None)


def has_value(value: Column) -> Column:
    """Whether a typed value is one at all."""
    return value.isNotNull() & ~F.lower(F.trim(F.regexp_replace(value, r"^\s+|\s+$", ""))).isin(*NO_VALUE)


def _by_broadcast(distinct: DataFrame, spelled: DataFrame) -> DataFrame:
    entries: dict[str, list[tuple[int, list[str]]]] = defaultdict(list)
    for row in spelled.collect():  # bounded: just counted
        entries[row.list_name].append((row.canonical_id, row.spellings))
    shared = distinct.sparkSession.sparkContext.broadcast(dict(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers: dict[str, Matcher] = {}
        for batch in batches:
            ids, scores = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in matchers:
                    matchers[name] = Matcher(shared.value.get(name, []))
                ident, score = matchers[name].match(value)
                ids.append(ident)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["list_name", "value", "canonical_id", "score"])

    return map_batches(spread(distinct), run, "list_name string, value string, canonical_id long, score double")


def _vectors(df: DataFrame, split_phrases: bool) -> DataFrame:
    """list_name, text, ident, said, gram, n: the n-grams of each phrase (said: its words, joined by blanks) of a value,
    or of a spelling as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, said, gram, count = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for tokens in dict.fromkeys(phrases(text) if split_phrases else [tokens_of(text, camel=False)]):
                    for g, n in grams(tokens).items():
                        at.append(row)
                        said.append(" ".join(tokens))
                        gram.append(g)
                        count.append(n)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(2).take(rows), pa.array(said, pa.string()), pa.array(gram, pa.string()), pa.array(count, pa.float64())], names=["list_name", "text", "ident", "said", "gram", "n"])

    return map_batches(df, run, "list_name string, text string, ident long, said string, gram string, n double")


def _weighted(vectors: DataFrame, key: list[str], known: DataFrame, sizes: DataFrame) -> DataFrame:
    """With w, the weight in the vector of length 1, and `rare`: whether the n-gram is among the rarest ones without
    which two vectors can't reach the threshold. The order is the same on both sides: by weight, then by n-gram."""
    of = Window.partitionBy(*key)
    raw = vectors.join(sizes, "list_name").join(known, ["list_name", "gram"], "left")
    # unrounded logarithms of equal counts are equal, so n-grams have one order on both sides
    raw = raw.withColumn("idf", F.log(1 + F.col("entries") / F.coalesce("having", F.lit(1)))).withColumn("w", F.col("n") * F.col("idf"))
    raw = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(of)))
    order = of.orderBy("idf", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # the commonest first
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(order))
    return raw.withColumn("rare", rest >= FLOOR - 1e-9).select(*key, "gram", "w", "rare")


def _by_join(distinct: DataFrame, spelled: DataFrame) -> DataFrame:
    """The same mapping by joins; rows are n-grams and pairs, no list is in one place."""
    flat = spelled.select("list_name", F.explode("spellings").alias("text"), F.col("canonical_id").alias("ident"))
    entries = cut(_vectors(flat, split_phrases=False))
    spellings = entries.groupBy("list_name", "text", "ident").agg(F.first("said").alias("said"))
    sizes = spellings.groupBy("list_name").agg(F.count("*").alias("entries"))
    known = cut(entries.groupBy("list_name", "gram").agg(F.count("*").alias("having")))
    values = cut(_vectors(spread(distinct.select("list_name", F.col("value").alias("text"), F.lit(0).cast("long").alias("ident"))), split_phrases=True))
    joined = F.translate("said", " ", "")
    sure = values.select("list_name", "text", joined.alias("said")).distinct().join(spellings.select("list_name", joined.alias("said"), "ident"), ["list_name", "said"])
    # of several phrases that are entries the first in order counts, as in memory; phrases are ordered there
    exact = sure.groupBy("list_name", "text").agg(F.collect_set(F.struct("said", "ident")).alias("sure"))
    a = _weighted(values, ["list_name", "text", "said"], known, sizes)
    b = _weighted(entries, ["list_name", "ident", "text"], known, sizes).withColumnsRenamed({"text": "spelling", "w": "v"})
    pairs = a.where("rare").select("list_name", "text", "said", "gram").join(b.where("rare").select("list_name", "ident", "spelling", "gram"), ["list_name", "gram"]).drop("gram").distinct()
    scored = pairs.join(a.select("list_name", "text", "said", "gram", "w"), ["list_name", "text", "said"]).join(b.select("list_name", "ident", "spelling", "gram", "v"), ["list_name", "ident", "spelling", "gram"])
    scored = scored.groupBy("list_name", "text", "said", "ident", "spelling").agg(F.sum(F.col("w") * F.col("v")).alias("cosine")).where(F.col("cosine") >= FLOOR)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short, near, keep = [], [], []
            for said, spelling, cosine in zip(*(batch.column(c).to_pylist() for c in ("said", "spelling", "cosine"))):
                tokens, words = tuple(said.split(" ")), tokens_of(spelling, camel=False)
                keep.append(sum(map(len, words)) > 3)
                short.append(shortened(tokens, words))
                near.append(similar(tokens, words) if POSSIBLE <= cosine < SURE else 1.0)
            out = pa.RecordBatch.from_arrays([batch.column(c) for c in ("list_name", "text", "ident", "cosine")] + [pa.array(short, pa.bool_()), pa.array(near, pa.float64())], names=["list_name", "text", "ident", "cosine", "short", "near"])
            yield out.filter(pa.array(keep, pa.bool_()))

    checked = map_batches(scored, check, "list_name string, text string, ident long, cosine double, short boolean, near double")
    by_entry = cut(checked.groupBy("list_name", "text", "ident").agg(F.max(F.struct("cosine", "near")).alias("best"), F.max("short").alias("short")))
    top = by_entry.groupBy("list_name", "text").agg(
        F.max(F.struct("best.cosine", (-F.col("ident")).alias("less"), "best.near")).alias("top"), F.min(F.when(F.col("short"), F.col("ident"))).alias("low"), F.max(F.when(F.col("short"), F.col("ident"))).alias("high")
    )
    second = by_entry.join(top.select("list_name", "text", (-F.col("top.less")).alias("first")), ["list_name", "text"]).where("ident <> first").groupBy("list_name", "text").agg(F.max("best.cosine").alias("second"))
    found = distinct.withColumnRenamed("value", "text").join(top, ["list_name", "text"], "left").join(second, ["list_name", "text"], "left").join(exact, ["list_name", "text"], "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, scores = [], []
            for text, sure, top, low, high, second in zip(*(batch.column(c).to_pylist() for c in ("text", "sure", "top", "low", "high", "second"))):
                if sure:
                    known: dict[str, int] = {}
                    for x in sorted(sure, key=lambda x: x["ident"]):
                        known.setdefault(x["said"], x["ident"])
                    ids.append(next(known["".join(t)] for t in phrases(text) if "".join(t) in known))
                    scores.append(1.0)
                    continue
                ident, score = decide(-top["less"], top["cosine"], second or 0.0, top["near"], low if low is not None and low == high else None) if top else (-1, 0.0)
                ids.append(ident)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("list_name"), batch.column("text"), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["list_name", "value", "canonical_id", "score"])

    return map_batches(found, choose, "list_name string, value string, canonical_id long, score double")


def match(cases: DataFrame, lists: DataFrame, broadcast_spellings: int = BROADCAST_SPELLINGS) -> DataFrame:
    """`cases` with canonical_id and score. cases needs list_name and value; lists: canonical_id, list_name,
    canonical_value, aliases.

    Values that are an entry's canonical_value as it stands get its id with score 1; -1 means that no entry is meant
    (also for lists without entries). Null values get a null id. Other columns pass through (canonical_id and score are
    replaced); repeated rows repeat. Lists of any size are matched; `broadcast_spellings` only chooses the way.
    """
    cases = cases.drop("canonical_id", "score")
    spelled = lists.where(F.col("canonical_value").isNotNull()).select(
        "list_name", F.col("canonical_id").cast("long").alias("canonical_id"), F.concat(F.array("canonical_value"), F.coalesce(F.filter("aliases", F.isnotnull), F.array().cast("array<string>"))).alias("spellings")
    )
    size = spelled.agg(F.coalesce(F.sum(F.size("spellings")), F.lit(0))).first()[0]
    cases = cut(cases)  # read for the distinct values and for the join
    distinct = cases.where(F.col("value").isNotNull()).select("list_name", "value").distinct()
    mapped = _by_broadcast(distinct, spelled) if size <= broadcast_spellings else _by_join(cut(distinct), spelled)
    return cases.join(mapped, ["list_name", "value"], "left")
