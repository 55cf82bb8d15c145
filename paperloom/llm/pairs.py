"""Prompt-answer pairs whose answer is no usable answer, with the kinds of defect.

Every defect has several labelling functions: cheap, noisy votes for it (+1), against it (-1) or none (0), each on
evidence of its own (characters, wording, JSON structure, size, what is shared with the prompt). The votes of all pairs
are counted by pattern in Spark (at most 3 to the number of functions rows a defect, whatever the input) and an
expectation-maximisation label model on these counts learns how often each function is right; a pair's posterior
depends on its pattern only. Labels are kept where the posterior exceeds the defect's cutoff, several if several do.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.languages import ANSWER_VOTES, ENDINGS, FURTHER_WORDS, LETTERS
from paperloom.session import cut, map_batches

#: In the order in which one label is chosen where only one may be given.
DEFECTS = ("empty", "echo", "refusal", "truncated", "other_language")
#: Posterior from which a label is kept: what `choose_cutoffs` gives for labelled pairs; tests/llm hold them against
#: planted pairs that no function was written for.
CUTOFFS = {"empty": 0.5, "echo": 0.6, "refusal": 0.6, "truncated": 0.6, "other_language": 0.6}
#: Prior share of a defect, and the accuracies of votes that the model starts from and is drawn to (as pseudo-counts).
SHARE, HIT, FALSE, WEIGHT = 0.03, 0.9, 0.02, 0.01

# Answers that stand for nothing, and labels that announce an answer.
NOTHING = frozenset("null none nil nan n/a na undefined empty void nothing no-answer todo tbd json text output result response answer label markdown".split())
_fence = re.compile(r"^```[\w+-]*[ \t]*\r?\n?|\r?\n?```\s*$")
_announced = re.compile(r"^\W*(?:answer|antwort|réponse|respuesta|risposta|response|output|result|label|question|frage|pregunta)\s*:\s*", re.I)
_visible = re.compile(r"[^\W_]")
_words = re.compile(r"[^\W_]+")
_quoted = re.compile(r'"[^"\n]{12,}"|“[^”\n]{12,}”|„[^“”\n]{12,}[“”]|«[^»\n]{12,}»')
_LANGUAGE_NAMES = {
    "en": "english|englisch|anglais|inglés|ingles|inglese", "de": "german|deutsch|allemand|alemán|aleman|tedesco",
    "fr": "french|französisch|français|francais|francés|frances|francese", "es": "spanish|spanisch|espagnol|español|espanol|castellano|spagnolo",
    "it": "italian|italienisch|italien|italiano", "pt": "portuguese|portugiesisch|portugais|portugués|português", "nl": "dutch|niederländisch|néerlandais|neerlandés",
}
_asked = re.compile(rf"\b(?:in|auf|en)\s+(?:plain\s+|simple\s+)?({'|'.join(_LANGUAGE_NAMES.values())})\b", re.I)
_BY_NAME = {name: lang for lang, names in _LANGUAGE_NAMES.items() for name in names.split("|")}

# How answers decline in the first person, by language.
_DECLINES = [
    r"\b(?:i'm|i am|i’m|we are) (?:very |truly |so |afraid |really )?(?:sorry|unable|not able|not allowed|not permitted|afraid)\b",
    r"\bi (?:simply |really |also |just )?(?:cannot|can not|can't|can’t|won't|won’t|will not|must decline|must refuse|have to (?:decline|refuse|pass|leave)|decline|refuse|am obliged to decline)\b",
    r"\bi(?:'d|’d| would) (?:rather|prefer) not\b", r"\bi (?:don't|don’t|do not) (?:feel comfortable|think i (?:can|should))",
    r"\bas an? (?:ai|artificial|language model|assistant|large language)", r"\b(?:my|our) (?:guidelines|safety|polic|rules|programming|principles)",
    r"\bnot something i\b", r"\b(?:outside|beyond|outside of) what i\b", r"\bappropriate for me\b", r"\bi have to (?:pass|leave)\b",
    r"\bno (?:\w+ )?(?:answer|classification|assessment|result|output|summary|response|evaluation|judgement|judgment|extraction) (?:will|can|could) be (?:given|offered|provided|made)",
    r"\btut mir (?:sehr )?leid\b", r"\bkann ich (?:\w+ )?(?:\w+ )?nicht\b", r"\bich (?:kann|darf|werde|möchte|will)\b[^.!?]{0,80}\bnicht\b", r"\b(?:muss|möchte) ich\b[^.!?]{0,60}\b(?:ablehnen|verzichten|nicht)\b", r"\bmeine[rn]? (?:richtlinie|regel|vorgabe|sicherheit)", r"\bals (?:ki|sprachmodell|assistent)",
    r"\bje (?:suis|regrette|le regrette)[^.!?]{0,20}(?:désolée?|navrée?|incapable|dans l.impossibilité)", r"\bje ne (?:peux|puis|suis pas|souhaite|pourrai)\b", r"\bil m['’]est impossible\b", r"\bje (?:dois|préfère|me vois)\b[^.!?]{0,40}\b(?:décliner|refuser|ne pas|obligée?)\b", r"\b(?:à )?mes (?:règles|directives|consignes|principes)\b", r"\ben tant que (?:modèle|ia|assistant)",
    r"\blo siento\b", r"\b(?:no puedo|no me es posible|no me está permitido|no estoy (?:autorizad|en condiciones))", r"\b(?:debo|tengo que|prefiero)\b[^.!?]{0,30}\b(?:rechazar|declinar|no (?:pronunciarme|opinar|responder|continuar|seguir))\b", r"\bmis (?:normas|reglas|directrices|principios)\b", r"\bcomo (?:modelo|ia|asistente)\b",
    r"\bmi dispiace\b", r"\bnon (?:posso|mi è possibile|sono in grado)\b", r"\b(?:devo|preferisco)\b[^.!?]{0,30}\b(?:rifiutare|declinare|non)\b",
]
_declines = re.compile("|".join(_DECLINES))
_FIRST = frozenset("i me my ich mir mich je j m mes mi mis yo io".split())
# Words of regret, caution and rule, and beginnings of such words.
_WEAK = frozenset(
    "sorry unfortunately unable cannot decline refuse leider ablehnen désolé désolée décliner malheureusement impossible regrette siento lamento rechazar desgraciadamente lamentablemente prudence "
    "vorsicht precaución inappropriate appropriate permitted guidelines sensitive consult unanswered untouched comfortable verstößt contraire contra".split()
)
_WEAK_STARTS = ("apolog", "regret", "bedauer", "violat")
_third = re.compile(
    r"\b(?:the|its?) (?:writer|sender|applicant|table|reviewer|signature|wording|tone|style|patient|supplier|author|customer)\b|\b(?:der|die|das) (?:absender|prüfer|aufbau|tabelle|unterschrift|bewerber)|"
    r"\b(?:le|la|l['’]) ?(?:expéditeur|présentation|tableau|signature|candidat)|\b(?:el|la) (?:remitente|redacción|tabla|firma|solicitante)|"
    r"\b(?:the|das|le|el|il) (?:document|dokument|documento) (?:is|was|names|mentions|ist|nennt|est|mentionne|es|menciona|è)\b"
)
_OPEN_END = re.compile(r"(?:[,;:(\[{/&+=–—-]|\b(?:and|or|the|a|an|of|to|in|on|for|with|that|which|und|oder|der|die|das|den|dem|des|ein|eine|zu|von|mit|für|et|ou|le|la|les|de|des|du|un|une|que|qui|y|o|el|los|las|del|con|por|para|e|di|il))\s*$", re.I)
_ENDED = ".!?…。\"'”»)]}`"


def instruction_of(prompt: str) -> str:
    """The part of a prompt that asks: the first block, or the last one where the prompt begins with the document."""
    blocks = [b for b in re.split(r"\n\s*\n", prompt.strip()) if b.strip()]
    if len(blocks) > 1 and re.match(r"(?i)\s*(?:text|document|dokument|documento|texto|texte)\s*:|\"\"\"|```", blocks[0]):
        return blocks[-1]
    return blocks[0] if blocks else ""


def _unclosed(text: str) -> bool:
    """Whether a JSON text breaks off: a string or bracket is still open at its end."""
    depth, inside, escaped = 0, False, False
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
    return inside or depth > 0


def _strings(value: object, out: list[str]) -> None:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict):
            todo.extend(v.values())
        elif isinstance(v, list):
            todo.extend(v)


def _hollow(value: object) -> bool:
    """Whether a JSON value says nothing: null, an empty text, list or object, or only such things without a key."""
    if value is None or value == {}:
        return True
    if isinstance(value, str):
        return not _visible.search(value) or value.strip().lower() in NOTHING
    return isinstance(value, list) and all(map(_hollow, value))


def _sentence_like(text: str) -> bool:
    """Whether a value in JSON is prose rather than a name, an address or a label."""
    words = text.split()
    return len(words) >= 4 and sum(w[:1].islower() for w in words) >= 0.55 * len(words)


class Seen:
    """What the labelling functions look at, computed once a pair."""

    def __init__(self, prompt: str, answer: str | None):
        self.answer = (answer or "").strip()
        self.fences = self.answer.count("```")
        self.body = _fence.sub("", _fence.sub("", self.answer)).strip() if self.fences else self.answer
        self.json_like = self.body[:1] in ("{", "[") or self.body[:1] == '"' and self.body.endswith('"') and self.body.count('"') == 2
        self.parsed, self.is_json = None, False
        if self.json_like:
            try:
                self.parsed, self.is_json = json.loads(self.body), True
            except ValueError:
                pass
        if self.is_json:
            strings: list[str] = []
            _strings(self.parsed, strings)
            self.prose = ". ".join(filter(_sentence_like, strings))
        elif self.json_like and self.body[0] != '"':
            self.prose = " ".join(filter(_sentence_like, re.findall(r'"([^"\\]{16,})', self.body)))
        else:
            self.prose = self.body
        self.listed = bool(re.match(r"\s*(?:[-*•]|\d+[.)])\s", self.body + " "))
        self.words = _words.findall(self.body.lower())
        self.distinct = set(self.words)
        quoted = not self.is_json and ('"' in self.prose or "“" in self.prose or "„" in self.prose or "«" in self.prose)
        self.told = (_quoted.sub(" ", self.prose) if quoted else self.prose).lower()  # what it says itself
        self.told_words = self.words if not quoted and self.prose is self.body else _words.findall(self.told)
        self.said = _words.findall(prompt.lower())
        self.known = set(self.said)
        self.asked, self.expected = _of_instruction(instruction_of(prompt))


def _empty(s: Seen) -> tuple[int, ...]:
    """By letters, by what is left without wrapping, by JSON content, by size, and by words shared with the prompt."""
    letters = sum(map(len, s.words))
    rest = _announced.sub("", s.body).strip(" \t\r\n.\"'`*-_()[]{}<>#:")
    said = _words.findall(rest.lower())
    return (
        1 if not letters else -1 if letters > 40 else 0,
        1 if not rest or rest.lower() in NOTHING else -1 if len(said) > 1 and not NOTHING.issuperset(said) else 0,
        0 if not s.is_json else 1 if _hollow(s.parsed) else -1,
        1 if len(s.answer) < 2 else -1 if len(s.answer) > 60 else 0,
        -1 if sum(len(w) > 3 and w in s.known for w in s.distinct) > 1 else 0,
    )


_WRAPPING = frozenset("question answer prompt instruction instructions task text document label user input frage antwort aufgabe réponse pregunta respuesta".split())


def _unwrapped(words: list[str]) -> list[str]:
    """Words without labels such as "Question:" among the first two."""
    return [w for i, w in enumerate(words) if i > 1 or w not in _WRAPPING]


def _echo(s: Seen) -> tuple[int, ...]:
    """By the order of words (what the prompt doesn't say in a row), by the set of words, by the text as a whole, by
    words that the prompt doesn't have, by length, and by how the answer begins: each against the instruction alone and
    against the whole prompt."""
    words = _words.findall(s.prose.lower()) if s.is_json and isinstance(s.parsed, dict) and len(s.parsed) == 1 else s.words
    words = _unwrapped(words)
    n, asked = len(words), s.asked
    if not asked:
        return 0, 0, 0, 0, 0, 0
    if n < 3:
        return -1, -1, 0, 0, -1, 0
    text, said, mine = f" {' '.join(words)} ", f" {' '.join(s.said)} ", set(words)
    own = sum(w not in s.known for w in words) / n
    copied = 0.0 if own > 0.7 else sum(f" {a} {b} {c} " in said for a, b, c in zip(words, words[1:], words[2:])) / (n - 2)
    told = sum(f" {a} {b} {c} " in text for a, b, c in zip(asked, asked[1:], asked[2:])) / max(1, len(asked) - 2)
    like = max(len(mine & other) / len(mine | other) for other in (set(asked), s.known))
    return (
        1 if copied >= 0.8 and told >= 0.5 else -1 if copied <= 0.5 or told <= 0.2 else 0,
        1 if like >= 0.75 else -1 if like <= 0.5 else 0,
        1 if text in said and f" {' '.join(asked[:4])} " in text else 0,
        -1 if own > 0.25 else 1 if own <= 0.05 else 0,
        1 if min(abs(n - len(asked)) / len(asked), abs(n - len(s.said)) / len(s.said)) <= 0.1 else -1,
        1 if words[:3] in (asked[:3], _unwrapped(s.said)[:3]) else -1,
    )


def _refusal(s: Seen) -> tuple[int, ...]:
    """By phrases that decline, by words of regret or rule, by who speaks, by size, and by facts of the document."""
    strong, third = _declines.search(s.told) is not None, _third.search(s.told) is not None
    weak = sum(w in _WEAK or w.startswith(_WEAK_STARTS) for w in s.told_words)
    first = not _FIRST.isdisjoint(s.told_words)
    n = len(s.words)
    rich = s.is_json and (isinstance(s.parsed, list) or isinstance(s.parsed, dict) and len(s.parsed) > 2)
    return (
        1 if strong else -1,
        1 if weak and n <= 40 * weak else -1 if not weak else 0,
        -1 if third else 1 if first else 0,
        -1 if n > 90 or rich else 1 if 3 < n <= 30 else 0,
        -1 if any(w.isdigit() and w in s.known for w in s.distinct) else 0,
    )


def _fragment(s: Seen) -> bool:
    """Whether the last word is the beginning of a longer word of the prompt and nowhere a word itself."""
    last = s.words[-1] if s.words else ""
    if len(last) < 2 or last in s.known or s.words.count(last) > 1 or not s.body[-1:].isalnum():
        return False
    return any(w.startswith(last) for w in s.known)


def _truncated(s: Seen) -> tuple[int, ...]:
    """By open JSON, by an open code fence, by the closing mark of prose, by a last word or sign that something must
    follow, by a divided last word, and by the last item of a list."""
    body = s.body
    visible = _visible.search(body) is not None
    jsonish = s.json_like and body[0] != '"'
    state = 0 if not jsonish else -1 if s.is_json else 1 if _unclosed(body) else 0
    fence = 0 if not s.fences else 1 if s.fences % 2 else -1
    open_end = visible and _OPEN_END.search(body) is not None
    last = body.rsplit("\n", 1)[-1].strip()
    item = last.lstrip("-*• ") if s.listed else last
    enough = visible and len(s.words) > 2
    running = visible and not jsonish and (not s.listed and len(s.words) > 3 or s.listed and _sentence_like(item))
    ended = body[-1:] in _ENDED and not open_end
    cut_item = s.listed and (not _visible.search(last) or last.endswith((",", ":", "_", "-")))
    return (
        state,
        fence if visible or s.fences % 2 and len(body) > 2 else 0,
        0 if not running else -1 if ended else 1,
        0 if not enough else 1 if open_end and not s.is_json and not s.listed else -1 if ended else 0,
        1 if enough and _fragment(s) else 0,
        0 if not s.listed or not visible else 1 if cut_item else -1,
    )


def language_counts(text: str) -> dict[str, int]:
    """Function words of a text by language."""
    counts: dict[str, int] = {}
    for word in _words.findall(text.lower()):
        for lang in ANSWER_VOTES.get(word, ()):
            counts[lang] = counts.get(lang, 0) + 1
    return counts


_instructions: dict[str, tuple[list[str], str | None]] = {}


def _of_instruction(instruction: str) -> tuple[list[str], str | None]:
    """The words of an instruction and the language it expects; instructions recur, so they are remembered."""
    known = _instructions.get(instruction)
    if known is None:
        if len(_instructions) > 50_000:
            _instructions.clear()
        known = _instructions[instruction] = (_words.findall(instruction.lower()), expected_language(instruction))
    return known


def _by_endings(text: str) -> dict[str, int]:
    return {lang: len(p.findall(text)) for lang, p in ENDINGS.items()}


def expected_language(instruction: str) -> str | None:
    """The language that an instruction asks for, else the one it is written in; None if it can't be told."""
    asked = _asked.findall(instruction)
    if asked:
        return _BY_NAME[asked[-1].lower()]
    counts = language_counts(instruction)
    for lang in FURTHER_WORDS:  # they share words with the four main languages
        if lang in counts and counts[lang] < 2 + max((n for x, n in counts.items() if x not in FURTHER_WORDS), default=0):
            del counts[lang]
    best = sorted(counts.items(), key=lambda x: -x[1])[:2]
    if not best or len(best) > 1 and best[0][1] == best[1][1]:
        endings = sorted(_by_endings(instruction.lower()).items(), key=lambda x: -x[1])
        return endings[0][0] if endings[0][1] > endings[1][1] else best[0][0] if best else None
    return best[0][0]


def _other_language(s: Seen) -> tuple[int, ...]:
    """By function words, by word endings, by the share of the expected language's words, and by its letters.
    Nothing is said where the answer only copies the prompt, whose document may be in any language."""
    expected = s.expected
    text, words = s.told, s.told_words
    if s.listed:
        text = "\n".join(x.lower() for x in filter(_sentence_like, s.prose.split("\n")))  # field names are in no language
        words = _words.findall(text)
    if expected is None or len(words) < 4 or sum(w in s.known for w in words) >= 0.9 * len(words):
        return 0, 0, 0, 0
    counts: dict[str, int] = {}
    for word in words:
        for lang in ANSWER_VOTES.get(word, ()):
            counts[lang] = counts.get(lang, 0) + 1
    here = counts.pop(expected, 0)
    other = max(counts.values(), default=0)
    endings = _by_endings(text) if here < 3 or here < 2 * other else {}  # where the words settle it, nothing else is counted
    own_endings = endings.pop(expected, 0)
    other_endings = max(endings.values(), default=0)
    letters = {lang for lang, signs in LETTERS.items() if any(c in text for c in signs)}
    return (
        1 if other >= 3 and other >= 1.5 * here else -1 if here > other else 0,
        0 if not endings else 1 if other_endings > 1 and other_endings > 1.5 * own_endings else -1 if own_endings > other_endings else 0,
        -1 if here >= 0.12 * len(words) else 1 if here <= 0.08 * len(words) and other >= 0.15 * len(words) else 0,
        1 if letters and expected not in letters else -1 if expected in letters and len(letters) == 1 else 0,
    )


def votes_of(prompt: str, answer: str | None) -> tuple[tuple[int, ...], ...]:
    """The votes of all labelling functions, by defect."""
    s = Seen(prompt, answer)
    return _empty(s), _echo(s), _refusal(s), _truncated(s), _other_language(s)


FUNCTIONS = {d: len(v) for d, v in zip(DEFECTS, votes_of("Say it.", "It is said."))}


def _code(votes: tuple[int, ...]) -> int:
    out = 0
    for v in votes:
        out = out * 3 + v + 1
    return out


def _pattern(code: int, n: int) -> list[int]:
    return [code // 3 ** (n - 1 - i) % 3 - 1 for i in range(n)]


def pattern_votes(df: DataFrame, key: str, prompt: str, answer: str, fallback: str) -> DataFrame:
    """`key` and one pattern number for each defect, of the rows with a prompt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts, answers = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            codes = [tuple(map(_code, votes_of(p, a))) for p, a in zip(prompts, answers)]
            columns = list(zip(*codes)) if codes else [[]] * len(DEFECTS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int32()) for c in columns)], names=["key", *DEFECTS])

    kept = df.where(F.col(prompt).isNotNull()).select(F.col(key).alias("key"), F.col(prompt).alias("prompt"), F.coalesce(answer, fallback).alias("answer"))
    schema = f"key {kept.schema['key'].dataType.simpleString()}, " + ", ".join(f"{d} int" for d in DEFECTS)
    return map_batches(kept, run, schema).withColumnRenamed("key", key)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for one defect: (share, P(vote for | defect), P(vote for | none)), by function.

    Functions are independent given the label and an abstention says nothing. Pseudo-counts hold the functions near
    the starting accuracies where a defect is too rare to teach them.
    """
    n = patterns.shape[1]
    share, p1, p0 = SHARE, np.full(n, HIT), np.full(n, FALSE)
    total = max(1.0, counts.sum())
    prior = WEIGHT * total
    voted, agreed = (patterns != 0).astype(float), (patterns == 1).astype(float)
    for _ in range(rounds):
        post = posterior(patterns, share, p1, p0)
        w1, w0 = counts * post, counts * (1 - post)
        p1 = (w1 @ agreed + prior * SHARE * HIT) / (w1 @ voted + prior * SHARE)
        p0 = (w0 @ agreed + prior * FALSE) / (w0 @ voted + prior)
        before, share = share, float((w1.sum() + prior * SHARE) / (total + prior))
        if abs(share - before) < 1e-9:
            break
    return share, p1, p0


def posterior(patterns: np.ndarray, share: float, p1: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """P(defect | votes) of each pattern."""

    def log_likelihood(p: np.ndarray) -> np.ndarray:
        p = np.clip(p, 1e-9, 1 - 1e-9)
        return np.where(patterns == 1, np.log(p), np.where(patterns == -1, np.log(1 - p), 0.0)).sum(1)

    odds = math.log(1 - share) - math.log(share) + log_likelihood(p0) - log_likelihood(p1)
    return 1 / (1 + np.exp(np.clip(odds, -700, 700)))


def label_model(votes: DataFrame) -> dict[str, dict[int, float]]:
    """Defect to the posterior of every pattern that occurs, learnt from the counts of all rows of `pattern_votes`."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), F.col(d).alias("pattern")) for d in DEFECTS]))
    counted = votes.select(pairs.alias("x")).groupBy("x.defect", "x.pattern").count().collect()  # at most 3 ** functions a defect
    out: dict[str, dict[int, float]] = {}
    for defect in DEFECTS:
        rows = [(r.pattern, r["count"]) for r in counted if r.defect == defect]
        if rows:
            patterns = np.array([_pattern(p, FUNCTIONS[defect]) for p, _ in rows])
            post = posterior(patterns, *fit(patterns, np.array([n for _, n in rows], float)))
            out[defect] = dict(zip([p for p, _ in rows], post.tolist()))
        else:
            out[defect] = {}
    return out


def f_score(kept: np.ndarray, true: np.ndarray) -> float:
    """The harmonic mean of precision and recall; 1 where nothing is true and nothing kept."""
    return float(2 * (kept & true).sum() / (kept.sum() + true.sum())) if kept.any() or true.any() else 1.0


def choose_cutoffs(posteriors: dict[str, np.ndarray], truth: dict[str, np.ndarray], steps: int = 20) -> dict[str, tuple[float, float]]:
    """Defect to its cutoff and the F score there, from posteriors and labels (bool) of held-out pairs: the middle of
    the cutoffs that score best."""
    out = {}
    for defect, post in posteriors.items():
        tried = [(n / steps, f_score(post >= n / steps, truth[defect])) for n in range(1, steps)]
        best = max(f for _, f in tried)
        good = [x for x, f in tried if f == best]
        out[defect] = (good[len(good) // 2], best)
    return out


def find(df: DataFrame, key: str = "trace_id", prompt: str = "user_prompt", answer: str = "raw_output", fallback: str = "output_data", cutoffs: dict[str, float] = CUTOFFS) -> DataFrame:
    """`key`, defects ARRAY<STRUCT<defect, posterior>> of each defective pair, once however often it was sent.

    Pairs are the rows with a prompt; the answer is `answer`, or `fallback` where that is null (null in both is an
    empty answer). Labels are ordered as DEFECTS. Empty tables give no rows; null keys count as one key; other columns
    are not read. Fitting runs one small job over all votes, which are cut to the checkpoint folder first.
    """
    votes = cut(pattern_votes(df, key, prompt, answer, fallback))
    model = label_model(votes)

    def labels(defect: str):
        kept = {p: x for p, x in model[defect].items() if x >= cutoffs[defect]}
        if not kept:
            return F.lit(None).cast("double")
        return F.try_element_at(F.create_map(*[F.lit(v) for pair in kept.items() for v in pair]), F.col(defect))

    found = F.array(*[F.struct(F.lit(d).alias("defect"), labels(d).alias("posterior")) for d in DEFECTS])
    out = votes.select(key, F.filter(found, lambda x: x["posterior"].isNotNull()).alias("defects"))
    return out.where(F.size("defects") > 0).dropDuplicates([key])
