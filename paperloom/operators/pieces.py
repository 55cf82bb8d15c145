"""Operators that go through a text character by character: natural chunks and the repair of broken JSON. Both run over
Arrow batches; nothing is shuffled."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.constants import CHUNK, CHUNK_OVERLAP
from paperloom.session import map_batches

#: What a text is cut at, the strongest first: paragraphs, lines, words, characters.
BOUNDARIES = ("\n\n", "\n", " ", "")


def _atoms(text: str, size: int, boundaries: tuple[str, ...]) -> Iterator[tuple[str, str]]:
    """(boundary before, part) in order, no part longer than `size`: a part that is too long is cut at the next boundary."""
    sign = next(b for b in boundaries if b in text)
    rest = boundaries[boundaries.index(sign) + 1 :]
    parts = text.split(sign) if sign else [text[i : i + size] for i in range(0, len(text), size)]
    for n, part in enumerate(parts):
        joint = sign if n else ""
        if len(part) <= size:
            if part:
                yield joint, part
        else:
            inner = list(_atoms(part, size, rest))
            yield joint, inner[0][1]
            yield from inner[1:]


def natural_chunks(text: str | None, size: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """Pieces of at most `size` characters, cut at paragraphs, else lines, else words, else anywhere. A piece begins with
    the last whole parts of the piece before that fit into `overlap` characters. Blank texts have none."""
    if not text or not text.strip():
        return []
    out: list[str] = []
    held: list[tuple[str, str]] = []
    length = 0
    for joint, part in _atoms(text, size, BOUNDARIES):
        more = len(part) + (len(joint) if held else 0)
        if held and length + more > size:
            out.append("".join((j if n else "") + p for n, (j, p) in enumerate(held)))
            while held and (length > overlap or length + len(joint) + len(part) > size):
                length -= len(held[0][1]) + (len(held[1][0]) if len(held) > 1 else 0)
                held.pop(0)
            more = len(part) + (len(joint) if held else 0)
        held.append((joint, part))
        length += more
    out.append("".join((j if n else "") + p for n, (j, p) in enumerate(held)))
    return [p for x in out if (p := x.strip())]


def exploded_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """key, chunk_no, chunk of every text. Null and blank texts give no rows, repeated rows repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [natural_chunks(t, size, overlap) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, pieces in enumerate(found) for _ in pieces], pa.int64())
            numbers = pa.array([n for pieces in found for n in range(len(pieces))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), numbers, pa.array([p for pieces in found for p in pieces], pa.string())], names=["key", "chunk_no", "chunk"])

    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(kept, run, f"key {kept.schema['key'].dataType.simpleString()}, chunk_no int, chunk string").withColumnRenamed("key", key)


_fenced = re.compile(r"```(?:json)?[ \t\r\n]*([\s\S]*?)(?:[ \t\r\n]*```|$)")
_cut_word = re.compile(r"(?:t(?:r(?:u)?)?|f(?:a(?:l(?:s)?)?)?|n(?:u(?:l)?)?|-|\d+(?:\.\d+)?[eE][+-]?|\d+\.)$")


def repaired_json(text: str | None) -> str | None:
    """A JSON object or list made of a text that nearly is one, as compact JSON; null where there is none.

    Repaired are: a code fence or words around it, a missing end (open strings, lists and objects are closed, a member
    that has only begun is dropped), commas before a closing bracket, and single quotes instead of double ones.
    """
    if not text:
        return None
    fence = _fenced.search(text)
    body = fence[1] if fence and ("{" in fence[1] or "[" in fence[1]) else text
    start = min((i for i in (body.find("{"), body.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    out: list[str] = []
    stack: list[str] = []
    begun: list[int] = []  # length of `out` where the last member of each open bracket began
    quote = ""
    i = start
    while i < len(body):
        c = body[i]
        if quote:
            if c == "\\" and i + 1 < len(body):
                out.append("'" if quote == "'" and body[i + 1] == "'" else body[i : i + 2])
                i += 2
                continue
            if c == quote:
                out.append('"')
                quote = ""
            elif c == '"':
                out.append('\\"')
            elif c == "\n":
                out.append("\\n")
            elif c == "\t":
                out.append("\\t")
            elif c != "\r" and c >= " " and c != "\\":
                out.append(c)
        elif c in "\"'":
            quote = c
            out.append('"')
        elif c in "{[":
            stack.append(c)
            out.append(c)
            begun.append(len(out))
        elif c in "}]":
            if not stack or (stack[-1] == "{") != (c == "}"):
                break
            while out and (out[-1].isspace() or out[-1] == ","):
                out.pop()
            out.append(c)
            stack.pop()
            begun.pop()
            if not stack:
                break
        elif c == ",":
            begun[-1] = len(out)
            out.append(c)
        else:
            out.append(c)
        i += 1
    if quote:
        out.append('"')
    while True:
        closed = "".join("}" if b == "{" else "]" for b in reversed(stack))
        for tail in ("", None):
            whole = "".join(out) if tail == "" else _cut_word.sub("", "".join(out)).rstrip()
            try:
                return json.dumps(json.loads(whole.rstrip(", \t\r\n") + closed), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                pass
        if not stack:
            return None
        if len(out) > begun[-1]:
            del out[begun[-1] :]  # a key without a value, or a value that can't be read
        else:
            stack.pop()
            begun.pop()
            del out[-1:]
            if not stack:
                return None


def with_repaired_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, repaired (JSON text or null) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([repaired_json(t) for t in batch.column(1).to_pylist()], pa.string())], names=["key", "repaired"])

    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(kept, run, f"key {kept.schema['key'].dataType.simpleString()}, repaired string").withColumnRenamed("key", key)
