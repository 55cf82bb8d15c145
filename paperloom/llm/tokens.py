"""Encoding of a corpus with a public byte-level BPE vocabulary, through a sentencepiece model made from it.

The vocabulary's ranks become a sentencepiece BPE model without training: every token is a piece of byte-mapped
characters whose score is its negative rank, so that the best-scored merge is the merge of the lowest rank;
normalisation is the identity. Texts are cut into pre-tokens by the vocabulary's own pattern, pre-tokens are encoded
by the model, and `decode` maps pieces back to bytes. Texts never leave their partition: one `mapInArrow`, no shuffle.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import map_batches

#: Where the public vocabularies lie unless a path is given, and the file used by default.
TOKENIZERS = "/opt/tokenizers"
RANKS = "byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern of the byte-level BPE vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pre-tokens whose ids a worker remembers before it starts anew; memory only, results don't depend on it.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256 and up."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: length-delimited bytes, a varint, or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks, followed by one unknown piece.

    Fields as in sentencepiece_model.proto: pieces (1), trainer_spec (2), normalizer_spec (3).
    """
    chars = byte_characters()
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    pieces = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1)) for rank, token in enumerate(by_rank)]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normaliser)


@lru_cache(1)
def _classes() -> tuple[str, str, str]:
    """\\p{L}, \\p{N} and \\s of the basic plane as explicit classes of the faster standard engine."""
    import regex

    plane = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x10000))))
    return tuple("".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(f"{c}+", plane)) for c in (r"\p{L}", r"\p{N}", r"\s"))


class Encoder:
    """Text to token ids and back. One per Python worker; loading takes well under a second."""

    def __init__(self, ranks_path: str):
        import regex
        import sentencepiece

        ranks = read_ranks(ranks_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.bytes_of = sorted(ranks, key=ranks.__getitem__)
        self.table = dict(enumerate(byte_characters()))
        letters, numbers, spaces = _classes()
        self.slow = regex.compile(PATTERN).findall
        self.fast = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+").findall
        self.beyond = re.compile("[\U00010000-\U0010ffff\ud800-\udfff]").search
        self.known: dict[str, array] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return self.slow(text) if self.beyond(text) else self.fast(text)

    def _encode(self, pre_token: str) -> array:
        mapped = pre_token.encode("utf-8", "replace").decode("latin-1").translate(self.table)
        return array("i", self.model.encode(mapped))

    def encode_into(self, text: str, out: array) -> None:
        known = self.known
        for token in self.pre_tokens(text):
            ids = known.get(token)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[token] = self._encode(token)
            out += ids

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.encode_into(text, out)
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def encoder(ranks_path: str) -> Encoder:
    return Encoder(ranks_path)


def encode(df: DataFrame, key: str, text: str, tokenizers: str = TOKENIZERS, ranks: str = RANKS) -> DataFrame:
    """`key` and ids ARRAY<INT> of every row, in the row's order of arrival; other columns are not read.

    An empty and a null text both have the empty list; white space is text; a null key stays null; repeated rows
    repeat. The vocabulary is read from `tokenizers`/`ranks` by each worker and is not part of the plan.
    """
    path = str(Path(tokenizers) / ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                if value:
                    enc.encode_into(value, flat)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kept = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = map_batches(kept, run, f"key {kept.schema['key'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("key", key)
