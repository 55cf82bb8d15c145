"""Encoding: equal to the public tokenizer, and an exact round trip."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import tokens

PATH = f"{tokens.TOKENIZERS}/{tokens.RANKS}"


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_and_round_trip(public, text):
    enc = tokens.encoder(PATH)
    ids = enc.encode(text)
    assert ids == public.encode(text, add_special_tokens=False).ids
    assert enc.decode(ids) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "it's we'LL  \n\n x\t ", "½ ١٢ ⅷ", "日本語テキスト。", "👩‍👩‍👧 ​ ", "a" * 20_000, " " * 5_000, "ÄÖÜ—“x”"])
def test_hard_texts(public, text):
    enc = tokens.encoder(PATH)
    assert enc.encode(text) == public.encode(text, add_special_tokens=False).ids and enc.decode(enc.encode(text)) == text


def test_forgetting_changes_nothing(monkeypatch):
    texts = [f"word{i} and {i * 7}" for i in range(50)]
    want = [tokens.Encoder(PATH).encode(t) for t in texts]
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.Encoder(PATH)
    assert [enc.encode(t) for t in texts] == want


def test_table(spark):
    rows = [(1, "white space is text", "x"), (2, "", "x"), (3, None, "x"), (None, " \n", None), (1, "white space is text", "y")]
    out = tokens.encode(spark.createDataFrame(rows, "doc_id long, text string, key string"), "doc_id", "text").collect()
    got = [(r.doc_id, r.ids) for r in out]
    assert sorted(got, key=str) == sorted([(1, got[0][1]), (1, got[0][1]), (2, []), (3, []), (None, tokens.encoder(PATH).encode(" \n"))], key=str) and got[0][1]
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
