"""Pieces: whole, within the limit, cut by force only where there is no other way."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import splitting

PART = st.one_of(st.text("ab.,;!?\n  é\U0001f600", max_size=30), st.integers(1, 90).map(lambda n: "w" * n), st.sampled_from(["\n\n", ". ", " " * 70, "\n"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(PART, max_size=40), st.integers(20, 80), st.integers(0, 15))
def test_properties(parts, limit, overlap):
    text = "".join(parts)
    pieces = splitting.split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e, _ in pieces) == text
    assert all(0 < e - s <= limit and s <= b for s, b, e, _ in pieces)
    for before, after in zip(pieces, pieces[1:]):
        assert before[1] <= after[0] <= after[1] == before[2] and after[1] - after[0] <= overlap
    longest = max(map(len, re.findall(r"\S+", text)), default=0)
    assert any(p[3] for p in pieces) == (longest > limit)


def test_strongest_boundary():
    text = "a" * 40 + ", " + "b" * 8 + ". " + "c" * 8 + "\n\n" + "d" * 40
    (_, _, end, _), second = splitting.split_text(text, 80, 10)
    assert text[:end].endswith("\n\n") and text[second[0] : second[1]] == "c" * 8 + "\n\n"


def test_table(spark):
    rows = [(1, "x " * 2000), (1, "x " * 2000), (2, "y" * 3001), (3, "z" * 3000), (4, None), (5, ""), (None, "n " * 1600), (6, "\U0001f600" * 3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "run_id long, raw_text string, piece_no string")
    out = splitting.split(df, "run_id", "raw_text").collect()
    assert {r.run_id for r in out} == {1, 2, None} and {r.forced for r in out if r.run_id == 2} == {False, True}
    assert all(len(r.piece) == r.piece_end - r.piece_start <= 3000 for r in out)
    ones = [r for r in out if r.run_id == 1]
    assert len(ones) == 2 * len({r.piece_no for r in ones})
    assert splitting.split(df.limit(0), "run_id", "raw_text").count() == 0
