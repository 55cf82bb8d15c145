"""Spans of each type, validators, redaction, and names learnt from labelled rows."""

import json
import time

import pytest

from paperloom.llm import pii_text as pii

GIVEN = "Ilodra Hestibel Corevin Zorana Alomund Petisric Quinirna Wenistte Delola Roselo Evaton Kelila".split()
FAMILY = "Zellereau Cravinquist Undendorf Holoheim Moresky Pelleander Tarnogard Wickerini Grosomere Ashenova Boreson Lindewick".split()


@pytest.fixture(scope="module")
def score():
    rows = []
    for i, g in enumerate(GIVEN):
        for j, f in enumerate(FAMILY):
            name = f"{g} {f}" if (i + j) % 3 else f"{f}, {g}"
            text = f"Invoice Number: 12\nContact: {name}\nThe Committee Report of the Finance Department in Toringstead was sent by Quillmark Printing GmbH. Payment Terms apply.\nDear {g} {f},"
            rows.append((text, json.dumps([{"type": "NAME", "value": name}, {"type": "DATE_TIME", "value": "x"}])))
    return pii.NameScorer(*pii.fit_names(rows + [(None, None), ("text", "broken ["), ("", "{}")]))


CASES = [
    ("Write to jo.doe+x@mail.shop.example or jo (at) ops.example today.", {("email", "jo.doe+x@mail.shop.example"), ("email", "jo (at) ops.example")}),
    ("a_b [at] shop [dot] co [dot] example", {("email", "a_b [at] shop [dot] co [dot] example")}),
    ("Tel. (881) 555-0136 or 705.555.0118, +49 30 5550 5027, 01.99.00.39.71, 020 7946 0673, +18565550147", {("phone", p) for p in ("(881) 555-0136", "705.555.0118", "+49 30 5550 5027", "01.99.00.39.71", "020 7946 0673", "+18565550147")}),
    ("call +33 1 99 00\n09 06 now", {("phone", "+33 1 99 00 09 06")}),
    ("Order PO-2023-8153, tracking TRK 347,774 694,068, batch 44-10-220, lot 56/24, version 2.6.20, 2022-08-27, $12,710.55, room 24", set()),
    ("passport ZZ7537160, tax id 941 13 4272, number STU-835287, PAN CNJZQ9484R, NINO QQ 92 41 19 C, HOSP-2024-18406", {("identity_number", v) for v in ("ZZ7537160", "941 13 4272", "STU-835287", "CNJZQ9484R", "QQ 92 41 19 C", "HOSP-2024-18406")}),
    ("lives at Flat 4,\n863 Foundry Court, Velerfurt ZZ1 5QE and", {("street_address", "Flat 4, 863 Foundry Court, Velerfurt ZZ1 5QE")}),
    ("moved from 169 bis, rue du Quai Neuf, 00459 Havomont to Mühlenstraße 749, 00062 Havuvale and 566 Orchard Terrace, Suite 686, Wilerbury, XQ 00822", {("street_address", v) for v in ("169 bis, rue du Quai Neuf, 00459 Havomont", "Mühlenstraße 749, 00062 Havuvale", "566 Orchard Terrace, Suite 686, Wilerbury, XQ 00822")}),
    ("A letter for Dr. Undendorf and Ms. Zorana K. Holoheim from Quillmark Printing GmbH in Toringstead.", {("name", "Undendorf"), ("name", "Zorana K. Holoheim")}),
    ("Contact: MORESKY, Ilodra\nQuillmark Printing GmbH\nby Alomund von Grosomere-Ashenova; K. Boreson", {("name", "MORESKY, Ilodra"), ("name", "Alomund von Grosomere-Ashenova"), ("name", "K. Boreson")}),
    ("by Kelila O'Undendorf, Evaton de\nla Ashenova and Roselo van\nder Boreson", {("name", "Kelila O'Undendorf"), ("name", "Evaton de la Ashenova"), ("name", "Roselo van der Boreson")}),
    ("sent to Delola\nTarnogard today", {("name", "Delola Tarnogard")}), ("", set()), ("The Finance Department met.", set()), ("x" * 60_000, set()),
]


@pytest.mark.parametrize("n", range(len(CASES)))
def test_values(score, n):
    text, want = CASES[n]
    spans = pii.spans_of(text, score)
    assert {(s.kind, " ".join(text[s.start : s.end].split())) for s in spans} == want
    masked = pii.redact(text, spans)
    for s in spans:
        assert text[s.start : s.end] not in masked
    rest = masked
    for kind in pii.TYPES:
        rest = rest.replace(pii.PLACEHOLDERS[kind], "\0")
    left, at = [], 0
    for s in spans:
        left.append(text[at : s.start])
        at = s.end
    assert rest == "\0".join([*left, text[at:]])  # nothing else changes


def test_unseen_names(score):
    assert all(score(w)[0] > 0 for w in ("Rosolo", "Hestola", "Lindenova", "Holosky", "Tarnomere")) and all(score(w)[0] < 0 for w in ("Committee", "Payment", "Department", "Toringstead", "Printing"))
    assert score("Zellander")[1] > 0 > score("Kelibel")[1]


def test_checksums():
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.verhoeff("234123412346") and not pii.verhoeff("234123412347") and pii.dni("12345678Z") and not pii.dni("12345678A") and pii.nir("255081416802538")


@pytest.mark.parametrize("text", ["O'" * 20_000, "1 " * 20_000, "A. " * 20_000, "a@" * 20_000, "12 Ab " * 10_000, "Ab de la " * 5_000, "+1 " * 20_000, "'" * 40_000])
def test_time_is_linear_in_hostile_texts(score, text):
    began = time.perf_counter()
    pii.spans_of(text, score)
    assert time.perf_counter() - began < 10


def test_table(spark):
    rows = [("a", "Mail jo@x.example\n and  jo@x.example", None, "x"), ("a", "Mail jo@x.example\n and  jo@x.example", None, "x"), ("b", None, "[]", "x"), (None, "", "broken", "x")]
    df = spark.createDataFrame(rows, "document_id string, document_text string, truth string, redacted string")
    got = [(r.document_id, r.redacted, [tuple(f) for f in r.found]) for r in pii.find(df, "document_id", "document_text", "truth").collect()]
    one = ("a", "Mail [EMAIL]\n and  [EMAIL]", [("email", "jo@x.example")])
    assert sorted(got, key=str) == sorted([one, one, ("b", None, []), (None, "", [])], key=str)
    assert pii.find(df.limit(0), "document_id", "document_text", "truth").count() == 0
    assert len(pii.labelled_rows(df.union(df), "document_id", "document_text", "truth", 1)) == 1


def identities(score, text):
    return [text[s.start : s.end] for s in pii.spans_of(text, score) if s.kind == "identity_number"]


@pytest.mark.parametrize(
    ("right", "wrong", "frame"),
    [
        ("2341 2341 2346", "2341 2341 2347", "It says {} there."), ("2 55 08 14 168 025 38", "2 55 08 14 168 025 39", "It says {} there."), ("12345678Z", "12345678A", "It says {} there."), ("X1234567L", "X1234567M", "It says {} there."),
        ("078-05-1120", "666-05-1120", "It says {} there."), ("046 454 286", "046 454 287", "It is number {} there."), ("943 476 5919", "943 476 5918", "It is number {} there."), ("86095742719", "86095742718", "It is number {} there."),
    ],
)
def test_a_check_digit_decides(score, right, wrong, frame):
    """The same sentence with a right and a wrong number; a clear label keeps the wrong one too."""
    assert identities(score, frame.format(right)) == [right]
    assert identities(score, frame.format(wrong)) == []
    assert identities(score, f"Passport: {wrong}") == [wrong]


def test_accounts_and_cards_are_claimed_but_stay(score):
    for right, wrong in (("GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 33"), ("4539 1488 0343 6467", "4539 1488 0343 6468")):
        digits = right.split()[0]
        assert identities(score, f"Pay to {right} today.") == [] and digits in pii.redact(f"Pay to {right}.", pii.spans_of(f"Pay to {right}.", score))
        kinds = [{s.kind for s in pii._identity(f"{v} ", 0, pii._code_identities + pii._number_identities, "")} for v in (right, wrong)]
        assert "" in kinds[0] and "" not in kinds[1]


def test_every_validator_matters(score, monkeypatch):
    texts = [f"It says {v} there." for v in ("2341 2341 2346", "2341 2341 2347", "2 55 08 14 168 025 38", "2 55 08 14 168 025 39", "12345678Z", "12345678A", "078-05-1120", "666-05-1120")]
    texts += [f"It is number {v} there." for v in ("86095742719", "86095742718", "943 476 5919", "943 476 5918", "046 454 286", "046 454 287")]
    before = [identities(score, t) for t in texts]
    for name in ("verhoeff", "nir", "dni", "area", "steuer_id", "nhs", "luhn"):
        for answer in (True, False):
            with monkeypatch.context() as m:
                m.setattr(pii, name, lambda _, answer=answer: answer)
                assert [identities(score, t) for t in texts] != before, (name, answer)


def test_without_labels_titles_and_form_labels_tell_names():
    bare = pii.NameScorer()
    got = lambda text: [text[s.start : s.end] for s in pii.spans_of(text, bare) if s.kind == "name"]
    assert got("Patient Name: Zorana Holoheim\nThe Finance Department met Dr. Undendorf in Toringstead.") == ["Zorana Holoheim", "Undendorf"]
    assert got("Dear Zorana Holoheim, the Annual Report of the Board is ready.") == ["Zorana Holoheim"]


def test_bounds_of_the_sample(spark):
    rows = [(str(i), f"{'x' * 100} {i}", "[]") for i in range(20)]
    df = spark.createDataFrame(rows, "document_id string, document_text string, truth string")
    pick = lambda **k: pii.labelled_rows(df, "document_id", "document_text", "truth", **k)
    assert len(pick()) == 20 and len(pick(sample_rows=7)) == 7 and len(pick(sample_chars=520)) == 5 and pick(sample_chars=50) == []
    assert pick(sample_rows=7) == pick(sample_rows=20)[:7]
