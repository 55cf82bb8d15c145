"""Mapping of typed values: spellings, additions, abbreviations, typos, and values that mean nothing on the list."""

import random

import pytest

from paperloom.llm import canonical

LISTS = [
    (1, "job", "Data Engineer", None), (2, "job", "Senior Data Engineer", None), (3, "job", "Machine Learning Engineer", ["ML Engineer"]), (4, "job", "Registered Nurse", ["RN"]), (5, "job", "Project Manager", None), (6, "job", "Product Manager", None),
    (10, "city", "Brüoville", None), (11, "city", "Toringstead", None), (12, "city", "Toringstead Heights", None), (13, "city", "Toringnay", None), (20, "pay", "Bank Transfer", ["Wire", "Überweisung"]), (21, "pay", "Cash", None), (22, "pay", "Cash on Delivery", ["COD"]),
]
CASES = [
    ("job", "data engineer", 1), ("job", "DataEngineer", 1), ("job", " Data  Engineer ", 1), ("job", "dATA eNGINEER", 1), ("job", "Sr. Data Engineer", 2), ("job", "Data Eng.", 1), ("job", "Engineer, Machine Learning", 3), ("job", "ml engineer", 3),
    ("job", "RN", 4), ("job", "rm", -1), ("job", "Product Mgr", 6), ("job", "Projct Managr", 5), ("job", "Data Engineer (m/f/d)", 1), ("job", "Data Engineer, full-time", 1), ("job", "Beekeeper", -1), ("job", "Falconer", -1),
    ("city", "BRUOVILLE", 10), ("city", "Remote / Brüoville", 10), ("city", "Toringstead Heights (HQ)", 12), ("city", "Toringstead, VY 00483", 11), ("city", "Torinstead", 11), ("city", "Greater Toringnay area", 13), ("city", "Jubbangle", -1), ("city", "", -1),
    ("pay", "wire", 20), ("pay", "paid: Cash", 21), ("pay", "Cash on Delivry", 22), ("pay", "cod", 22), ("pay", "barter", -1), ("pay", "ueberweisung", 20), ("pay", "two goats", -1), ("pay", "x" * 5000, -1), ("none", "Cash", -1),
]


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(LISTS, "canonical_id long, list_name string, canonical_value string, aliases array<string>")


def test_cases(spark, lists):
    cases = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "n int, list_name string, value string, want long")
    wrong = [(r.value, r.want, r.canonical_id, r.score) for r in canonical.match(cases, lists).collect() if r.want != r.canonical_id]
    assert not wrong


def test_planted_typos():
    """One or two edits in longer entries are undone; the accuracy is stated."""
    rng = random.Random(1)
    matcher = canonical.Matcher([(i, [v, *(a or [])]) for i, n, v, a in LISTS if n == "job"])
    right = total = 0
    for i, n, v, _ in LISTS:
        if n == "job" and len(v) > 9:
            for _ in range(60):
                w = list(v)
                for _ in range(rng.choice([1, 2])):
                    at = rng.randrange(len(w))
                    w[at : at + 1] = rng.choice([[], [rng.choice("aeinrst")], [w[at], rng.choice("aeinrst")]])
                total += 1
                right += matcher.match("".join(w))[0] == i
    assert right / total > 0.97


def test_table(spark, lists):
    rows = [(1, "pay", "Cash"), (1, "pay", "Cash"), (2, "pay", None), (3, None, "Cash"), (None, "pay", "cash")]
    cases = spark.createDataFrame(rows, "canonical_value long, list_name string, value string")
    got = sorted(((r.canonical_value, r.list_name, r.value, r.canonical_id) for r in canonical.match(cases, lists).collect()), key=str)
    assert got == sorted([(1, "pay", "Cash", 21), (1, "pay", "Cash", 21), (2, "pay", None, None), (3, None, "Cash", None), (None, "pay", "cash", 21)], key=str)
    assert {r.canonical_id for r in canonical.match(cases, lists.limit(0)).collect()} == {-1, None}
    values = spark.createDataFrame([(v,) for v in (None, "", " ", "N/A", "none", "Unknown", "-", "x")], "v string")
    assert [r.v for r in values.where(canonical.has_value(values.v)).collect()] == ["x"]


@pytest.mark.parametrize(("value", "near", "meant"), [("Sr Dev Manager", "Sr Dev Manager", "Senior Developer Manager"), ("Data Eng", "Data Eng", "Database Engineering")])
def test_entries_beyond_the_six_nearest_are_checked(value, near, meant):
    names = "Ada Bob Cleo Dora Egon Fritz Gina Hugo".split()
    entries = [(n, [f"{near} {name}"]) for n, name in enumerate(names, 1)] + [(50, [meant])]
    assert canonical.Matcher(entries).match(value) == (50, 0.95)


def test_both_ways_give_the_same_rows(spark, lists):
    rng = random.Random(5)
    rows = [(n, v) for n, v, _ in CASES if v and n != "none"]
    for _ in range(60):
        name, value = rng.choice([(n, v) for _, n, v, _ in LISTS])
        w = list(value)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(["", "x", "e", " "])
        rows.append((name, "".join(w)))
    cases = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, list_name string, value string")
    near = {r.n: (r.canonical_id, round(r.score, 6)) for r in canonical.match(cases, lists).collect()}
    far = {r.n: (r.canonical_id, round(r.score, 6)) for r in canonical.match(cases, lists, broadcast_spellings=0).collect()}
    wrong = [(rows[i], near[i], far[i]) for i in near if near[i][0] != far[i][0] or near[i][0] >= 0 and near[i] != far[i]]
    assert not wrong and len(near) == len(far) == len(rows)


def test_the_cosine_decides():
    """Without the exact check hardly anything changes: it only takes away."""
    rng = random.Random(2)
    matcher = canonical.Matcher([(i, [v, *(a or [])]) for i, _, v, a in LISTS])
    typed = [(i, v) for i, _, v, _ in LISTS if len(v) > 8 for _ in range(40)]
    right = 0
    for i, v in typed:
        at = rng.randrange(1, len(v))
        value = v[:at] + rng.choice("aeirst") + v[at + rng.randrange(2) :]
        scores = {}
        for tokens in canonical.phrases(value):
            for k, s in matcher.cosines(tokens).items():
                ident = matcher.spelled[k][0]
                scores[ident] = max(scores.get(ident, 0), s)
        top = sorted(scores.items(), key=lambda x: -x[1])
        right += top[0][0] == i and top[0][1] >= canonical.POSSIBLE and top[0][1] - top[1][1] >= canonical.MARGIN
        assert matcher.match(value)[0] in (i, -1)
    assert right >= 0.98 * len(typed)
