"""Leaks against exhaustive edit distance, both ways of joining, and the defined cases."""

import random

from paperloom.llm import leaks

WORDS = [a + b for a in "ka lo mi ne pu ra si to vu wy zo be".split() for b in "dan rel sto mir gan pel".split()]


def fewest(item, text, least=25, per_edit=8):
    """Whether any span of the item, its first and last word in place, is in the text: edit distance of every span."""
    for i in range(len(item) - least + 1):
        prev = [10**6]
        for t in text:
            prev.append(min(0 if t == item[i] else 10**6, prev[-1] + 1))
        for n, word in enumerate(item[i + 1 :], 2):
            row = [10**6]
            for j, t in enumerate(text, 1):
                row.append(min(row[j - 1] + 1, prev[j] + 1, prev[j - 1] + (word != t)))
            if n >= least and any(word == t and prev[j] * per_edit <= n for j, t in enumerate(text)):
                return True
            prev = row
    return False


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(1, len(out) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "changed" + str(rng.randrange(99))
        elif kind == 1:
            out.insert(at, "added" + str(rng.randrange(99)))
        else:
            del out[at]
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    items = [[rng.choice(WORDS) for _ in range(rng.choice([20, 26, 40, 60]))] for _ in range(12)]
    docs = []
    for n in range(80):
        body = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        item = rng.choice(items)
        size = rng.choice([15, 24, 25, 26, 33, 40])
        at = rng.randrange(0, max(1, len(item) - size + 1))
        piece = edited(rng, item[at : at + size], rng.choice([0, 1, 2, 3, 4, 5, 7]))
        cut = rng.randrange(0, len(body) + 1)
        docs.append(body[:cut] + piece + body[cut:])
    return items, docs


def test_brute_force_and_both_ways(spark):
    items, docs = corpus()
    want = {(d, i) for d, text in enumerate(docs) for i, item in enumerate(items) if len(item) >= 25 and fewest(item, text)}
    assert 15 < len(want) < 70
    a = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, item_text string")
    near = {(r.doc_id, r.item_id) for r in leaks.find(a, b).collect()}
    far = {(r.doc_id, r.item_id) for r in leaks.find(a, b, broadcast_chars=0).collect()}
    assert near == far == want


def test_writing_does_not_matter(spark):
    item = "Élan vital, the Blue-Stamped ledger of 2019 was worth $15,441.06 when Ms. Crème-Brûlée sold nine of the forty maps to a clerk in Brüoville before the rain began there"
    dressed = "> **ELAN vital** the blue-\n> stamped ledger (of) 2019, was worth $15441.06; when <b>Ms</b> Creme-Brulee sold​ nine of the [forty](http://x) maps\n\n to a clerk in Bruoville — before the rain began there"
    short = " ".join(item.split()[:24])
    docs = spark.createDataFrame([(1, dressed), (2, short), (3, None), (4, ""), (5, item + " " + item), (5, item), (6, "no " * 3000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, "x"), (8, None, "x"), (9, "", "x"), (7, item, "y")], "item_id long, item_text string, text string")
    assert sorted(map(tuple, leaks.find(docs, items).collect())) == [(1, 7), (5, 7)]
    none = spark.createDataFrame([], "item_id long, item_text string")
    assert leaks.find(docs, none).count() == 0 and leaks.find(docs.limit(0), items).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(2)
    import numpy as np

    for _ in range(200):
        shared = np.array([rng.randrange(1, 1 << 40) for _ in range(6)])
        sides = [np.concatenate([np.array([rng.randrange(1, 1 << 40) for _ in range(rng.randrange(0, 9))], np.int64), shared, np.array([rng.randrange(1, 1 << 40) for _ in range(rng.randrange(0, 9))], np.int64)]) for _ in (0, 1)]
        a, b = (set(leaks.winnow(s, 5, 2)[1].tolist()) for s in sides)
        assert a & b


def shares(item, text, least=25, per_edit=8):
    known = leaks._Hashes()
    index = leaks.Index([(0, " ".join(item))], 5, 2)
    words = leaks.word_hashes(" ".join(text), known)
    hits = index.hits(*leaks.winnow(words, 5, 2)).get(0, [])
    return bool(hits) and leaks.shares_span(index.words[0], words, hits, least, per_edit)


def test_no_alignment_is_left_out():
    rng = random.Random(11)
    for n in range(40):  # the added word ties with a changed one
        item = [rng.choice(WORDS) for _ in range(60)]
        span = item[10:35]
        span.insert(1 if n % 2 else 24, "added")
        text = [rng.choice(WORDS) for _ in range(20)] + span + [rng.choice(WORDS) for _ in range(20)]
        assert fewest(item, text) and shares(item, text)
    found = 0
    for n in range(150):
        few = WORDS[: rng.choice([6, 12, len(WORDS)])]
        item = [rng.choice(few) for _ in range(rng.choice([25, 30, 60, 90]))]
        size = rng.choice([24, 25, 25, 26, 33, 48, 57])
        at = rng.randrange(0, max(1, len(item) - size + 1))
        text = [rng.choice(few) for _ in range(rng.randrange(0, 30))] + edited(rng, item[at : at + size], rng.choice([2, 3, 3, 4, 6, 7])) + [rng.choice(few) for _ in range(rng.randrange(0, 30))]
        want = fewest(item, text)
        assert shares(item, text) == want
        found += want
    assert 25 < found < 125


def test_parts_of_long_items_and_texts(monkeypatch):
    monkeypatch.setattr(leaks, "_WIDEST", 40)
    rng = random.Random(12)
    for at in range(0, 126, 25):
        item = [rng.choice(WORDS) for _ in range(150)]
        text = item[:6] * 30 + edited(rng, item[at : at + 25], 3) + item[:6] * 30
        assert shares(item, text) == fewest(item, text)


def test_fragments_of_the_item_around_the_span():
    """Decoys of the same item before and after a span, against every alignment."""
    rng = random.Random(21)
    found = 0
    for n in range(600):
        item = [rng.choice(WORDS) for _ in range(rng.choice([30, 45, 60]))]
        size = rng.choice([24, 25, 26, 33])
        at = rng.randrange(0, len(item) - size + 1) if len(item) > size else 0
        fragment = lambda: item[(x := rng.randrange(0, len(item) - 8)) : x + rng.randrange(5, 20)]
        span = edited(rng, item[at : at + size], rng.choice([0, 2, 3, 3, 4]))
        text = (fragment() if n % 3 else []) + [rng.choice(WORDS) for _ in range(rng.randrange(0, 6))] + span + [rng.choice(WORDS) for _ in range(rng.randrange(0, 6))] + (fragment() if n % 2 else [])
        want = fewest(item, text)
        assert shares(item, text) == want, n
        found += want
    assert 200 < found < 560


def test_a_repeated_phrase_is_one_row(spark):
    rng = random.Random(22)
    item = [rng.choice(WORDS) for _ in range(40)]
    docs = [(1, " ".join(item[:6] * 2000)), (2, " ".join(item[:6] * 2000 + item[5:35])), (3, " ".join(item[2:27]))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item[:6] * 9))], "item_id long, item_text string")
    near, far = (sorted(map(tuple, leaks.find(a, b, broadcast_chars=n).collect())) for n in (10**6, 0))
    assert near == far and {(2, 7), (3, 7), (1, 8), (2, 8)} == set(near)
