"""Lines, divided and misread words of planted pages, and the defined cases."""

import random
import time

from paperloom.llm import scans

SENTENCES = [
    "The department received the original statement before the agreed date.", "A long-term agreement with the supplier covers the packaging and the delivery of all goods.", "Please return the signed document to the office within thirty days.",
    "The customer accepted the correction although the amount had been reported twice.", "All attachments were examined in-house and the discrepancy was explained in writing.", "Management decided that the certificate remains valid until further notice.",
]
CLEAN = [" ".join(random.Random(i).sample(SENTENCES, 5)) for i in range(40)]


def page_text(rng, header, style, width=46, pages=3, per_page=9):
    """A scanned text with its planted furniture, divided and misread words."""
    words, lines, divided, misread = " ".join(rng.choice(SENTENCES) for _ in range(30)).split(), [], [], []
    line = ""
    for w in words:
        if "c" in w.lower() and w.isalpha() and len(w) > 6 and rng.random() < 0.1:
            at = w.index("e") if "e" in w else -1
            if at > 0:
                misread.append((w[:at] + "c" + w[at + 1 :], w))
                w = misread[-1][0]
        elif len(line) + len(w) > width and w.isalpha() and len(w) > 7 and rng.random() < 0.7:
            cut = rng.randrange(3, len(w) - 2)
            lines.append(f"{line} {w[:cut]}-")
            divided.append(w)
            line = w[cut:]
            continue
        elif w == "long-term" and len(line) + 6 <= width < len(line) + 12:
            lines.append(f"{line} long-")
            divided.append("long-term")
            line = "term"
            continue
        if len(line) + 1 + len(w) > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    lines.append(line)
    out, furniture = [], []
    for p in range(pages):
        number = style.format(p + 1)
        out += [header, *lines[p * per_page : (p + 1) * per_page], number]
        furniture += [("running_header", header), ("page_number", number)]
    kept = "\n".join(lines[: pages * per_page])
    divided = [d for d in divided if any(kept.find(f"{d[:c]}-\n{d[c:]}") >= 0 for c in range(1, len(d))) or d == "long-term" and "long-\nterm" in kept]
    return "\n".join(out), set(furniture), set(divided), {w for m, w in misread if m in kept.replace("-\n", "")}, kept


def corpus():
    rng = random.Random(8)
    shapes = [("Northgate Ltd | Annual report", "- {} -"), ("CLINICAL SUMMARY INV-2024-11", "Page {} of 3"), ("Transcript / AB-7 / Marsh Inc.", "[{}]"), ("Willow Staffing Group", "{}"), ("Personal file, continued", "{}/3")]
    return [page_text(rng, *shapes[i % len(shapes)]) for i in range(15)]


def test_planted_traces(spark):
    docs = corpus()
    rows = [(f"s{i}", d[0]) for i, d in enumerate(docs)] + [(f"c{i}", t) for i, t in enumerate(CLEAN)]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:3]] + [(None, None, "x"), ("e", "", "x")], "document_id string, text string, kind string")
    got = scans.find([(df, "document_id", "text", "t")]).collect()
    assert len(got) == len({tuple(r) for r in got}) and not [r for r in got if not (r.row_key or "").startswith("s")]
    hit = total = extra = 0
    for i, (_, furniture, divided, misread, _) in enumerate(docs):
        want = furniture | {("hyphenated", w) for w in divided} | {("misread", w) for w in misread}
        mine = {(r.kind, r.repaired) for r in got if r.row_key == f"s{i}"}
        hit += len(want & mine)
        total += len(want)
        extra += len(mine - want)
        assert furniture <= mine
    assert total > 150 and hit >= 0.97 * total and extra <= 0.03 * total


def test_repaired_text_is_the_text_without_traces(spark):
    docs = corpus()
    df = spark.createDataFrame([(f"s{i}", d[0]) for i, d in enumerate(docs)] + [(f"c{i}", t) for i, t in enumerate(CLEAN)] + [("n", None)], "document_id string, text string")
    source = (df, "document_id", "text", "t")
    out = {r.row_key: r.repaired for r in scans.repair(source, scans.find([source])).collect()}
    assert out["n"] is None and all(out[f"c{i}"] == t for i, t in enumerate(CLEAN))
    known = {w.strip(".") for s in SENTENCES for w in s.split()}
    strange = [w for i in range(len(docs)) for w in out[f"s{i}"].replace("\n\n", " ").split() if w.strip(".") not in known and not w.endswith("-")]  # the last page may end within a word
    words = sum(len(out[f"s{i}"].split()) for i in range(len(docs)))
    assert len(strange) <= 0.01 * words, strange[:20]


def test_numbers_that_are_no_page_numbers():
    text = "The order was placed on time and the goods\nwere sent to the office in the north where\n\nQuantity\n41\n\nthey were counted and found to be complete\nand undamaged on page 48.\nTotal pieces\n86"
    assert scans.Page(text).furniture() == []


def test_lines_said_twice_are_no_headers():
    body = "Further information can be requested from the office in\nthe north of the town during normal business hours, and\n" * 4 + "that is all that there is to say about it at present."
    assert scans.Page(body).furniture() == []


def test_page_numbers_across_form_feeds_and_misread():
    text = "first lines of the text go on and on until\nthe page ends\n- 1 -\fhere the text goes on for some more lines\nand then ends\n– 2 –"
    assert scans.Page(text).furniture() == [("page_number", "- 1 -"), ("page_number", "– 2 –")]
    assert scans.page_number("Page l of 6") == ("word", 1) and scans.page_number("Quantity") is None


def test_misread_variants_of_many_headers():
    names = "Aster Birch Cedar Dahlia Elder Fennel Ginger Hazel Iris Jasmine Kale Laurel Mallow Nettle Olive Poppy Quince Rowan Sorrel Thistle Umber Vetch Willow Yarrow Zinnia".split()
    heads = [f"{name} {other}berg Archive" for name, other in zip(names, names[7:] + names[:7])]
    pages = [(h, k) for h in heads for k in range(3)]
    rng = random.Random(4)
    lines = []
    for h, k in pages:
        lines.append(h.replace("Archive", "Arehivc") if k == 2 else h)
        lines += [" ".join(rng.choice(SENTENCES).lower().rstrip(".").split()[:8]) for _ in range(8)]
    furniture = {line for kind, line in scans.Page("\n".join(lines)).furniture() if kind == "running_header"}
    assert {h.replace("Archive", "Arehivc") for h in heads} | set(heads) == furniture


def test_lines_that_are_the_same_share_a_key():
    rng = random.Random(6)
    same = 0
    for _ in range(20000):
        a = "".join(rng.choice("abcd 12") for _ in range(rng.randrange(3, 40)))
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            at = rng.randrange(0, len(b) + 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice(["", "x", "y", "3"])
        b = "".join(b)
        if b and scans._same(b, a):
            same += 1
            assert scans._likeness(a) & scans._likeness(b), (a, b)
    assert same > 2000


def labelled(seed, n):
    """Planted pages with the label of every line."""
    rng = random.Random(seed)
    heads = ["Northgate Ltd | Annual report", "CLINICAL SUMMARY INV-2024-11", "Transcript / AB-7 / Marsh Inc.", "Willow Staffing Group", "Personal file 77 (continued)", "Harbour & Sons, Letters"]
    out = []
    for _ in range(n):
        head, style = rng.choice(heads), rng.choice(["- {} -", "Page {} of 4", "[{}]", "{}", "{}/4", "Seite {}"])
        lines, labels = [], []
        if rng.random() < 0.6:  # a title is said once and belongs to the text
            lines.append(rng.choice(["MEMO", "INVOICE", "Statement", "Letter of reference", "Discharge summary", "Employment agreement"]))
            labels.append(scans.BODY)
        spoilt = rng.random() < 0.4
        for p in range(rng.choice([2, 3, 4])):
            if p or not lines or rng.random() < 0.3:
                lines.append(" " * rng.choice([0, 0, 12]) + (head.replace("l", "1", 1).replace("o", "0", 1) if spoilt and p == 1 else head))
                labels.append(scans.HEADER)
            words = " ".join(rng.choice(SENTENCES) for _ in range(8)).split()
            line = ""
            for w in words[: rng.randrange(40, 70)]:
                if len(line) + 1 + len(w) > 46:
                    lines.append(line)
                    labels.append(scans.BODY)
                    line = w
                else:
                    line = f"{line} {w}".strip()
            if rng.random() < 0.3:
                lines += [rng.choice(["Quantity", "Units", "Rooms", "Seats", "Boxes", "Weight", "Copies"]), str(rng.randrange(3, 90))]
                labels += [scans.BODY] * 2
            lines.append(style.format(p + 1))
            labels.append(scans.NUMBER)
        out.append((lines, labels))
    return out


def test_weights_can_be_fitted():
    train, held = labelled(1, 120), labelled(2, 120)
    right = lambda w: sum(scans.label_lines(x, set(), w) == y for x, y in held) / len(held)
    zero = tuple(dict.fromkeys(w, 0.0) for w in (scans.HEADER_WEIGHTS, scans.NUMBER_WEIGHTS, scans.TRANSITIONS))
    from_nothing = scans.fit_weights(train, zero)
    assert right(zero) == 0.0 and right(from_nothing) > 0.8 and right(None) > 0.88
    assert right(scans.fit_weights(train)) >= right(None) - 0.02


def test_indented_lines_are_compared_by_keys():
    rng = random.Random(3)
    words = [w for s in SENTENCES for w in s.rstrip(".").split()]
    text = "\n".join("    " + " ".join(rng.choice(words).capitalize() for _ in range(rng.randrange(2, 5))) + rng.choice(words) for _ in range(4000))
    began = time.perf_counter()
    scans.Page(text)
    first = time.perf_counter() - began
    began = time.perf_counter()
    scans.Page(text + "\n" + text.replace("e", "a"))
    assert first < 4 and time.perf_counter() - began < 5 * first + 2


def test_many_headers_long_headers_and_large_page_numbers():
    rng = random.Random(9)
    heads = [f"{a.capitalize()} {b.capitalize()} Archive Northern Province, Volume {i % 7}" + " Supplements" * (i % 9) for i, (a, b) in enumerate(zip("abcdefghijklmnopqrstuvwxyzabcdefghijklmn", "qwertzuiopasdfghjklyxcvbnmqwertzuiopasdf"))]
    lines, want = [], set()
    for i, h in enumerate(heads):
        for k in range(3):
            shown = h.replace("Northern", "Nortbcrn") if k == 2 else h
            want.add(shown)
            lines += [shown] + [" ".join(rng.choice(SENTENCES).lower().rstrip(".").split()[:8]) for _ in range(8)] + [f"- {99_999 + 3 * i + k} -"]
    got = scans.Page("\n".join(lines)).furniture()
    assert len(heads) == 40 and {x for kind, x in got if kind == "running_header"} == want and sum(kind == "page_number" for kind, _ in got) == 120


def test_divided_words_across_a_long_box_and_long_words():
    box = "\n".join(f"Item {i}\tX" for i in range(12))
    page = scans.Page(f"the goods were sent to the depart-\n{box}\nment in the north and then were\nreturned by the next carrier without")
    assert [(a, b) for *_, a, b in page.divided()] == [("depart", "ment")]
    long = "donaudampfschifffahrtsgesellschaftskapitaenswitwe"
    assert scans.core(long) == long and long in scans.once(long.replace("m", "rn", 1)) and long in scans.twice(long.replace("m", "rn", 1).replace("h", "b", 1))


def test_rare_words_common_words_and_both_ways_of_joining(spark):
    """A form seen a few times is misread where the word it may be is common enough, however many words are commoner."""
    clean = [("c%d" % i, "the report and the statement of the office " * 40 + f"other{i % 7} word{i % 11}") for i in range(60)] + [("x%d" % i, "tbe is a word in six texts") for i in range(6)]
    scan = [("s", "- 1 -\nthe report and tbe statement of the office was\nsent to the other office in the north\n- 2 -")]
    df = spark.createDataFrame(clean + scan, "k string, t string")
    near = sorted(map(tuple, scans.find([(df, "k", "t", "t")]).collect()))
    far = sorted(map(tuple, scans.find([(df, "k", "t", "t")], broadcast_words=0).collect()))
    assert near == far and ("t", "s", "misread", "tbe", "the") in near


def test_empty(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert scans.find([(df, "k", "t", "t")]).count() == 0
    assert scans.repair_text("x" * 100_000, {}) == "x" * 100_000 and scans.repair_text("", {}) == ""
