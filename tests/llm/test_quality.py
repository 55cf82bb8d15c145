"""Kinds of texts, counts, and the defined cases."""

import pytest

from paperloom.llm import quality

PROSE = "The committee met on Monday to discuss the budget, and it was agreed that the report should be sent to all members before the end of the month. Nobody objected to the plan."
WRAPPED = "The committee met on Monday to discuss the budget,\nand it was agreed that the report should be sent to\nall members before the end of the month. Nobody of\nthem objected to the plan that had been made."
GERMAN = "Der Ausschuss hat am Montag über den Haushalt beraten und beschlossen, dass der Bericht vor dem Ende des Monats an alle Mitglieder geschickt wird."
TABLE = [("Ref;City;Qty", "A-1;Arles;3", "A-2;Bern;14", "A-3;Cork;7", "A-4;;9"), ("| a | b |", "| --- | --- |", "| 1 | x |", "| 2 | y |"), ("City      Qty      Paid", "Arles     3        yes", "Bern               no", "Cork      7"), ('x,"1,000",y', 'z,"2,500",w', 'q,"3,900",e')]
CASES = [
    (PROSE, "prose"), (WRAPPED, "prose"), (GERMAN, "prose"), ("Minutes\n\n" + PROSE + "\n\n- budget\n- report", "prose"), (None, "empty"), ("", "empty"), (" \n\t ", "empty"),
    ("- apples and pears\n- a loaf of bread\n- milk\n- salt", "list"), ("1. Open the lid\n2. Fill the tank\n3. Close it", "list"), ("Name: Ann\nCity: Bern\nTotal: 42 EUR\nStatus: open", "list"), ("Bread\nMilk\nTwo apples\nA bag of rice\nSalt", "list"),
    *[("\n".join(t), "table") for t in TABLE], ("\n".join("\t".join(r.split(";")) for r in TABLE[0]), "table"),
    ("sdcf xdlz thgk dkzn tmfc skhc brkg nhqq lcvh krcm hwrs mtzv kqzp wrtl", "junk"), ("%|+*§ =|@¬ ¤<° ¤¬° =&= /¬$&+^ |<^*>¬ ¬^¬", "junk"), ("l19ObgQ+dYShE8PadfFfpd4BBUlQ2KLPYTomOxqDJKNSg5140keWpjK4BJ1LDfVOMClhq0CL" * 4, "junk"),
    ("00000000  da b0 ca e4 4a 38 c5 70\n00000010  5a 9e 10 e4 56 30 58 fe\n00000020  e6 b9 b8 6c 20 57 ed a9", "junk"), ("click here now " * 30, "junk"), ("------ ====== 201\n........\n_________", "junk"),
    (PROSE + "\n" + "\n".join(TABLE[0]), "prose"), (PROSE[:60] + "\n\n" + "\n".join(TABLE[0] * 6), "table"),
]


@pytest.fixture(scope="module")
def answers(spark):
    df = spark.createDataFrame([(i, c[0], "x") for i, c in enumerate(CASES)], "doc_id long, text string, kind string")
    return {r.doc_id: r for r in quality.statistics(df, "doc_id", "text").collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_kind(answers, n):
    assert answers[n].kind == CASES[n][1], CASES[n][0]


def test_counts(answers):
    r = answers[0]
    assert r.word_count == len(PROSE.split()) and r.punctuated_lines == 1.0 and 0.3 < r.common_words < 0.6 and 0 < r.symbol_ratio < 0.05
    assert r.mean_word_length == pytest.approx(sum(map(len, PROSE.split())) / len(PROSE.split()))
    assert r.jsd_prose < answers[CASES.index((CASES[-4][0], "junk"))].jsd_prose
    e = answers[4]
    assert (e.word_count, e.mean_word_length, e.symbol_ratio, e.punctuated_lines, e.common_words) == (0, 0.0, 0.0, 0.0, 0.0)


def test_languages(answers):
    assert answers[0].language == "en" and answers[2].language == "de" and answers[4].language is None
    french, spanish = "Le comité s'est réuni lundi pour examiner le budget et il a été décidé que le rapport serait envoyé à tous les membres avant la fin du mois.", "El comité se reunió el lunes para revisar el presupuesto y se acordó que el informe se envíe a todos los miembros antes de fin de mes."
    known, profiles = quality._TokenClass(), quality.Profiles()
    import numpy as np

    for text, lang in ((french, "fr"), (spanish, "es"), (PROSE, "en"), (GERMAN, "de")):
        mass, functions = quality.describe(text, known)
        got, far, kind = profiles.nearest(np.array([mass], float), np.array([np.bincount(functions, minlength=len(quality._INDEX) + 1)], float), np.array([quality.character_shares(text)]))
        assert quality.LANGUAGES[got[0]] == lang and profiles.kinds[kind[0]] == "prose" and far[0] < 0.4


def test_words_of_all_languages_mixed_are_farther_from_prose():
    """Function words count for one language only."""
    import numpy as np

    profiles, known = quality.Profiles(), quality._TokenClass()
    mixed = "the committee und avec para Bericht with los miembros dans Monat of pour die Haushalt con " * 2
    fars = []
    for text in (PROSE, mixed):
        mass, functions = quality.describe(text, known)
        _, far, _ = profiles.nearest(np.array([mass], float), np.array([np.bincount(functions, minlength=len(quality._INDEX) + 1)], float), np.array([quality.character_shares(text)]))
        fars.append(far[0])
    assert fars[0] < 0.8 * fars[1], fars


def test_divergence_by_hand():
    import numpy as np

    a, b = np.array([[0.5, 0.5, 0.0], [1.0, 0.0, 0.0]]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0]])
    assert quality.divergence(a, b).tolist() == [[0.0, 1.0], [pytest.approx(0.311278, abs=1e-6), 1.0]]


def test_a_repeated_part_counts_as_such():
    phrase = "click here now for the best price "
    assert [sum(quality._repeats((phrase * n).split())) for n in (1, 2, 4)] == [0, 0, 14]
    known = quality._TokenClass()
    for n, share in ((2, False), (30, True)):
        mass, _ = quality.describe(PROSE + "\n\n" + phrase * n, known)
        assert (mass[-1] > 0.5 * sum(mass)) == share


def test_repeats_nulls_and_long_texts(spark):
    df = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, None), (2, (PROSE + "\n\n") * 40 + GERMAN), (3, "x" * 200_000)], "doc_id long, text string")
    got = [(r.doc_id, r.kind) for r in quality.statistics(df, "doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted([(1, "prose"), (1, "prose"), (None, "empty"), (2, "junk"), (3, "junk")], key=str)  # one paragraph over and over is junk
    assert quality.statistics(df.limit(0), "doc_id", "text").count() == 0
