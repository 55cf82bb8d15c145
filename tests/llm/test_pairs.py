"""Labelling functions and label model on planted defects."""

import json
import random

import numpy as np
import pytest

from paperloom.llm import pairs

ASK = {
    "en": ["Summarise the following document for the reviewer in two sentences.", "Describe in a short paragraph what the writer of this document wants."],
    "de": ["Fasse das folgende Dokument für die Prüferin in drei Sätzen zusammen.", "Erkläre, warum dieses Dokument zur manuellen Prüfung geschickt wurde."],
    "fr": ["Résume le document suivant en trois phrases pour la personne chargée du contrôle.", "Explique pourquoi ce document a été transmis pour une vérification manuelle."],
    "es": ["Resume el siguiente documento en tres frases para la persona que lo revisa.", "Explica por qué este documento se envió a revisión manual."],
}
TELL = {
    "en": ["The sender is sorry for the delay and cannot deliver before June.", "The applicant declined the first proposal and the dates do not match each other.", "It mentions a total of 40 EUR and refers to an earlier document."],
    "de": ["Der Absender bittet um Entschuldigung und kann nicht vor Juni liefern.", "Die Daten sollten verglichen werden, weil zwei davon nicht zusammenpassen.", "Es nennt einen Gesamtbetrag von 40 EUR und verweist auf ein früheres Dokument."],
    "fr": ["L'expéditeur est désolé du retard et ne peut pas livrer avant le mois de juin.", "Il faudrait comparer les dates, car deux d'entre elles ne concordent pas.", "Il mentionne un montant total de 40 EUR et renvoie au document précédent."],
    "es": ["El remitente lamenta el retraso y no puede entregar antes del mes de junio.", "Conviene comparar las fechas, porque dos de ellas no coinciden con el resto.", "Menciona un importe total de 40 EUR y remite al documento anterior."],
    "it": ["Il documento è una lettera formale e serve a chiarire i punti ancora aperti tra le due parti.", "Conviene confrontare le date, perché due di esse non coincidono."],
}
REFUSE = ["I'm sorry, but I can't help with this request.", "As a language model I must decline to comment on this file.", "Thank you for the document. However, answering this is outside of what I am permitted to do.", "Es tut mir leid, aber dabei kann ich nicht helfen.", "Je suis désolé, mais je ne peux pas répondre à cette demande.", "Lo siento, pero no puedo ayudar con esta petición."]
DOC = "The patient is unable to tolerate the new medication, therefore it was changed on 5 May after a talk with the ward."


def plant(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(ASK))
        ask = rng.choice(ASK[lang])
        prompt = rng.choice([f"{ask}\n\n{DOC}", f"Text: {DOC}\n\n{ask}", f'{ask}\n\n"""\n{DOC}\n"""'])
        good = " ".join(rng.sample(TELL[lang], 2))
        if rng.random() < 0.3:
            good = json.dumps({"reasoning": good, "confidence": 0.5}, ensure_ascii=False)
        defect = rng.choice([None] * 6 + list(pairs.DEFECTS))
        if defect == "empty":
            good = rng.choice(["", " \n", "null", "N/A", "{}", "[]", '""', "```json\n```", "-", "..."])
        elif defect == "echo":
            good = rng.choice([prompt, ask, "Question: " + ask, ask.upper(), json.dumps({"answer": ask}, ensure_ascii=False)])
        elif defect == "refusal":
            own = {"en": REFUSE[:3], "de": REFUSE[3:4], "fr": REFUSE[4:5], "es": REFUSE[5:]}[lang]
            good = rng.choice([rng.choice(own), json.dumps({"error": rng.choice(own)})])
        elif defect == "truncated":
            good = good[: rng.randrange(len(good) // 3, len(good) - 8)].rstrip(" .")
        elif defect == "other_language":
            good = " ".join(TELL[rng.choice([x for x in TELL if x != lang])][:2])
        rows.append((i, prompt, good if rng.random() < 0.8 else None, good, defect))
    return rows


def with_two(seed, n):
    """Planted pairs with their sets of labels: as `plant`, and answers in another language that break off."""
    rng = random.Random(seed)
    rows = [(i, p, a if a is not None else b, {d} if d else set()) for i, p, a, b, d in plant(seed, n)]
    for i in range(n // 8):  # instructions that are repeated with small changes, and such that are repeated and then answered
        lang = rng.choice(list(ASK))
        ask = rng.choice(ASK[lang])
        words = ask.split()
        if i % 2:
            words[rng.randrange(2, len(words))] = "such"
            rows.append((n + i, f"{ask}\n\n{DOC}", f"{' '.join(words)} {DOC if i % 4 == 1 else ''}".strip(), {"echo"}))
        else:
            rows.append((n + i, f"{ask}\n\n{DOC}", f"{'You asked: ' if i % 4 else ''}{ask} {' '.join(TELL[lang][:2])}", set()))
    for i in range(n // 20):
        lang = rng.choice(list(ASK))
        answer = " ".join(TELL[rng.choice([x for x in TELL if x != lang])])
        rows.append((2 * n + i, f"{rng.choice(ASK[lang])}\n\n{DOC}", answer[: rng.randrange(len(answer) // 2, len(answer) - 12)].rstrip(" .,"), {"truncated", "other_language"}))
    return rows


def test_cutoffs_and_model_on_held_out_pairs():
    rows = with_two(29, 1500)
    votes = [pairs.votes_of(p, a) for _, p, a, _ in rows]
    posts, truth, better = {}, {}, 0.0
    for k, defect in enumerate(pairs.DEFECTS):
        own = np.array([v[k] for v in votes])
        patterns, back, counts = np.unique(own, axis=0, return_inverse=True, return_counts=True)
        assert len(patterns) >= 8, (defect, len(patterns))
        posts[defect] = pairs.posterior(patterns, *pairs.fit(patterns, counts.astype(float)))[back.ravel()]
        truth[defect] = np.array([defect in r[3] for r in rows])
        f = pairs.f_score(posts[defect] >= pairs.CUTOFFS[defect], truth[defect])
        others = [pairs.f_score(own.sum(1) > 0, truth[defect]), *(pairs.f_score(own[:, j] > 0, truth[defect]) for j in range(own.shape[1]))]
        assert f >= max(others) - 0.02, (defect, f, others)
        better += f - others[0]
    assert better > 0
    best = pairs.choose_cutoffs(posts, truth)
    for defect, (_, f) in best.items():
        assert f > 0.94 and pairs.f_score(posts[defect] >= pairs.CUTOFFS[defect], truth[defect]) >= f - 0.01, (defect, best)


def test_two_labels_are_kept(spark):
    rows = with_two(31, 400)
    df = spark.createDataFrame([(i, p, a, None) for i, p, a, _ in rows], "trace_id long, user_prompt string, raw_output string, output_data string")
    got = {r.trace_id: {d.defect for d in r.defects} for r in pairs.find(df).collect()}
    both = [i for i, _, _, labels in rows if len(labels) == 2]
    assert len(both) == 20 and sum(got.get(i) == {"truncated", "other_language"} for i in both) >= 19


def test_held_out_defects(spark):
    rows = plant(3, 900)
    df = spark.createDataFrame(rows + rows[:50], "trace_id long, user_prompt string, raw_output string, output_data string, defects string")
    found = {r.trace_id: r.defects[0].defect for r in pairs.find(df).collect()}
    wrong = [(r[4], found.get(r[0]), r[3]) for r in rows if r[4] != found.get(r[0])]
    assert len(wrong) <= 0.01 * len(rows), wrong[:8]


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        ('{"pii_detections": []}', None), ("resume", None), ("- due_date\n- salary", None), ('```json\n{"a": "brace } in text"}\n```', None), ("The writer refuses to answer further questions.", None), ("None", "empty"), (None, "empty"),
        ('{"a": [1, 2', "truncated"), ('```json\n{"a": 1', "truncated"), ("x" * 100_000 + ".", None),
    ],
)
def test_single_answers(answer, want):
    votes = dict(zip(pairs.DEFECTS, pairs.votes_of("Name the type of this document.\n\n" + DOC, answer)))
    most = {d: sum(v) for d, v in votes.items()}
    assert ([d for d, v in most.items() if v > 0] or [None])[0] == want


def test_label_model_learns_and_is_anchored():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.1
    acc = [0.95, 0.8, 0.7]
    votes = np.stack([np.where(rng.random(4000) < 0.2, 0, np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1))) for a in acc], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, p1, p0 = pairs.fit(patterns, counts.astype(float))
    post = dict(zip(map(tuple, patterns.tolist()), pairs.posterior(patterns, share, p1, p0)))
    hit = sum((post[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), y)) / 4000
    assert 0.05 < share < 0.2 and hit > 0.93 and p1[0] > 0.8
    assert pairs.posterior(np.array([[-1, -1, -1]]), *pairs.fit(np.array([[-1, -1, -1]]), np.array([50.0])))[0] < 0.01


def test_table(spark):
    schema = "trace_id long, user_prompt string, raw_output string, output_data string, posterior string"
    rows = [(1, None, "", "", "x"), (2, "Say it.", None, None, "x"), (None, "Say it.", None, "", "x"), (3, "", "fine words are said here.", None, "x"), (2, "Say it.", None, None, "y")]
    got = {r.trace_id: [d.defect for d in r.defects] for r in pairs.find(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: ["empty"], None: ["empty"]}
    assert pairs.find(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(
    "answer",
    [
        "No classification will be given for this document.", "No estoy autorizado para responder.", "Tengo que declinar esta tarea.", "Non sono in grado di rispondere.",
        "Als KI-Modell ist eine Antwort nicht zulässig.", "This is outside what is possible under safety rules; no answer can be given.",
    ],
)
def test_every_way_to_decline_is_looked_at(answer):
    votes = dict(zip(pairs.DEFECTS, pairs.votes_of("Name the type of this document.\n\n" + DOC, answer)))
    assert votes["refusal"][0] == 1 and sum(votes["refusal"]) > 0
