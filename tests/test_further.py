"""Natural chunks, JSON repair, detectors, checks and aliases on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks, fields, personal, pieces, schemas, text, trace
from paperloom.session import cut


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_natural_chunks():
    assert pieces.natural_chunks("aaa bbb ccc ddd eee fff", 11, 4) == ["aaa bbb ccc", "ccc ddd eee", "eee fff"]
    assert pieces.natural_chunks("one two\n\nthree four\n\nfive", 12, 0) == ["one two", "three four", "five"]
    assert pieces.natural_chunks("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5] and pieces.natural_chunks(" \n", 10, 2) == [] and pieces.natural_chunks(None) == []
    rng = random.Random(1)
    for _ in range(200):
        whole = "".join(rng.choice(["word ", "x" * rng.randrange(1, 30), "\n", "\n\n", " "]) for _ in range(rng.randrange(0, 60)))
        found = pieces.natural_chunks(whole, 50, 12)
        assert all(len(p) <= 50 for p in found)
        bare = "".join(whole.split())
        assert all("".join(p.split()) in bare for p in found)
        assert not bare or bare.startswith("".join(found[0].split())) and bare.endswith("".join(found[-1].split()))


def test_chunk_table(spark):
    df = spark.createDataFrame([(1, "a b " * 5000, "x"), (2, None, "x"), (None, "short", "x"), (3, "", "x")], "run_id long, body string, chunk string")
    rows = pieces.exploded_chunks(df, "run_id", "body").collect()
    assert {r.run_id for r in rows} == {1, None} and [r.chunk_no for r in rows if r.run_id == 1] == [0, 1, 2, 3] and max(len(r.chunk) for r in rows) <= 6000
    assert pieces.exploded_chunks(df.limit(0), "run_id", "body").count() == 0


@pytest.mark.parametrize(
    ("broken", "want"),
    [
        ('{"a": [1, 2, {"b": "x y', {"a": [1, 2, {"b": "x y"}]}), ('Sure:\n```json\n{"a": 1,}\n``` done', {"a": 1}), ("{'a': 'it\\'s', 'c': [1, 2,],}", {"a": "it's", "c": [1, 2]}), ('{"a": 1, "b', {"a": 1}), ('{"a": 1, "b":', {"a": 1}),
        ('{"a": tru', {}), ("no json", None), (None, None), ("[[", [[]]), ('{"a": "line\nbreak"}', {"a": "line\nbreak"}), ('{"a": 1}}} more', {"a": 1}), ("}", None),
    ],
)
def test_json_repair(broken, want):
    got = pieces.repaired_json(broken)
    assert (None if got is None else json.loads(got)) == want


def test_every_beginning_of_json_is_repaired():
    doc = {"a": [1, 2.5, {"b": 'x "q" é\n', "c": None}], "d": {"e": [True, False, []], "f": "y,]}"}, "g": -3e5}
    full = json.dumps(doc)
    for n in range(1, len(full) + 1):
        json.loads(pieces.repaired_json(full[:n]))
    assert json.loads(pieces.repaired_json(full)) == doc


def test_detectors(spark):
    body = "PAN card ABCDE1234F and\nABCDE9999F\nSex: F\nMale\nMRN: MRN-12345\nLab ID: LAB-777777\nMRN: LAB-4444\nLab ID: MRN-4444\n12 Oak Street\nSpringfield, il 62704\n"
    got = {(d.entity, d.value, round(d.score, 2)) for d in one(spark, personal.detections(F.col("t")), t=body)}
    assert got == {("IN_PAN", "ABCDE1234F", 1.0), ("IN_PAN", "ABCDE9999F", 1.0), ("GENDER", "F\n", 0.98), ("GENDER", "Male", 0.98), ("MEDICAL_ID", "MRN-12345", 0.95), ("MEDICAL_ID", "LAB-777777", 0.95), ("ADDRESS", "12 Oak Street, Springfield, IL 62704", 0.9)}
    far = "x" * 60
    assert [round(d.score, 2) for d in one(spark, personal.detections(F.col("t")), t=f"pan {far} ABCDE1234F")] == [0.9]
    assert one(spark, personal.detections(F.col("t")), t="Gender: male")[0].value == "male" and one(spark, personal.detections(F.col("t")), t=None) is None
    assert one(spark, personal.entity_type(F.col("t")), t="PL_PESEL") == "ssn" and one(spark, personal.entity_type(F.col("t")), t="CRYPTO") == "credit_card"
    assert one(spark, F.size(personal.confident(F.transform("t", lambda v: F.struct(v.cast("double").alias("score"))))), t=["0.1", "0.2", "0.9"]) == 2


def test_values_of_personal_fields(spark):
    doc = {"Candidate_Name": " Ann  Lee ", "skills": ["x"], "contact": {"email": "A@b.c", "other": 'say "name":"no"'}, "names": ["Bo", "Cy"], "total": "5", "people": [{"phone": "1"}], "dob": None}
    assert sorted(one(spark, personal.personal_values(F.col("t")), t=json.dumps(doc))) == sorted(["ann lee", "a@b.c", "bo", "cy", "1"])
    assert one(spark, personal.personal_values(F.col("t")), t="{broken") == [] and one(spark, personal.personal_values(F.col("t")), t=None) == []


def test_expanded_address(spark):
    body = "To\n 12  Oak Street \n\nSpringfield, IL 62704\nend"
    assert one(spark, personal.expanded_address(F.col("t"), F.col("v")), t=body, v="12 oak") == "12 Oak Street, Springfield, IL 62704"
    assert one(spark, personal.expanded_address(F.col("t"), F.col("v")), t=body, v=" nowhere ") == "nowhere" and one(spark, personal.expanded_address(F.col("t"), F.col("v")), t=body, v="end") == "end"


def test_keys_and_values_as_text(spark):
    assert json.loads(one(spark, fields.snake_keys(F.col("t")), t='{"firstName": "GPA Total", "a": [{"totalAmount": "X:Y", "GPA": 1}]}')) == {"first_name": "GPA Total", "a": [{"total_amount": "X:Y", "g_p_a": 1}]}
    for value in ('"a \\"q\\""', "12", "true", "null", '[1,"x"]', '{"a":1}'):
        assert json.loads(one(spark, fields.reread(fields.shown(F.col("t"))), t=value)) == json.loads(value)
    assert one(spark, fields.reread(F.col("t")), t="free text") == '"free text"'


def test_coercion_and_alias_sources(spark):
    rows = spark.createDataFrame([(1, "email", '["", null, "a@b"]'), (1, "skills", '["x"]'), (1, "phone", "[]"), (1, "salary", "[5]"), (1, "mobile", '"7"'), (1, "contact_phone", '"8"')], "run_id long, field string, value string")
    assert {r.field: r.value for r in fields.coerced(rows).collect()} == {"email": '"a@b"', "skills": '["x"]', "phone": "[]", "salary": '"5"', "mobile": '"7"', "contact_phone": '"8"'}
    assert [tuple(r) for r in fields.from_aliases(rows, "run_id").collect()] == [(1, "phone", "contact_phone")]


def test_checks(spark):
    rows = [(1, "author", '"x"'), (1, "line_total", '["$5", "five"]'), (1, "tags", '["five"]'), (2, "a", '"n/a"'), (2, "email", '"no mail"')]
    docs = [(1, "academic", "text"), (2, "resume", None), (3, "letter", None), (4, None, None)]
    r, d = spark.createDataFrame(rows, "run_id long, field string, value string"), spark.createDataFrame(docs, "run_id long, doc_type string, body string")
    got = {x.run_id: x for x in checks.accuracy(r, d, "run_id", "doc_type", "body").collect()}
    assert (got[1].expected, got[1].filled, got[1].missing) == (4, 1, "title, isbn, publication_year") and got[2].expected == 5 and (got[3].expected, got[3].accuracy) == (0, 0.0) and got[4].accuracy == 0.0
    found = {x.run_id: x for x in checks.rule_findings(r, d, "run_id", "doc_type").collect()}
    assert found[1].format_errors == "line_total: amount" and found[1].amount == "sparse" and found[2].format_errors == "email: email" and found[2].missing == "candidate_name, phone" and found[4].amount == "insufficient"


def test_schemas(spark):
    props = [("a", "x", ["string"], False, 1), ("a", "y", ["string"], True, 1), ("a", "z", ["string"], False, 1), ("a", "z", ["number"], False, 2)]
    df = spark.createDataFrame(props, "slug string, property string, types array<string>, required boolean, n int")
    assert {r.property: r.types for r in schemas.merged(df, "slug", F.struct("n")).collect()} == {"x": ["null", "string"], "y": ["string"], "z": ["number"]}
    names = spark.createDataFrame([("a", 2, ["c", "a"]), ("a", 1, ["b", " ", None, "a"]), ("b", 1, None)], "slug string, n int, names array<string>")
    assert [tuple(r) for r in schemas.required_union(names, "slug", ["n"], "names").collect()] == [("a", ["b", "a", "c"])]


def test_views_of_runs(spark):
    steps = spark.createDataFrame([(1, 1, 1, "classifier"), (1, 2, 2, "validator"), (1, 3, 3, "self_repair"), (1, 4, 4, "validator"), (1, 5, 5, "validator"), (2, 1, 6, None), (2, 2, 7, "Own")], "run_id long, step int, trace_id long, agent_name string")
    got = {r.run_id: r for r in trace.diagrams(steps).collect()}
    assert got[1].flow.split("\n") == ["flowchart TD", "    START --> classify", "    classify --> validate", "    validate -.->|needs repair| repair", "    repair -.->|retry| validate", "    validate --> END"]
    assert "    participant unknown\n    participant own" in got[2].sequence and "    unknown->>+own: run" in got[2].sequence
    assert [r.no for r in trace.numbered(steps).where("run_id = 1").orderBy("no").collect()] == [1, 2, 3, 4, 5]


def test_recognised_pages(spark):
    blocks = spark.createDataFrame([("a", 2, "LINE", "second"), ("a", 1, "LINE", "first"), ("a", 3, "WORD", "first"), ("a", 4, "LINE", ""), ("b", 1, "PAGE", None)], "k string, block_no int, block_type string, text string")
    assert {r.k: r.text for r in text.lines_of_blocks(blocks, "k").collect()} == {"a": "first\nsecond", "b": ""}
    tokens = spark.createDataFrame([("a", "x", 90.0), ("a", " ", -1.0), ("a", "y", 70.0), ("b", "", -1.0)], "k string, text string, conf double")
    assert {r.k: (r.word_count, r.avg_confidence) for r in text.recognition_statistics(tokens, "k").collect()} == {"a": (2, 80.0), "b": (0, 0.0)}


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://somewhere"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815
        getConf = staticmethod(dict)  # noqa: N815

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context})  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(Frame())
