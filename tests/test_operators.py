"""Edge cases of the operators that the tables don't reach, by hand-made rows."""

import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.operators import checks, fields, model, personal, text, trace, vectors
from paperloom.plans import pipeline
from paperloom.sinks import reports
from paperloom.sources import files
from paperloom.streaming import documents as streaming


def one(spark, column, **values):
    """The value of a Column over one row of string columns."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(("value", "n"), [(None, (0, 0, 1)), ("", (0, 0, 1)), (" \n ", (3, 0, 2)), ("a b\nc", (5, 3, 2))])
def test_statistics(spark, value, n):
    df = spark.createDataFrame([(value,)], "t string")
    assert tuple(df.select(*text.statistics(F.col("t"))).first()) == n


def test_excerpt_and_strides(spark):
    long = "".join(chr(97 + i % 26) for i in range(13_000))
    assert one(spark, text.excerpt(F.col("t")), t=long) == long[:300] + "\n...\n" + long[-300:]
    assert one(spark, text.excerpt(F.col("t")), t="x" * 600) == "x" * 600
    pieces = one(spark, text.strides(F.col("t")), t=long)
    assert pieces == [long[i : i + 6000] for i in (0, 5500, 11000)]
    assert one(spark, text.strides(F.col("t")), t="") == []


def test_assemble(spark):
    join = lambda *p: one(spark, text.assemble(F.split("t", "#")), t="#".join(p))
    assert join(" only ") == "only"
    assert join("a", "  ", "b") == "--- Page/Section 1 ---\na\n\n--- Page/Section 3 ---\nb"


@pytest.mark.parametrize(
    ("kind", "value", "ok"),
    [
        ("EMAIL", "a@b.co", True), ("EMAIL", "a@b.c", False), ("NAME", "J", False), ("NAME", "Jo", True), ("NAME", "Invoice", False), ("NAME", "shop.com", False), ("SSN", "12345678", False), ("SSN", "123-45-6789", True),
        ("SSN", "1234 5678 9012", True), ("SSN", "1234567890123", False), ("PHONE", "123456789", False), ("PHONE", "2125550100", True), ("PHONE", "1234567890", False), ("PHONE", "1234567890123456", False),
        ("ADDRESS", "12 Elm St", True), ("ADDRESS", "Elmwoods", False), ("DATE_OF_BIRTH", "1/2/1990", True), ("DATE_OF_BIRTH", "tomorrow", False), ("MEDICAL_ID", "MRN1", True), ("MEDICAL_ID", "x" * 26, False),
        ("CREDIT_CARD", "4111111111111111", True), ("TAX_ID", "ABCDE1234F", True), ("GENDER", "Female", True), ("OTHER", "thing", True), ("NAME", "###a", False), ("NAME", None, False), (None, "x y", True),
    ],
)
def test_plausible(spark, kind, value, ok):
    assert one(spark, personal.plausible(F.col("k"), F.col("v"), F.lit(0.7)), k=kind, v=value) is ok


def test_redaction_is_longest_first_and_idempotent(spark):
    marks = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(l).alias("label"), F.lit(i).alias("seq")) for i, (v, l) in enumerate([("John", "[A]"), ("John Smith", "[B]"), ("absent", "[C]"), ("Jane", "[D]"), ("", "[E]")])])
    once = one(spark, personal.redact(F.col("t"), marks), t="John Smith and John, Jane.")
    assert once == "[B] and [A], [D]."
    assert one(spark, personal.redact(F.col("t"), marks), t=once) == once


@pytest.mark.parametrize(("d", "r", "p", "q"), [([], [], 1.0, 1.0), ([], ["a"], 0.0, 0.0), (["a"], [], 0.0, 1.0), (["A ", "b"], ["a", "c"], 0.5, 0.5), (["a", "a"], ["a"], 1.0, 1.0)])
def test_precision_recall(spark, d, r, p, q):
    df = spark.createDataFrame([(d, r)], "d array<string>, r array<string>")
    row = df.select(*personal.precision_recall(F.col("d"), F.col("r"))).first()
    assert (row.precision, row.recall) == (p, q)


@pytest.mark.parametrize(("v", "c"), [("Dr. Smith, Jane", "Jane Smith"), ("Patient: Ann  Lee", "Ann Lee"), ("Jo Roe, M.D.", "Jo Roe"), ("  ", "")])
def test_name_canonical(spark, v, c):
    assert one(spark, personal.name_canonical(F.col("t")), t=v) == c


@pytest.mark.parametrize(
    ("v", "iso"),
    [("2025-03-04", "2025-03-04"), ("03/04/2025", "2025-03-04"), ("13/05/2025", "2025-05-13"), ("2025/3/4", "2025-03-04"), ("March 4, 2025", "2025-03-04"), ("Mar 4 2025", "2025-03-04"), ("4 March 2025", "2025-03-04"), ("2025-03-04T01:02:03", "2025-03-04"), ("4 March 2025 x", "4 March 2025 x"), (" no ", "no"), (None, None)],
)
def test_iso_date(spark, v, iso):
    assert one(spark, fields.iso_date(F.col("t")), t=v) == iso


def test_aliases(spark):
    rows = spark.createDataFrame([(1, 0, "company", '"A"'), (1, 1, "employer", '""'), (1, 2, "company_name", "null"), (1, 3, "own", "[]")], "k int, pos int, field string, value string")
    assert {(r.field, r.value) for r in fields.resolve_aliases(rows, "k").collect()} == {("company_name", '"A"'), ("own", "[]")}
    filled = {(r.field, r.value) for r in fields.fill_from_aliases(rows, "k").collect()}
    assert ("company_name", '"A"') in filled and ("company", '"A"') in filled and ("own", "[]") in filled


def test_merge_chunks(spark):
    rows = [(1, 0, "a", "[1]"), (1, 1, "a", "[1,2]"), (1, 0, "b", '"x"'), (1, 1, "b", "null"), (1, 0, "c", "[1]"), (1, 1, "c", "3"), (1, 0, "d", "3"), (1, 1, "d", "[4]"), (1, 2, "d", "[]"), (1, 0, "e", None)]
    df = spark.createDataFrame(rows, "k int, chunk_no int, field string, value string")
    assert {(r.field, r.value) for r in fields.merge_chunks(df, "k").collect()} == {("a", "[1,1,2]"), ("b", '"x"'), ("c", "3"), ("d", "[4]")}


@pytest.mark.parametrize(("v", "out"), [('{"a":1}', '{"a":1}'), ('x ```json\n{"a":1}\n``` y', '{"a":1}'), ("```\n[1]\n```", "[1]"), ("no", None), ('```json\n{"a":', None), (None, None)])
def test_unfenced(spark, v, out):
    assert one(spark, fields.unfenced(F.col("t")), t=v) == out


@pytest.mark.parametrize(("v", "seen"), [("null", 6), ('""', 6), ('" n/a "', 2), ('"unknown"', 2), ("[]", 4), ("{}", 3), ('"x"', 0), (None, 6)])
def test_missing_presets_differ(spark, v, seen):
    df = spark.createDataFrame([(v,)], "v string")
    assert sum(df.select(*[checks.is_missing(F.col("v"), **p).alias(n) for n, p in checks.MISSING.items()]).first()) == seen


def test_format_rules_by_first_name_match(spark):
    rule = lambda f, v: one(spark, checks.format_error(F.col("f"), F.col("v")), f=f, v=v)
    assert rule("email", '"no"') == "email" and rule("contact_phone", '"123"') == "phone" and rule("birth_date", '"soon"') == "date" and rule("total_amount", '"lots"') == "amount" and rule("ssn", '"1"') == "ssn"
    assert rule("email", "null") is None and rule("salary", '{"base":1}') is None and rule("total_amount", "12.5") is None and rule("other", '"x"') is None


def test_completeness_and_profiles(spark):
    rows = spark.createDataFrame([(1, "total_amount", "5"), (1, "issuer_name", '"x"'), (1, "odd", "1"), (1, "due_date", "null")], "k int, field string, value string")
    docs = spark.createDataFrame([(1, "financial_document"), (2, None)], "k int, t string")
    got = {r.k: r for r in checks.completeness(rows, docs, "k", "t").collect()}
    assert (got[1].required, got[1].filled, got[1].schema_filled, got[1].extra) == (5, 2, 2, 1) and got[1].reported_accuracy == pytest.approx(2 / 3)
    assert (got[2].required, got[2].filled, got[2].reported_accuracy) == (3, 0, 0.0)
    current = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "key string, created int, updated int")
    incoming = spark.createDataFrame([("b", 5, 5), ("c", 5, 5)], "key string, created int, updated int")
    assert sorted(map(tuple, checks.upsert(current, incoming, "key", "created", "updated").collect())) == [("a", 1, 1), ("b", 1, 5), ("c", 5, 5)]


@pytest.mark.parametrize(("v", "s"), [("try again in 1m2.5s", 62.5), ("Retry after 7s", 7.0), ("try again in 250ms", 0.25), ("try again in 2m", 120.0), ("no hint", None), (None, None)])
def test_retry_after(spark, v, s):
    assert one(spark, trace.retry_after_s(F.col("t")), t=v) == s


def test_hash_embedding_buckets(spark):
    assert one(spark, vectors.bucket(F.col("t")), t="validation") == 240
    df = spark.createDataFrame([(1, "a A b"), (2, "..."), (3, None)], "k int, t string")
    rows = vectors.hash_embedding(df, "k", "t").collect()
    assert {r.k for r in rows} == {1} and sum(r.weight**2 for r in rows) == pytest.approx(1.0)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_in_blocks_equals_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (60, 5)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(99, None)], "id long, v array<double>")
    got = {(r.query_id, r.rank): r.neighbour for r in vectors.nearest(df, "id", "v", df.where("id % 7 = 0"), 4, metric, block_bytes=120).collect()}
    for q in range(0, 60, 7):
        d = ((x - x[q]) ** 2).sum(1) if metric == "l2" else 1 - x @ x[q] / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(x[q]), 1e-300)
        assert [got[q, k + 1] for k in range(4)] == np.lexsort((np.arange(60), np.round(d, 9)))[:4].tolist()


def test_model_seam_replays_and_never_invents(spark):
    responses = spark.createDataFrame([("k1", '```json\n{"a":1}\n```', 1, 2, 1), ("k1", "old", 1, 2, 0)], "cache_key string, content string, tokens_in int, tokens_out int, created_at int")
    asks = spark.createDataFrame([(1, "k1"), (2, "k1"), (3, "k2")], "id int, k string")
    got = {r.id: r for r in model.ask(asks, F.col("k"), F.lit("p"), model.Recorded(responses)).collect()}
    assert got[1].answer_json == got[2].answer_json == '{"a":1}' and got[3].answer is None and got[3].answer_error == "no recorded answer"


def test_cache_key_tells_null_from_empty(spark):
    keys = [one(spark, trace.cache_key(F.col("a"), F.col("b")), a=a, b=b) for a, b in ((None, ""), ("", None), ("", ""), (None, None))]
    assert len(set(keys)) == 4


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("naïve".encode("latin-1"))
    (tmp_path / "b.HTML").write_text("<html><head><title>t</title></head><body><p>One &amp; two</p><script>x()</script><p>three</p></body></html>")
    (tmp_path / "c.csv").write_text('x,y\n1,"two\nlines"\n3,4\n')
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "f.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="u"><w:p><w:r><w:t>Hello </w:t><w:t>there</w:t></w:r></w:p><w:p><w:r><w:t>again</w:t></w:r></w:p></w:document>')
    with zipfile.ZipFile(tmp_path / "g.pptx", "w") as z:
        for n in (10, 2, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<s xmlns:a="u"><a:p><a:t>slide {n}</a:t></a:p></s>')
    with zipfile.ZipFile(tmp_path / "h.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="u"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="u"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    pages = files.read_pages(spark, str(tmp_path))
    docs = {r.path.rsplit("/", 1)[-1]: r for r in files.documents(pages).collect()}
    assert docs["a.txt"].text == "naïve" and docs["b.HTML"].text == "One & two\nthree" and docs["f.docx"].text == "Hello there\nagain" and docs["h.xlsx"].text == "name\t5"
    assert docs["c.csv"].text == "--- Page/Section 1 ---\nx: 1\ny: two\nlines\n\n--- Page/Section 2 ---\nx: 3\ny: 4"
    assert docs["g.pptx"].text.split("\n\n")[2].endswith("slide 10")
    assert "no reader for pdf" in docs["d.pdf"].error and "BadZipFile" in docs["e.docx"].error


def test_reports_and_recent(spark, tmp_path):
    runs = spark.createDataFrame([("f", True, 0.95, ["a", "b"]), ("g", None, None, None)], "file_path string, success boolean, current_accuracy double, errors array<string>")
    reports.batch_report(runs, str(tmp_path / "batch"))
    assert spark.read.json(str(tmp_path / "batch/summary")).first().mean_accuracy == 0.95
    assert {r.errors for r in spark.read.csv(str(tmp_path / "batch/files"), header=True).collect()} == {"a; b", None}
    (tmp_path / "reports").mkdir()
    for i in range(12):
        (tmp_path / f"reports/{i}.json").write_text("{}")
    assert files.recent_reports(spark, str(tmp_path / "reports")).count() == 10
    (tmp_path / "p.json").write_text('[{"doc_type":"x","required_fields":["a"],"json_schema":{"type":"object"},"notes":null}]')
    assert files.schema_entries(spark, str(tmp_path / "p.json")).first().required_fields == ["a"]
    reports.profile_snapshot(runs, str(tmp_path / "profiles"), 1)
    with pytest.raises(Exception, match="(?i)exist"):
        reports.profile_snapshot(runs, str(tmp_path / "profiles"), 1)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "write to a.b@shop.example now"), (2, None)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = streaming.redacted(streaming.read_landing(spark, str(tmp_path / "in"), "doc_id long, text string"))
    streaming.for_each_batch(stream, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/{epoch}"), str(tmp_path / "cp")).awaitTermination()
    got = {r.doc_id: r.text for r in spark.read.parquet(f"{out}/*").collect()}
    assert got == {1: "write to [EMAIL_ADDRESS_REDACTED] now", 2: None}
    steps = spark.createDataFrame([(1, "2025-01-01 00:10:00", "a", 1.0, False), (1, "2025-01-01 00:10:00", "a", 1.0, False), (2, "2025-01-01 05:00:00", "a", 3.0, True)], "trace_id long, ts string, agent_name string, latency_ms double, error_occurred boolean")
    steps.withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "trace"))
    windows = streaming.latency_windows(streaming.read_landing(spark, str(tmp_path / "trace"), "trace_id long, ts timestamp, agent_name string, latency_ms double, error_occurred boolean"))
    windows.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r.steps, r.errors) for r in spark.sql("select * from w").collect()] in ([(1, 0)], [(1, 0), (1, 1)])


def test_pipeline(spark):
    rows = [(1, "mail a.b@c.example", '{"total_amount": "lots", "issuer_name": "x"}', "financial_document"), (2, None, None, None), (1, "mail a.b@c.example", '{"total_amount": "lots", "issuer_name": "x"}', "financial_document")]
    got = {r.k: r for r in pipeline.run(spark.createDataFrame(rows, "k int, body string, j string, t string"), "k", "body", "j", "t").collect()}
    assert (got[1].pii_count, got[1].format_errors, got[1].filled, got[1].redacted) == (1, 1, 2, "mail [EMAIL_ADDRESS_REDACTED]")
    assert (got[2].redacted, got[2].filled, got[2].words) == (None, 0, 0)


def test_exact_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 500)] + [(None, float(x)) for x in rng.exponential(900, 301)] + [("one", 3.5), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r.k: r.x for r in trace.exact_percentile(df, ["k"], "v", p, "x").collect()}
        want = {k: np.quantile([v for j, v in rows if j == k and v is not None], p) for k in ("a", None, "one")}
        assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_newest_and_oldest(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), (None, 1, 1)], "k string, id int, t int")
    assert {(r.k, r.id) for r in fields.newest(df, ["k"], ["t", "id"]).collect()} == {("a", 2), (None, 1)}
    assert {(r.k, r.id) for r in fields.oldest(df, ["k"], ["t", "id"]).collect()} == {("a", 1), (None, 1)}


def test_merging_detections(spark):
    df = spark.createDataFrame([([("John Smith", "B"), ("a@b.c", "E")], [("john smith", "X"), ("John", "X"), ("Mr John Smith", "X"), ("new", "X")])], "b array<struct<value:string,label:string>>, e array<struct<value:string,label:string>>")
    assert [tuple(x) for x in df.select(personal.merged(F.col("b"), F.col("e"))).first()[0]] == [("a@b.c", "E"), ("Mr John Smith", "X"), ("new", "X")]
    forms = spark.createDataFrame([([("phone", "2125550100", "P"), ("name", "Smith, Jo", "N"), ("name", "Jo Smith", "N"), ("date", "x", "D")],)], "d array<struct<kind:string,value:string,label:string>>")
    assert [x.value for x in forms.select(personal.with_canonical_forms(F.col("d"))).first()[0]] == ["2125550100", "Smith, Jo", "Jo Smith", "x", "(212) 555-0100"]


@pytest.mark.parametrize(("label", "kind"), [("resume", "resume"), (" CV ", "resume"), ("tax invoice 2024", "financial_document"), ("dipl", "academic"), ("x", "unknown"), ("", "unknown"), (None, "unknown"), ("agreement", "unknown")])
def test_normalise_type(spark, label, kind):
    assert one(spark, fields.normalise_type(F.col("t")), t=label) == kind


def test_schemas(spark):
    from paperloom.operators import schemas

    df = spark.createDataFrame([(1, '{"properties":{"a":{"type":"integer"},"b":{"type":["string","null"]},"c":{}}}'), (2, '{"properties":{"a":{"type":"number"}}}'), (3, "broken"), (4, None)], "n int, s string")
    props = schemas.properties(df, "n", "s").withColumn("g", F.lit("t"))
    schema = schemas.merged(props, "g", F.col("n"))
    assert {r.property: r.types for r in schema.collect()} == {"a": ["null", "number"], "b": ["null", "string"], "c": ["null"]}
    rows = spark.createDataFrame([(1, "t", "a", "5"), (1, "t", "b", "7"), (2, "t", "a", '"x"'), (2, "t", "z", "1"), (2, "t", "b", "null")], "k int, g string, field string, value string")
    assert sorted(tuple(r) for r in schemas.errors(rows, "k", "g", schema).collect()) == [(1, "b", "type"), (2, "a", "type")]
    required = spark.createDataFrame([("t", "a"), ("t", "z")], "g string, property string")
    assert [tuple(r) for r in schemas.missing_required(rows, "k", "g", required).collect()] == [(1, "z", "required")]


HOSTILE = ["a@" * 20_000, "a." * 20_000 + "@b", "x@" + "a." * 20_000, "1 " * 20_000, "[" * 50_000, '{"a":' * 5_000, '"' * 40_000, "```" * 10_000, "\n" * 50_000, "1:" * 20_000, "Jan " * 10_000, "12 Elm St\n" * 5_000, "é" * 50_000]


@pytest.mark.parametrize("n", range(len(HOSTILE)))
def test_hostile_texts_end_and_do_not_fail(spark, n):
    from paperloom.functions import instants
    from paperloom.operators import nested

    t = F.col("t")
    df = spark.createDataFrame([(HOSTILE[n],)], "t string")
    columns = [personal.recognised(t), personal.multiline_addresses(t), personal.gender_hits(t), personal.plausible(F.lit("EMAIL"), t, F.lit(0.1)), fields.unfenced(t), fields.iso_date(t), text.normalised(t), text.strides(t), nested.node_array(t)]
    df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).write.format("noop").mode("overwrite").save()
    df.select(instants.epoch_us(t, F.lit(None).cast("string"), F.lit("UTC"), ["UTC"]).alias("e")).collect()


def test_alias_table_is_whole():
    assert len(C.ALIASES) == 107 and len(set(C.ALIASES.values())) == 38 and C.ALIASES["valid_until"] == "expiration_date"
