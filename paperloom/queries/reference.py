"""Queries over whole tables for the operators of text, personal data, fields, checks, trace and vectors, each with the
SQL that gives the same rows in DuckDB where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.operators import checks, fields, personal, schemas, text, trace, vectors
from paperloom.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _values(pairs: dict[str, object]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in pairs.items())


# --- text -----------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE left(text, 300) || chr(10) || '...' || chr(10) || right(text, 300) END AS excerpt FROM documents")
def excerpt_head_tail(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


@query(r"""SELECT doc_id, length(coalesce(text, '')) AS chars, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\f\r]+'), lambda w: w <> '')) AS words,
len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS lines FROM documents""")
def text_stats(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", *text.statistics(F.col("text")))


@query(r"SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\n\f\r]+', ' ', 'g'), ' ')) AS plain FROM documents")
def normalised_text(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", text.normalised(F.col("text")).alias("plain"))


@query("""SELECT run_id, i AS chunk_no, substring(raw_text, CAST(i AS BIGINT) * 5500 + 1, 6000) AS chunk FROM (SELECT DISTINCT run_id, raw_text FROM document_state WHERE length(raw_text) > 0) d,
LATERAL (SELECT unnest(generate_series(0, greatest(0, CAST(ceil((length(d.raw_text) - 6000) / 5500.0) AS BIGINT)))) AS i) s""")
def fixed_stride_chunks(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "document_state").select("run_id", "raw_text").distinct()
    return text.exploded_strides(runs, "run_id", "raw_text")


@query(r"""WITH s AS (SELECT DISTINCT ON (trace_id) * FROM trace_log), n AS (SELECT run_id, trace_id, step, trim(coalesce(output_data, ''), E' \t\n\f\r') AS t, row_number() OVER (PARTITION BY run_id ORDER BY step, trace_id) AS i, count(*) OVER (PARTITION BY run_id) AS c FROM s)
SELECT run_id, coalesce(string_agg(CASE WHEN c > 1 THEN '--- Page/Section ' || i || ' ---' || chr(10) || t ELSE t END, chr(10) || chr(10) ORDER BY i) FILTER (t <> ''), '') AS document FROM n GROUP BY run_id""")
def page_concat(spark: SparkSession, root: str) -> DataFrame:
    """The steps of a run as pages. A run has a few dozen steps at most, so its pages fit one row."""
    steps = trace.once(table(spark, root, "trace_log")).select("run_id", F.struct("step", "trace_id", F.coalesce("output_data", F.lit("")).alias("t")).alias("s"))
    pages = steps.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"]).alias("pages"))
    return pages.select("run_id", text.assemble(F.col("pages")).alias("document"))


@query(f"""WITH m(ext, kind) AS (VALUES {_values(C.FILE_TYPES)}) SELECT DISTINCT file_path, coalesce(kind, 'unknown') AS file_type FROM document_state
LEFT JOIN m ON regexp_extract(lower(file_path), '([.][^./]+)$', 1) = ext""")
def file_type_by_extension(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "document_state").select("file_path").distinct().select("file_path", text.file_type(F.col("file_path")).alias("file_type"))


_CAPPED = "list_filter(regexp_split_to_array(coalesce(raw_text, ''), '[ \\t\\n\\f\\r]+'), lambda w: w <> '')"


@query(f"SELECT DISTINCT run_id, array_to_string({_CAPPED}[1:1000], ' ') AS head, array_to_string({_CAPPED}[1:500], ' ') AS short_head FROM document_state")
def word_cap(spark: SparkSession, root: str) -> DataFrame:
    """The first words of each text, as many as a prompt takes of the text and of the fields."""
    rows = table(spark, root, "document_state").select("run_id", *[text.cap_words(F.col("raw_text"), n).alias(c) for c, n in (("head", C.CAP_WORDS), ("short_head", C.CAP_WORDS_FIELDS))])
    return rows.dropDuplicates(["run_id"])


# --- personal data --------------------------------------------------------------------------------------------------
_HITS = " UNION ALL ".join(
    f"SELECT document_id, '{e}' AS entity, unnest(regexp_extract_all(document_text, '(?:^|[^A-Za-z0-9_])({p})(?:[^A-Za-z0-9_]|$)', 1)) AS value FROM s" for e, p in C.RECOGNISERS
)


@query(f"""WITH s AS (SELECT DISTINCT document_id, document_text FROM sample_dataset), h AS ({_HITS}), m(entity, kind) AS (VALUES {_values(C.ENTITY_TYPES)})
SELECT document_id, h.entity, kind AS pii_type, value, '[' || h.entity || '_REDACTED]' AS label, count(*) AS n FROM h JOIN m ON h.entity = m.entity GROUP BY ALL""")
def pii_regex_detect(spark: SparkSession, root: str) -> DataFrame:
    body = F.col("document_text")
    found = F.when(body.rlike("[0-9@]"), personal.recognised(body))  # every recogniser has a digit or an "@"
    rows = table(spark, root, "sample_dataset").select("document_id", F.xxhash64(body).alias("_text"), found.alias("_hits")).where(F.size("_hits") > 0).distinct()
    hits = rows.select("document_id", F.inline("_hits"))
    return hits.groupBy("document_id", "entity", personal.entity_type(F.col("entity")).alias("pii_type"), "value", personal.label(F.col("entity")).alias("label")).agg(F.count("*").alias("n"))


_PLAUSIBLE = f"""CASE WHEN k = 'EMAIL' THEN regexp_matches(t, '^[^@\\s]+@[^@\\s]+[.][^@\\s]+$')
WHEN k = 'NAME' THEN NOT (contains(t, '.') AND regexp_matches(lower(t), '[.](com|net|org|edu|io|ai)$')) AND lower(t) NOT IN ({", ".join(f"'{w}'" for w in C.NON_NAMES)})
WHEN k IN ('DATE_TIME', 'DATE_OF_BIRTH') THEN regexp_matches(t, '(^|[^0-9A-Za-z_])[0-9]{{1,2}}[-/][0-9]{{1,2}}[-/][0-9]{{2,4}}([^0-9A-Za-z_]|$)')
 OR regexp_matches(lower(t), '(^|[^0-9a-z_])(january|february|march|april|may|june|july|august|september|october|november|december)\\s+[0-9]{{1,2}},?\\s+[0-9]{{4}}([^0-9a-z_]|$)') OR regexp_matches(t, '(^|[^0-9A-Za-z_])(19|20)[0-9]{{2}}([^0-9A-Za-z_]|$)')
WHEN k = 'ADDRESS' THEN contains(t, ' ') AND (length(d) > 0 OR list_any_value([{", ".join(f"CASE WHEN contains(lower(t), '{w}') THEN true END" for w in C.STREET_WORDS)}]) IS NOT NULL)
WHEN k = 'PHONE' THEN length(d) BETWEEN 10 AND 15 AND d NOT IN ({", ".join(f"'{w}'" for w in C.DUMMY_PHONES)})
WHEN k IN ('MEDICAL_ID', 'MEDICAL_LICENSE') THEN length(t) <= 25 WHEN k IN ('BANK_ACCOUNT', 'US_BANK_NUMBER', 'CREDIT_CARD') THEN length(d) BETWEEN 8 AND 19 WHEN k IN ('SSN', 'US_SSN') THEN length(d) IN (9, 12)
WHEN k IN ('TAX_ID', 'PAN', 'GSTIN') THEN regexp_matches(c, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') OR regexp_matches(c, '^[0-9]{{2}}[A-Z0-9]{{10}}[A-Z][0-9][A-Z]$') OR regexp_matches(c, '^[A-Z0-9]{{8,15}}$')
WHEN k = 'GENDER' THEN lower(t) IN ('male', 'female', 'm', 'f', 'other', 'non-binary', 'transgender') OR contains(lower(t), 'male') ELSE confidence >= 0.6 END"""


@query(f"""WITH g AS (SELECT DISTINCT run_id, unnest(ground_truth_pii) AS p FROM document_state), v AS (SELECT run_id, p.type AS type, p.value AS value, upper(trim(coalesce(p.type, ''), ' ')) AS k, trim(coalesce(p.value, ''), ' ') AS t FROM g),
m(kind, least) AS (VALUES {_values(C.MIN_LENGTHS)}), x AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS d, upper(regexp_replace(t, '[- ]', '', 'g')) AS c, 0.7 AS confidence FROM v LEFT JOIN m ON k = kind)
SELECT run_id, type, value, t <> '' AND length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) * 2 <= length(t) AND length(t) >= coalesce(least, 2) AND coalesce({_PLAUSIBLE}, false) AS plausible FROM x""")
def pii_validate_rules(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_state").select("run_id", F.explode("ground_truth_pii").alias("p")).select("run_id", "p.type", "p.value").distinct()
    return rows.withColumn("plausible", personal.plausible(F.col("type"), F.col("value"), F.lit(0.7)))


@query("""WITH d AS (SELECT DISTINCT ON (run_id) run_id, raw_text, list_transform(list_filter(coalesce(ground_truth_pii, []), lambda x: x.value <> ''), lambda x: {'v': x.value, 'l': '[' || upper(coalesce(x.type, 'name')) || '_REDACTED]'}) AS f FROM document_state WHERE raw_text IS NOT NULL),
o AS (SELECT run_id, raw_text, list_transform(list_sort(list_transform(f, lambda x, i: {'n': -length(x.v), 'i': i, 'v': x.v, 'l': x.l})), lambda x: {'o': x.v, 'r': x.l}) AS f FROM d)
SELECT run_id, list_reduce(f, lambda acc, x: {'o': replace(acc.o, x.o, x.r), 'r': ''}, {'o': raw_text, 'r': ''}).o AS redacted FROM o""")
def redact_longest_first(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "document_state").where("raw_text is not null").select("run_id", "raw_text", "ground_truth_pii").dropDuplicates(["run_id"])
    kept = F.filter(F.coalesce("ground_truth_pii", F.array().cast("array<struct<type:string,value:string>>")), lambda x: x["value"] != "")
    marks = F.transform(kept, lambda x, i: F.struct(x["value"].alias("value"), personal.label(F.coalesce(x["type"], F.lit("name"))).alias("label"), i.alias("seq")))
    return rows.select("run_id", personal.redact(F.col("raw_text"), marks).alias("redacted"))


_STREET = r"(?i)^[0-9]+[A-Za-z0-9_ .,#/-]*(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|place|pl|boulevard|blvd|plaza|parkway|pkwy|apt|apartment|suite|ste|unit)(?:[ .,#/-][A-Za-z0-9_ .,#/-]*)?$"
_TOWN = r"(?i)^([a-z .]+?),? ([a-z]{2}) ([0-9]{5}(?:-[0-9]{4})?)$"


def _detected(column: str) -> str:
    """SQL: key, entity, kind, value, source, score of all detectors over s(key, body)."""
    parts = []
    for e, p in C.RECOGNISERS:
        near = " OR ".join(f"contains(b, '{w}')" for w in C.CONTEXT.get(e, [])) or "false"
        parts.append(f"""SELECT key, '{e}' AS entity, '{C.ENTITY_TYPES[e]}' AS kind, value, 'pattern' AS source, least(1.0, {C.SCORES[e]} + CASE WHEN {near} THEN {C.CONTEXT_GAIN} ELSE 0 END)::DOUBLE AS score
FROM (SELECT key, value, substring(lower(body), greatest(1, instr(body, value) - {C.CONTEXT_REACH}), least({C.CONTEXT_REACH}, instr(body, value) - 1)) AS b FROM (SELECT key, body, unnest(regexp_extract_all(body, '(?:^|[^A-Za-z0-9_])({p})(?:[^A-Za-z0-9_]|$)', 1)) AS value FROM s))""")
    parts += [f"SELECT key, 'GENDER', 'gender', unnest(regexp_extract_all(body, '{p}', 1)), 'gender', 0.98 FROM s" for p in (C.GENDER_LABELLED, C.GENDER_ALONE)]
    parts += [f"SELECT key, 'MEDICAL_ID', 'medical_id', unnest(regexp_extract_all(body, '{p}', 1)), 'record', 0.95 FROM s" for p in C.RECORD_IDS]
    lines = "list_filter(list_transform(regexp_split_to_array(body, '\\r?\\n'), lambda x: trim(regexp_replace(x, '[ \\t\\f\\r]+', ' ', 'g'), ' ')), lambda x: x <> '')"
    parts.append(f"""SELECT key, 'ADDRESS', 'address', a || ', ' || trim(regexp_extract(t, '{_TOWN}', 1), ' ') || ', ' || upper(regexp_extract(t, '{_TOWN}', 2)) || ' ' || regexp_extract(t, '{_TOWN}', 3), 'address', 0.9
FROM (SELECT key, p[1] AS a, p[2] AS t FROM (SELECT key, unnest(list_zip(l, l[2:])) AS p FROM (SELECT key, {lines} AS l FROM s))) WHERE t IS NOT NULL AND regexp_matches(a, '{_STREET}') AND regexp_matches(t, '{_TOWN}')""")
    return " UNION ALL ".join(parts)


@query(f"""WITH s AS (SELECT DISTINCT document_id AS key, document_text AS body FROM sample_dataset), h AS ({_detected("document_text")})
SELECT key AS document_id, entity, kind, value, source, round(score, 6) AS score, count(*) AS n FROM h GROUP BY ALL""")
def detector_union(spark: SparkSession, root: str) -> DataFrame:
    """What all detectors find in each text: recognisers with scores and context, gender, record numbers, addresses."""
    body = F.col("document_text")
    rows = table(spark, root, "sample_dataset").select("document_id", F.xxhash64(body).alias("_text"), personal.detections(body).alias("_hits")).where(F.size("_hits") > 0).distinct()
    hits = rows.select("document_id", F.inline("_hits"))
    return hits.groupBy("document_id", "entity", "kind", "value", "source", F.round("score", 6).alias("score")).agg(F.count("*").alias("n"))


_NORMAL = "lower(trim(regexp_replace({}, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' '))"
_WALKED = f"""w AS (SELECT run_id, list(DISTINCT v) AS v FROM (SELECT run_id, {_NORMAL.format("json_extract_string(atom, '$')")} AS v FROM (SELECT d.run_id, t.atom, t.type, lower(regexp_extract(regexp_replace(t.fullkey, '(\\[[0-9]+\\])+$', ''), '([^.]+)$', 1)) AS name
FROM (SELECT DISTINCT run_id, extracted_fields FROM document_state WHERE json_valid(extracted_fields)) d, json_tree(d.extracted_fields) t) WHERE type = 'VARCHAR' AND ({" OR ".join(f"contains(name, '{f}')" for f in C.PERSONAL_FIELDS)})) WHERE v <> '' GROUP BY run_id)"""


@query(f"WITH {_WALKED} SELECT run_id, unnest(v) AS value FROM w")
def personal_field_values(spark: SparkSession, root: str) -> DataFrame:
    """The values of fields, at any depth, whose names say that they are personal data."""
    rows = table(spark, root, "document_state").select("run_id", F.explode(personal.personal_values(F.col("extracted_fields"))).alias("value"))
    return rows.distinct()


_SCORED = f"""s AS (SELECT DISTINCT ON (run_id) run_id AS key, raw_text AS body FROM document_state), h AS ({_detected("raw_text")}), {_WALKED},
f AS (SELECT key, list(DISTINCT v) AS f FROM (SELECT key, {_NORMAL.format("value")} AS v FROM h) WHERE v <> '' GROUP BY key),
g AS (SELECT DISTINCT ON (run_id) run_id, list_distinct(list_filter(list_transform(coalesce(ground_truth_pii, []), lambda x: {_NORMAL.format("x.value")}), lambda v: v <> '')) AS g FROM document_state),
c AS (SELECT g.run_id, len(list_intersect(coalesce(f, []), t)) AS true_positives, len(coalesce(f, [])) AS detected, len(t) AS expected FROM (SELECT g.run_id, CASE WHEN len(g) > 0 THEN g ELSE coalesce(v, []) END AS t FROM g LEFT JOIN w ON w.run_id = g.run_id) g LEFT JOIN f ON f.key = g.run_id)"""


def _scored(spark: SparkSession, root: str) -> DataFrame:
    """Counts of each run over all types of personal data; what is expected are the labels, else the fields' values."""
    rows = table(spark, root, "document_state").select("run_id", "raw_text", "ground_truth_pii", "extracted_fields")
    found = F.transform(personal.detections(F.col("raw_text")), lambda h: h["value"])
    labels = F.filter(F.transform("ground_truth_pii", lambda x: text.normalised(x["value"])), lambda v: v.isNotNull() & (v != ""))
    truth = F.when(F.size(labels) > 0, labels).otherwise(personal.personal_values(F.col("extracted_fields")))
    sets = rows.select("run_id", F.array_distinct(found).alias("_found"), truth.alias("_truth")).dropDuplicates(["run_id"])  # found once, then counted
    return sets.select("run_id", *personal.precision_recall(F.col("_found"), F.col("_truth")))


@query(f"WITH {_SCORED} SELECT *, CASE WHEN detected > 0 THEN true_positives / detected WHEN expected = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision, CASE WHEN expected > 0 THEN true_positives / expected ELSE 1.0 END::DOUBLE AS recall FROM c")
def pii_precision_recall(spark: SparkSession, root: str) -> DataFrame:
    return _scored(spark, root)


@query(f"""WITH {_SCORED}, a AS (SELECT coalesce(sum(true_positives), 0)::BIGINT AS true_positives, coalesce(sum(detected), 0)::BIGINT AS detected, coalesce(sum(expected), 0)::BIGINT AS expected FROM c)
SELECT *, CASE WHEN detected > 0 THEN true_positives / detected ELSE 1.0 END::DOUBLE AS precision, CASE WHEN expected > 0 THEN true_positives / expected ELSE 1.0 END::DOUBLE AS recall FROM a""")
def pii_micro_average(spark: SparkSession, root: str) -> DataFrame:
    return personal.micro_average(_scored(spark, root))


@query(r"""WITH p AS (SELECT DISTINCT unnest(['(212) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0'), '1 212 555 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0'), '1-800-' || c_mktsegment || ' (' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || ')', ' ext. ' || c_custkey || ' ']) AS value FROM customer),
k AS (SELECT value, regexp_replace(translate(upper(CASE WHEN regexp_matches(value, '[A-Za-z]') THEN regexp_replace(value, '\s*\([0-9]{3,}\)\s*$', '') ELSE value END), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '22233344455566677778889999'), '[^0-9]', '', 'g') AS d FROM p)
SELECT value, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN '1-' || d[2:4] || '-' || d[5:7] || '-' || d[8:11] WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE trim(value, ' ') END AS canonical FROM k""")
def phone_canonical(spark: SparkSession, root: str) -> DataFrame:
    """Numbers written from the customers: plain, with country code, with keypad letters and an extension, too short."""
    key, last = F.col("c_custkey"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    numbers = [
        F.concat(F.lit("(212) 555-"), last), F.concat(F.lit("1 212 555 "), last), F.concat(F.lit(" ext. "), key.cast("string"), F.lit(" ")),
        F.concat(F.lit("1-800-"), F.col("c_mktsegment"), F.lit(" ("), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(")")),
    ]
    values = table(spark, root, "customer").select(F.explode(F.array(*numbers)).alias("value")).distinct()
    return values.select("value", personal.phone_canonical(F.col("value")).alias("canonical"))


@query(r"""WITH p AS (SELECT DISTINCT candidate_name AS value FROM job_offer_fields WHERE candidate_name IS NOT NULL), a AS (SELECT value, regexp_replace(trim(value, ' '), '(?i)^(?:name|patient|provider|physician|doctor|contact)\s*:\s*', '') AS t FROM p),
b AS (SELECT value, regexp_replace(t, '(?i)^(?:dr[.]?|mr[.]?|mrs[.]?|ms[.]?|prof[.]?)\s+', '') AS t FROM a), c AS (SELECT value, regexp_replace(t, '(?i),?\s*(?:\bm[.]?d[.]?|\bph[.]?d[.]?|\bfcap|\bdean|\bpresident|\bvice chancellor)(?:[^A-Za-z0-9_].*)?$', '') AS t FROM b),
e AS (SELECT value, regexp_replace(t, '^([^,]+?)\s*,\s*(.+)$', '\2 \1') AS t FROM c) SELECT value, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS canonical FROM e""")
def name_canonical(spark: SparkSession, root: str) -> DataFrame:
    values = table(spark, root, "job_offer_fields").where("candidate_name is not null").select(F.col("candidate_name").alias("value")).distinct()
    return values.select("value", personal.name_canonical(F.col("value")).alias("canonical"))


@query(r"""WITH h AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(raw_text, '(?:[+]|00)?[0-9(][0-9() .-]{7,18}[0-9]')) AS v FROM document_state WHERE raw_text IS NOT NULL), k AS (SELECT run_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM h)
SELECT run_id, v AS value, CASE WHEN length(d) = 11 AND d LIKE '1%' THEN '1-' || d[2:4] || '-' || d[5:7] || '-' || d[8:11] WHEN length(d) = 10 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE trim(v, ' ') END AS canonical FROM k""")
def phone_forms_in_texts(spark: SparkSession, root: str) -> DataFrame:
    """Whatever looks like a number of eight or more digits in the runs' texts, in its canonical form."""
    hits = F.regexp_extract_all("raw_text", F.lit(r"(?:[+]|00)?[0-9(][0-9() .-]{7,18}[0-9]"), 0)
    rows = table(spark, root, "document_state").select("run_id", F.explode(hits).alias("value")).distinct()
    return rows.select("run_id", "value", personal.phone_canonical(F.col("value")).alias("canonical"))


# --- fields ---------------------------------------------------------------------------------------------------------
_ENTRIES = "e AS (SELECT run_id, k AS field, json_extract(j, '$.\"' || k || '\"')::VARCHAR AS value FROM (SELECT DISTINCT run_id, extracted_fields AS j, unnest(json_keys(extracted_fields)) AS k FROM document_state WHERE json_valid(extracted_fields)))"
_KEY_CASE = "regexp_replace(regexp_replace(k, '([A-Z])', '_\\1', 'g'), '^_', '')"


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return fields.entries(table(spark, root, "document_state").select("run_id", "extracted_fields").distinct(), "run_id", "extracted_fields")


@query(f"WITH k AS (SELECT DISTINCT unnest(['firstName', 'GPA', 'totalAmount', 'already_snake', c_name || 'Id' || c_custkey]) AS k FROM customer) SELECT k AS field, lower({_KEY_CASE}) AS snake FROM k")
def camel_to_snake(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(F.lit("firstName"), F.lit("GPA"), F.lit("totalAmount"), F.lit("already_snake"), F.concat("c_name", F.lit("Id"), F.col("c_custkey").cast("string")))
    return table(spark, root, "customer").select(F.explode(names).alias("field")).distinct().select("field", fields.snake_case(F.col("field")).alias("snake"))


@query(r"""WITH d AS (SELECT DISTINCT document_date AS value, trim(document_date, ' ') AS t FROM financial_document_fields WHERE document_date IS NOT NULL) SELECT value, CASE WHEN regexp_matches(t, '^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(T[0-9:]+)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4})$')
THEN coalesce(strftime(try_strptime(t, ['%Y-%m-%d', '%m/%d/%Y', '%d/%m/%Y', '%Y/%m/%d', '%B %d, %Y', '%b %d, %Y', '%B %d %Y', '%b %d %Y', '%d %B %Y', '%d %b %Y', '%Y-%m-%dT%H:%M:%S']), '%Y-%m-%d'), t) ELSE t END AS iso FROM d""")
def date_normalise(spark: SparkSession, root: str) -> DataFrame:
    values = table(spark, root, "financial_document_fields").where("document_date is not null").select(F.col("document_date").alias("value")).distinct()
    return values.select("value", fields.iso_date(F.col("value")).alias("iso"))


@query(f"WITH {_ENTRIES} SELECT field, CASE WHEN value IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(value, '^-?[0-9]+([.]0+)?$') THEN 'integer' WHEN regexp_matches(value, '^-?[0-9.]+([eE][+-]?[0-9]+)?$') THEN 'number' WHEN value LIKE '{{%' THEN 'object' WHEN value LIKE '[%' THEN 'array' ELSE 'string' END AS kind, count(*) AS n FROM e GROUP BY ALL")
def json_type_inference(spark: SparkSession, root: str) -> DataFrame:
    return _entries(spark, root).groupBy("field", fields.json_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


_ALIAS = "a(alias, canonical) AS (VALUES " + _values(C.ALIASES) + ")"
_ORDER = "o(alias, n) AS (VALUES " + _values({a: i for i, a in enumerate(C.ALIASES)}) + ")"


@query(f"WITH {_ENTRIES}, {_ALIAS} SELECT coalesce(canonical, field) AS field, count(DISTINCT run_id) AS documents, count(*) AS names FROM e LEFT JOIN a ON field = alias GROUP BY 1")
def alias_coverage(spark: SparkSession, root: str) -> DataFrame:
    return _entries(spark, root).groupBy(fields.canonical_field(F.col("field")).alias("field")).agg(F.countDistinct("run_id").alias("documents"), F.count("*").alias("names"))


@query(f"""WITH {_ENTRIES}, {_ALIAS}, p AS (SELECT run_id, coalesce(canonical, field) AS f, value, field, row_number() OVER (PARTITION BY run_id ORDER BY field) AS pos FROM e LEFT JOIN a ON field = alias)
SELECT run_id, f AS field, arg_max(CASE WHEN value IN ('null', '""') THEN 'empty' ELSE 'filled' END, CASE WHEN value IN ('null', '""') THEN 0 ELSE 1000000 END + pos) AS state,
arg_max(CASE WHEN value LIKE '"%' THEN json_extract_string(value, '$') ELSE '' END, CASE WHEN value IN ('null', '""') THEN 0 ELSE 1000000 END + pos) AS text, count(*) AS names FROM p GROUP BY ALL""")
def alias_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Each canonical field after renaming: whether it is filled, its text if it is one, and from how many names."""
    rows = _entries(spark, root)
    names = rows.groupBy("run_id", fields.canonical_field(F.col("field")).alias("field")).agg(F.count("*").alias("names"))
    state = F.when(F.col("value").isin("null", '""'), "empty").otherwise("filled")
    return fields.resolve_aliases(rows, "run_id").join(names, ["run_id", "field"]).select("run_id", "field", state.alias("state"), F.coalesce(F.when(F.startswith("value", F.lit('"')), fields.shown(F.col("value"))), F.lit("")).alias("text"), "names")


@query(r"""WITH t AS (SELECT DISTINCT ON (trace_id) trace_id, raw_output AS r FROM trace_log WHERE raw_output IS NOT NULL), f AS (SELECT trace_id, r, regexp_extract(r, '```(?:json)?[ \t\r\n]*([\s\S]*?)[ \t\r\n]*```', 1) AS i FROM t),
j AS (SELECT trace_id, CASE WHEN json_valid(r) AND regexp_matches(r, '^\s*[{]') THEN r WHEN i <> '' AND json_valid(i) AND regexp_matches(i, '^\s*[{]') THEN i END AS j FROM f)
SELECT trace_id, j IS NOT NULL AS parsed, array_to_string(list_sort(json_keys(j)), ',') AS keys, json_extract_string(j, '$.doc_type') AS doc_type FROM j""")
def json_parse_fenced(spark: SparkSession, root: str) -> DataFrame:
    """Every answer: whether it is an object, as it stands or in a fence, with its keys and its type."""
    rows = table(spark, root, "trace_log").where("raw_output is not null").select("trace_id", fields.unfenced(F.col("raw_output")).alias("_json"))
    inner = F.when(F.col("_json").rlike(r"^\s*[{]"), F.col("_json"))
    keys = F.array_join(F.array_sort(F.json_object_keys(inner)), ",")
    return rows.select("trace_id", inner.isNotNull().alias("parsed"), keys.alias("keys"), F.get_json_object(inner, "$.doc_type").alias("doc_type")).dropDuplicates(["trace_id"])


# --- checks ---------------------------------------------------------------------------------------------------------
_TEXT = "lower(trim(regexp_replace(regexp_replace(value, '^\"', ''), '\"$', ''), ' '))"
_HOLDERS = ", ".join(f"'{p}'" for p in C.PLACEHOLDERS)


def _missing_sql(empty_list: bool = True, empty_object: bool = True, placeholders: bool = True) -> str:
    return f"(value IS NULL OR value = 'null' OR {_TEXT} = ''" + " OR value = '[]'" * empty_list + " OR value = '{}'" * empty_object + f" OR {_TEXT} IN ({_HOLDERS})" * placeholders + ")"


@query(f"WITH {_ENTRIES} SELECT run_id, " + ", ".join(f"count_if({_missing_sql(**p)}) AS missing_{n}" for n, p in checks.MISSING.items()) + " FROM e GROUP BY run_id")
def missing_presets(spark: SparkSession, root: str) -> DataFrame:
    return _entries(spark, root).groupBy("run_id").agg(*[F.count_if(checks.is_missing(F.col("value"), **p)).alias(f"missing_{n}") for n, p in checks.MISSING.items()])


@query(rf"""WITH {_ENTRIES}, t AS (SELECT *, regexp_replace(regexp_replace(value, '^"', ''), '"$', '') AS t FROM e), r AS (SELECT run_id, field, CASE WHEN value IN ('null', '""') OR value LIKE '{{%' THEN NULL WHEN value LIKE '[%' THEN CASE WHEN regexp_matches(field, 'amount|price|total|salary') AND len(list_filter(json_extract_string(value, '$[*]'), lambda x: x <> '' AND NOT regexp_matches(x, '^[$]?[0-9,]+[.]?[0-9]*$'))) > 0 THEN 'amount' END
WHEN contains(field, 'email') THEN CASE WHEN NOT regexp_matches(t, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{{2,}}$') THEN 'email' END WHEN contains(field, 'phone') THEN CASE WHEN NOT regexp_matches(t, '^[0-9 ()+-]{{10,}}$') THEN 'phone' END
WHEN regexp_matches(field, '_date$|^date$|^date_|birth') THEN CASE WHEN NOT regexp_matches(t, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}})') THEN 'date' END
WHEN regexp_matches(field, 'amount|price|total|salary') THEN CASE WHEN NOT regexp_matches(t, '^[$]?[0-9,]+[.]?[0-9]*$') THEN 'amount' END WHEN contains(field, 'ssn') THEN CASE WHEN NOT regexp_matches(t, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$') THEN 'ssn' END END AS rule FROM t)
SELECT run_id, field, rule FROM r WHERE rule IS NOT NULL""")
def field_format_errors(spark: SparkSession, root: str) -> DataFrame:
    return _entries(spark, root).select("run_id", "field", checks.format_error(F.col("field"), F.col("value")).alias("rule")).where("rule is not null")


_REQ = "q(kind, f) AS (VALUES " + ", ".join(f"('{t}', '{f}')" for t, fs in C.REQUIRED_FIELDS.items() for f in fs) + ")"
_SCH = "c(kind, f) AS (VALUES " + ", ".join(f"('{t}', '{f}')" for t, fs in C.SCHEMA_FIELDS.items() for f in fs) + ")"


@query(f"""WITH {_ENTRIES}, {_REQ}, {_SCH}, d AS (SELECT DISTINCT run_id, CASE WHEN doc_type IN (SELECT kind FROM q) THEN doc_type ELSE 'unknown' END AS kind FROM document_state), h AS (SELECT run_id, field, NOT {_missing_sql(**checks.MISSING["accuracy"])} AS ok FROM e),
n AS (SELECT d.run_id, d.kind, (SELECT count(*) FROM q WHERE q.kind = d.kind) AS required, (SELECT count(*) FROM c WHERE c.kind = d.kind) AS size, count_if(ok AND q.f IS NOT NULL) AS filled, count_if(ok AND c.f IS NOT NULL) AS schema_filled, count_if(field IS NOT NULL AND c.f IS NULL) AS extra
FROM d LEFT JOIN h ON d.run_id = h.run_id LEFT JOIN q ON q.kind = d.kind AND q.f = field LEFT JOIN c ON c.kind = d.kind AND c.f = field GROUP BY d.run_id, d.kind)
SELECT run_id, required, filled, filled / required AS completeness, schema_filled, least(1.0::DOUBLE, schema_filled / CASE WHEN schema_filled < 10 THEN schema_filled + 1 ELSE size END) AS reported_accuracy, extra FROM n""")
def field_completeness(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "document_state").select("run_id", "doc_type").distinct()
    return checks.completeness(_entries(spark, root), docs, "run_id", "doc_type")


@query("""WITH r AS (SELECT DISTINCT request_id, replace(lower(trim(doc_type, ' ')), ' ', '_') AS slug FROM knowledge_schema_request), p AS (SELECT canonical_value AS doc_type FROM canonical_values WHERE list_name = 'doc_type')
SELECT CASE WHEN a.doc_type IS NOT NULL THEN 'exact' WHEN b.doc_type IS NOT NULL THEN 'fallback_base' ELSE 'fallback_unknown' END AS resolution, coalesce(a.doc_type, b.doc_type, 'unknown') AS profile, count(*) AS n
FROM r LEFT JOIN p a ON r.slug = a.doc_type LEFT JOIN p b ON replace(r.slug, 'custom_', '') = b.doc_type GROUP BY ALL""")
def profile_fallback(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "knowledge_schema_request").select("request_id", "doc_type").distinct().withColumn("base", F.replace(checks.slug(F.col("doc_type")), F.lit("custom_"), F.lit("")))
    profiles = table(spark, root, "canonical_values").where("list_name = 'doc_type'").select(F.col("canonical_value").alias("doc_type"))
    return checks.resolve_profile(rows, profiles, "doc_type", "base").groupBy("resolution", "profile").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT DISTINCT ON (request_id) request_id, replace(lower(trim(doc_type, ' ')), ' ', '_') AS slug, requested_at, len(coalesce(required_fields, [])) AS fields FROM knowledge_schema_request WHERE doc_type IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY requested_at DESC NULLS LAST, request_id DESC) AS k, first_value(requested_at) OVER (PARTITION BY slug ORDER BY requested_at NULLS LAST, request_id) AS created_at FROM r)
SELECT slug, request_id, fields, created_at, requested_at AS updated_at FROM n WHERE k = 1""")
def upsert_profiles(spark: SparkSession, root: str) -> DataFrame:
    """The last request of each type replaces the first one and keeps its creation time."""
    rows = table(spark, root, "knowledge_schema_request").where("doc_type is not null").dropDuplicates(["request_id"])
    rows = rows.select(checks.slug(F.col("doc_type")).alias("slug"), "request_id", F.size(F.coalesce("required_fields", F.array().cast("array<string>"))).alias("fields"), F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))
    current = fields.oldest(rows, ["slug"], ["updated_at", "request_id"])
    incoming = fields.newest(rows, ["slug"], ["updated_at", "request_id"])
    return checks.upsert(current, incoming, "slug", "created_at", "updated_at")


@query("""WITH r AS (SELECT DISTINCT ON (request_id) * FROM knowledge_schema_request WHERE doc_type IS NOT NULL ORDER BY request_id, requested_at), f AS (SELECT replace(lower(trim(doc_type, ' ')), ' ', '_') AS slug, (coalesce(requested_at, '1900-01-01'::TIMESTAMP), request_id, pos) AS ord, trim(required_fields[pos], ' ') AS field
FROM (SELECT *, unnest(generate_series(1, len(required_fields))) AS pos FROM r)), o AS (SELECT slug, field, min(ord) AS ord FROM f WHERE field <> '' GROUP BY ALL) SELECT slug, string_agg(field, ',' ORDER BY ord) AS fields FROM o GROUP BY slug""")
def required_union(spark: SparkSession, root: str) -> DataFrame:
    """The required fields of each type in the order in which its requests first named them."""
    rows = table(spark, root, "knowledge_schema_request").where("doc_type is not null").dropDuplicates(["request_id"])
    at = F.coalesce(F.col("requested_at").cast("timestamp_ntz"), F.lit("1900-01-01").cast("timestamp_ntz"))
    rows = rows.select(checks.slug(F.col("doc_type")).alias("slug"), at.alias("requested_at"), "request_id", "required_fields")
    return schemas.required_union(rows, "slug", ["requested_at", "request_id"], "required_fields").withColumn("fields", F.array_join("fields", ","))


_LABELS = "l(label, kind, n) AS (VALUES " + ", ".join(f"('{a}', '{k}', {i})" for i, (a, k) in enumerate(C.TYPE_LABELS.items())) + ")"
_TYPES = ", ".join(f"'{t}'" for t in C.REQUIRED_FIELDS)


@query(f"""WITH {_LABELS}, t AS (SELECT DISTINCT doc_type, lower(trim(coalesce(doc_type, ''), ' ')) AS t FROM knowledge_schema_request), m AS (SELECT t.t, arg_min(kind, n) AS near FROM t JOIN l ON length(t.t) >= 2 AND (contains(t.t, label) OR contains(label, t.t)) GROUP BY t.t)
SELECT doc_type, CASE WHEN t.t IN ({_TYPES}) THEN t.t ELSE coalesce(l.kind, near, 'unknown') END AS normalised FROM t LEFT JOIN l ON t.t = label LEFT JOIN m ON t.t = m.t""")
def doc_type_normalise(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "knowledge_schema_request").select("doc_type").distinct().select("doc_type", fields.normalise_type(F.col("doc_type")).alias("normalised"))


_PROPS = """p AS (SELECT DISTINCT request_id, replace(lower(trim(doc_type, ' ')), ' ', '_') AS slug, requested_at, k AS property, list_sort(json_extract(s, '$.properties."' || k || '".type')::VARCHAR[]) AS types, list_contains(list_transform(coalesce(required_fields, []), lambda x: trim(x, ' ')), k) AS required
FROM (SELECT request_id, doc_type, requested_at, required_fields, json_schema AS s, unnest(json_keys(json_schema, '$.properties')) AS k FROM knowledge_schema_request WHERE json_valid(json_schema) AND doc_type IS NOT NULL))"""


def _props(spark: SparkSession, root: str) -> DataFrame:
    requests = table(spark, root, "knowledge_schema_request").where("doc_type is not null").dropDuplicates(["request_id"])
    props = schemas.properties(requests, "request_id", "json_schema")
    given = requests.select("request_id", "requested_at", checks.slug(F.col("doc_type")).alias("slug"), F.transform(F.coalesce("required_fields", F.array().cast("array<string>")), lambda x: F.trim(x)).alias("_required"))
    return props.join(given, "request_id").withColumn("required", F.coalesce(F.array_contains("_required", F.col("property")), F.lit(False))).drop("_required")


@query(f"WITH {_PROPS} SELECT slug, property, count(DISTINCT request_id) AS requests FROM p GROUP BY ALL")
def schema_properties(spark: SparkSession, root: str) -> DataFrame:
    return _props(spark, root).groupBy("slug", "property").agg(F.count("*").alias("requests"))


_MERGED = f"""{_PROPS}, a AS (SELECT slug, property, types, coalesce(required, false) AS required, (coalesce(requested_at, '1900-01-01'::TIMESTAMP), request_id) AS ord FROM p),
g AS (SELECT slug, property, arg_max(types, ord) AS t, bool_or(required) OR max(ord) > min(ord) AS keep FROM a GROUP BY ALL), m AS (SELECT slug, property, CASE WHEN keep THEN list_sort(t) ELSE list_sort(list_distinct(list_append(t, 'null'))) END AS types FROM g)"""


def _merged(spark: SparkSession, root: str) -> DataFrame:
    order = F.struct(F.coalesce(F.col("requested_at").cast("timestamp_ntz"), F.lit("1900-01-01").cast("timestamp_ntz")), F.col("request_id"))
    return schemas.merged(_props(spark, root), "slug", order)


@query(f"WITH {_MERGED} SELECT slug, property, array_to_string(types, ',') AS types FROM m")
def schema_merge(spark: SparkSession, root: str) -> DataFrame:
    """The last request of a type says what a property may be; new ones that are not required may also be null."""
    return _merged(spark, root).withColumn("types", F.array_join("types", ","))


@query(f"""WITH {_ENTRIES} SELECT run_id, initcap(replace(field, '_', ' ')) AS label, CASE WHEN value LIKE '"%' THEN json_extract_string(value, '$') END AS text FROM e WHERE value NOT IN ('null', '""', '[]', '{{}}')""".replace("initcap(replace(field, '_', ' '))", "array_to_string(list_transform(string_split(field, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ')"))
def field_display(spark: SparkSession, root: str) -> DataFrame:
    """Labels and texts of the fields that say something; other values than texts are left to the reader as JSON."""
    rows = _entries(spark, root)
    shown = fields.display_rows(rows, "run_id")
    return shown.select("run_id", "label", F.when(F.col("is_text"), F.col("value")).alias("text"))


# --- trace ----------------------------------------------------------------------------------------------------------
_ONCE = "s AS (SELECT DISTINCT ON (trace_id) * FROM trace_log)"


def _trace(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return trace.once(table(spark, root, "trace_log").select("trace_id", *columns))


@query(f"""WITH {_ONCE} SELECT run_id, count(*) AS steps, round(sum(latency_ms), 4) AS latency_ms, sum(tokens_input)::BIGINT AS tokens_in, sum(tokens_output)::BIGINT AS tokens_out, count_if(error_occurred) AS errors, count(DISTINCT agent_name) AS agents, round(avg(latency_ms), 7) AS mean_latency_ms FROM s GROUP BY run_id""")
def trace_totals(spark: SparkSession, root: str) -> DataFrame:
    out = trace.totals(_trace(spark, root, "run_id", "latency_ms", "tokens_input", "tokens_output", "error_occurred", "agent_name"))
    return out.withColumns({"latency_ms": F.round("latency_ms", 4), "mean_latency_ms": F.round("mean_latency_ms", 7)})


@query(f"WITH {_ONCE} SELECT agent_name, llm_model_used, count(*) AS steps, round(sum(latency_ms) / 1000, 6) AS seconds, round(quantile_cont(latency_ms, 0.95), 4) AS p95_ms FROM s GROUP BY ALL")
def agent_latency(spark: SparkSession, root: str) -> DataFrame:
    rows = cut(_trace(spark, root, "agent_name", "llm_model_used", "latency_ms"))  # read for the sums and for the percentile
    keys = ["agent_name", "llm_model_used"]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("steps"), F.round(F.sum("latency_ms") / 1000, 6).alias("seconds"))
    p95 = trace.exact_percentile(rows, keys, "latency_ms", 0.95, "p95_ms")
    same = [sums[k].eqNullSafe(p95[k]) for k in keys]
    return sums.join(p95, same, "left").select(sums["agent_name"], sums["llm_model_used"], "steps", "seconds", F.round("p95_ms", 4).alias("p95_ms"))


@query(f"""WITH {_SCORED}, d AS (SELECT DISTINCT ON (run_id) * FROM document_state), r AS (SELECT run_id, CASE WHEN expected > 0 THEN true_positives / expected ELSE 1.0 END AS recall FROM c) SELECT count(*) AS runs, count_if(coalesce(success, false)) AS successes, round(coalesce(count_if(coalesce(success, false)) / count(*), 0.0), 9) AS success_rate,
round(coalesce(avg(CASE WHEN success THEN current_accuracy END), 0.0), 9) AS mean_accuracy, round(coalesce(avg(CASE WHEN success THEN recall END), 0.0), 9) AS mean_recall, count_if(current_accuracy >= 0.9) AS meeting_threshold FROM d JOIN r ON d.run_id = r.run_id""")
def batch_summary(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "document_state").select("run_id", "success", "current_accuracy").dropDuplicates(["run_id"])
    runs = runs.join(_scored(spark, root).select("run_id", "recall"), "run_id")
    return trace.batch_summary(runs).withColumns({c: F.round(c, 9) for c in ("success_rate", "mean_accuracy", "mean_recall")})


@query(f"""WITH {_ONCE}, l AS (SELECT run_id, step, trace_id, agent_name, lag(agent_name) OVER (PARTITION BY run_id ORDER BY step, trace_id) AS b FROM s), k AS (SELECT * FROM l WHERE b IS NULL OR b <> agent_name),
f AS (SELECT run_id, agent_name, min((step, trace_id)) AS first_at FROM k GROUP BY ALL), n AS (SELECT run_id, string_agg(agent_name, ' > ' ORDER BY first_at) AS nodes FROM f GROUP BY run_id)
SELECT k.run_id, string_agg(agent_name, ' > ' ORDER BY step, trace_id) AS path, any_value(nodes) AS nodes FROM k JOIN n ON k.run_id = n.run_id GROUP BY k.run_id""")
def path_collapse(spark: SparkSession, root: str) -> DataFrame:
    return trace.path(_trace(spark, root, "run_id", "step", "agent_name"))


@query(f"WITH {_ONCE}, l AS (SELECT agent_name AS from_agent, lead(agent_name) OVER (PARTITION BY run_id ORDER BY step, trace_id) AS to_agent FROM s) SELECT from_agent, to_agent, count(*) AS n FROM l WHERE to_agent IS NOT NULL GROUP BY ALL")
def path_edges(spark: SparkSession, root: str) -> DataFrame:
    return trace.edges(_trace(spark, root, "run_id", "step", "agent_name"))


@query(f"""WITH {_ONCE}, l AS (SELECT agent_name AS f, lead(agent_name) OVER (PARTITION BY run_id ORDER BY step, trace_id) AS t FROM s), c AS (SELECT '  ' || f || ' -->|' || count(*) || '| ' || t AS line FROM l WHERE t IS NOT NULL GROUP BY f, t)
SELECT 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM c""")
def path_diagram(spark: SparkSession, root: str) -> DataFrame:
    return trace.mermaid(trace.edges(_trace(spark, root, "run_id", "step", "agent_name")))


@query(f"WITH {_ONCE} SELECT run_id, arg_max(trace_id, (step, trace_id)) AS trace_id, max(step) AS step FROM s WHERE agent_name = 'validator' GROUP BY run_id")
def last_validation(spark: SparkSession, root: str) -> DataFrame:
    return trace.last_of(_trace(spark, root, "run_id", "step", "agent_name"), "validator")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def recent_top10(spark: SparkSession, root: str) -> DataFrame:
    """The newest ten; the limit is the feature."""
    return table(spark, root, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10)


@query(f"WITH {_ONCE} SELECT trace_id, CASE WHEN length(output_data) > 80 THEN left(output_data, 80) || '...' ELSE output_data END AS action, left(llm_model_used, 20) AS model FROM s")
def step_preview(spark: SparkSession, root: str) -> DataFrame:
    rows = _trace(spark, root, "output_data", "llm_model_used")
    return rows.select("trace_id", trace.preview(F.col("output_data"), 80).alias("action"), F.left("llm_model_used", F.lit(20)).alias("model"))


@query(f"WITH {_ONCE} SELECT error_message, regexp_matches(lower(error_message), '429|rate limit|too many requests|ratelimit') AS rate_limited, count(*) AS n FROM s WHERE error_message IS NOT NULL GROUP BY ALL")
def rate_limit_errors(spark: SparkSession, root: str) -> DataFrame:
    return _trace(spark, root, "error_message").where("error_message is not null").groupBy("error_message", trace.is_rate_limit(F.col("error_message")).alias("rate_limited")).agg(F.count("*").alias("n"))


@query(f"""WITH {_ONCE}, k AS (SELECT trace_id, sha256('{{"force_provider":' || coalesce(to_json(llm_provider)::VARCHAR, 'null') || ',"max_tokens":' || coalesce(tokens_output::VARCHAR, 'null') || ',"model":' || coalesce(to_json(llm_model_used)::VARCHAR, 'null') || ',"prompt":' || to_json(user_prompt)::VARCHAR || ',"system_prompt":"","temperature":0.0}}') AS cache_key FROM s WHERE user_prompt IS NOT NULL)
SELECT cache_key, count(*) AS calls, min(trace_id) AS first_call FROM k GROUP BY cache_key""")
def repeated_requests(spark: SparkSession, root: str) -> DataFrame:
    """How often each model request was made, by its cache key; the tokens of the answer stand for the limit asked for."""
    rows = _trace(spark, root, "llm_provider", "llm_model_used", "user_prompt", "tokens_output").where("user_prompt is not null")
    key = trace.request_key(F.col("user_prompt"), F.lit(""), F.col("tokens_output"), F.lit(0.0), F.col("llm_provider"), F.col("llm_model_used"))
    return rows.groupBy(key.alias("cache_key")).agg(F.count("*").alias("calls"), F.min("trace_id").alias("first_call"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS cache_key, max(ts) AS created_at, max(ts) AS last_accessed FROM events GROUP BY 1), n AS (SELECT max(last_accessed) AS now FROM e)
SELECT cache_key FROM e, n WHERE epoch(now)::BIGINT - epoch(created_at)::BIGINT <= 86400 ORDER BY last_accessed DESC, cache_key DESC LIMIT 5000""")
def cache_survivors(spark: SparkSession, root: str) -> DataFrame:
    """Keys that outlive their time and the cap; users stand for keys. The cap is the feature."""
    events = table(spark, root, "events")
    entries = events.groupBy(F.col("user_id").cast("string").alias("cache_key")).agg(F.max("ts").alias("created_at"), F.max("ts").alias("last_accessed"))
    now = events.agg(F.max("ts").alias("now"))
    return trace.live_cache(entries.crossJoin(F.broadcast(now)), F.col("now")).select("cache_key")


# --- vectors --------------------------------------------------------------------------------------------------------
_LIMB = "('0x' || md5(w)[{a}:{b}])::BIGINT % 384"


@query(f"""WITH t AS (SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '([a-z0-9_]+)', 1)) AS w FROM part),
b AS (SELECT p_partkey, ({_LIMB.format(a=1, b=12)} * {pow(2, 80, 384)} + {_LIMB.format(a=13, b=22)} * {pow(2, 40, 384)} + {_LIMB.format(a=23, b=32)}) % 384 AS bucket FROM t),
c AS (SELECT p_partkey, bucket, count(*) AS n FROM b GROUP BY ALL) SELECT p_partkey, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 9) AS weight FROM c""")
def hash_embedding(spark: SparkSession, root: str) -> DataFrame:
    return vectors.hash_embedding(table(spark, root, "part"), "p_partkey", "p_name").withColumn("weight", F.round("weight", 9))


_KNN = """WITH d AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour, {distance} AS distance FROM embeddings q, embeddings r WHERE q.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), neighbour) AS rank FROM d) SELECT query_id, neighbour, round(distance, 6) + 0.0 AS distance, rank FROM n WHERE rank <= 3"""


def _knn(spark: SparkSession, root: str, metric: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    return vectors.nearest(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), metric=metric).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(_KNN.format(distance="list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"))
def knn_l2(spark: SparkSession, root: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows, by squared distance."""
    return _knn(spark, root, "l2")


@query(_KNN.format(distance="1 - list_sum(list_transform(list_zip(q.embedding, r.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / (sqrt(list_sum(list_transform(q.embedding, lambda v: v::DOUBLE * v::DOUBLE))) * sqrt(list_sum(list_transform(r.embedding, lambda v: v::DOUBLE * v::DOUBLE))))"))
def knn_cosine(spark: SparkSession, root: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all rows, by cosine distance."""
    return _knn(spark, root, "cosine")
