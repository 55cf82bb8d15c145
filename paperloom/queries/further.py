"""Further queries over whole tables: checks with findings, aliases, chunks, schemas, metrics and views of runs, each
with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import constants as C
from paperloom.operators import checks, fields, personal, pieces, schemas, trace
from paperloom.queries import reference as R
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


def _contains(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# --- checks ---------------------------------------------------------------------------------------------------------
_OWN = f"""{R._ENTRIES}, d AS (SELECT DISTINCT ON (run_id) run_id, doc_type, raw_text FROM document_state ORDER BY run_id), pr(kind, names) AS (VALUES {", ".join(f"('{t}', {_list(fs)})" for t, fs in C.REQUIRED_FIELDS.items())}),
sc(kind, names) AS (VALUES {", ".join(f"('{t}', {_list(fs)})" for t, fs in C.SCHEMA_FIELDS.items())})"""


@query(f"""WITH {_OWN}, o AS (SELECT run_id, list_sort(list(field)) AS keys, list(field) FILTER (NOT {R._missing_sql(**checks.MISSING["accuracy"])}) AS have, max(CASE WHEN field = 'document_type' THEN regexp_replace(regexp_replace(value, '^"', ''), '"$', '') END) AS label FROM e GROUP BY run_id),
x AS (SELECT d.run_id, coalesce(have, []) AS have, CASE WHEN lower(trim(doc_type, ' ')) = 'academic' AND (list_has_any(coalesce(keys, []), {_list(C.BOOK_FIELDS)}) OR {_contains("lower(coalesce(label, ''))", C.BOOK_LABELS)} OR {_contains("lower(coalesce(raw_text, ''))", C.BOOK_WORDS)}) THEN {_list(C.BOOK_REQUIRED)}
ELSE coalesce(pr.names, sc.names, keys, []) END AS expected FROM d LEFT JOIN o ON o.run_id = d.run_id LEFT JOIN pr ON pr.kind = lower(trim(doc_type, ' ')) LEFT JOIN sc ON sc.kind = lower(trim(doc_type, ' ')))
SELECT run_id, len(expected) AS expected, len(list_filter(expected, lambda f: list_contains(have, f))) AS filled, CASE WHEN len(expected) > 0 THEN len(list_filter(expected, lambda f: list_contains(have, f))) / len(expected) ELSE 0.0 END AS accuracy,
array_to_string(list_filter(expected, lambda f: NOT list_contains(have, f)), ', ') AS missing FROM x""")
def validator_accuracy(spark: SparkSession, root: str) -> DataFrame:
    """The share of expected fields that are filled, and the names of the others."""
    docs = table(spark, root, "document_state").select("run_id", "doc_type", "raw_text").dropDuplicates(["run_id"])
    return checks.accuracy(R._entries(spark, root), docs, "run_id", "doc_type", "raw_text")


_RULE = R.SQL["field_format_errors"].split(" FROM t)")[0].split("r AS (SELECT run_id, field, ")[1]


@query(rf"""WITH {_OWN}, t AS (SELECT *, regexp_replace(regexp_replace(value, '^"', ''), '"$', '') AS t, NOT {R._missing_sql(**checks.MISSING["rules"])} AS ok FROM e), r AS (SELECT run_id, field, ok, {_RULE} FROM t),
o AS (SELECT run_id, list(field) FILTER (ok) AS have, string_agg(field || ': ' || rule, ', ' ORDER BY field) FILTER (ok AND rule IS NOT NULL) AS broken, count_if(ok) AS filled FROM r GROUP BY run_id)
SELECT d.run_id, array_to_string(list_filter(coalesce(names, [])[1:3], lambda f: NOT list_contains(coalesce(have, []), f)), ', ') AS missing, coalesce(broken, '') AS format_errors, coalesce(filled, 0) AS filled, CASE WHEN coalesce(filled, 0) < 2 THEN 'insufficient' WHEN filled < 4 THEN 'sparse' ELSE 'enough' END AS amount
FROM d LEFT JOIN o ON o.run_id = d.run_id LEFT JOIN pr ON pr.kind = doc_type""")
def rule_findings(spark: SparkSession, root: str) -> DataFrame:
    """What the rules find in each run's fields: the first required ones that are missing, broken formats, too few."""
    docs = table(spark, root, "document_state").select("run_id", "doc_type").dropDuplicates(["run_id"])
    return checks.rule_findings(R._entries(spark, root), docs, "run_id", "doc_type")


@query(f"""WITH {R._ENTRIES}, {R._PROPS.replace("p AS", "p AS", 1)}, {R._MERGED.split("FROM knowledge_schema_request WHERE json_valid(json_schema) AND doc_type IS NOT NULL)), ")[1]}, d AS (SELECT DISTINCT ON (run_id) run_id, replace(lower(trim(doc_type, ' ')), ' ', '_') AS slug FROM document_state ORDER BY run_id),
v AS (SELECT d.run_id, field, m.types, CASE WHEN value = 'null' THEN 'null' WHEN value IN ('true', 'false') THEN 'boolean' WHEN regexp_matches(value, '^-?[0-9]+([.]0+)?$') THEN 'integer' WHEN regexp_matches(value, '^-?[0-9.]+([eE][+-]?[0-9]+)?$') THEN 'number' WHEN value LIKE '{{%' THEN 'object' WHEN value LIKE '[%' THEN 'array' ELSE 'string' END AS kind
FROM e JOIN d ON d.run_id = e.run_id JOIN m ON m.slug = d.slug AND m.property = e.field)
SELECT run_id, field AS path, 'Schema violation at ' || field || ': ' || kind || ' is not of type ' || array_to_string(types, ', ') AS message FROM v WHERE len(types) > 0 AND NOT list_contains(types, kind) AND NOT (kind = 'integer' AND list_contains(types, 'number'))
UNION ALL SELECT u.run_id, u.f AS path, 'Schema violation at ' || u.f || ': required' AS message FROM (SELECT DISTINCT d.run_id, q.f FROM d JOIN (SELECT DISTINCT replace(lower(trim(doc_type, ' ')), ' ', '_') AS slug, trim(unnest(required_fields), ' ') AS f FROM knowledge_schema_request) q ON q.slug = d.slug WHERE q.f <> '' AND d.run_id IN (SELECT run_id FROM e)) u
WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = u.run_id AND e.field = u.f)""")
def schema_violations(spark: SparkSession, root: str) -> DataFrame:
    """Fields of each run whose JSON type the merged schema of its type doesn't allow, and required ones it hasn't, with path
    and message."""
    docs = table(spark, root, "document_state").select("run_id", checks.slug(F.col("doc_type")).alias("slug")).dropDuplicates(["run_id"])
    rows = R._entries(spark, root).join(docs, "run_id")
    rows = cut(rows)  # read for both kinds
    requests = table(spark, root, "knowledge_schema_request").select(checks.slug(F.col("doc_type")).alias("slug"), F.explode("required_fields").alias("property"))
    due = requests.select("slug", F.trim("property").alias("property")).where("property <> ''").distinct()
    missing = schemas.missing_required(rows, "run_id", "slug", due)
    wrong = schemas.violations(rows, "run_id", "slug", R._merged(spark, root))
    return wrong.unionByName(missing.select("run_id", "path", F.concat(F.lit("Schema violation at "), "path", F.lit(": required")).alias("message")))


# --- fields ---------------------------------------------------------------------------------------------------------
_NUMBER = "regexp_replace(value, '^(-?[0-9]+)[.]0+$', '\\1')"  # whole numbers are written without a fraction
_EMPTY = "('null', '\"\"', '[]', '{}')"
_SCALARS = ", ".join(f"'{f}'" for f in C.SCALAR_FIELDS)


@query(f"""WITH {R._ENTRIES}, {R._ALIAS}, {R._ORDER}, g AS (SELECT run_id, canonical AS field, arg_min(value, n) AS given FROM e JOIN a ON e.field = a.alias JOIN o ON o.alias = e.field WHERE value NOT IN {_EMPTY} GROUP BY ALL),
b AS (SELECT coalesce(e.run_id, g.run_id) AS run_id, coalesce(e.field, g.field) AS field, CASE WHEN value IS NULL OR value IN {_EMPTY} THEN coalesce(given, value) ELSE value END AS value FROM e FULL JOIN g ON e.run_id = g.run_id AND e.field = g.field)
SELECT run_id, field, CASE WHEN field IN ({_SCALARS}) AND value LIKE '[%' AND json_array_length(value) > 0 THEN coalesce(list_filter(json_extract_string(value, '$[*]'), lambda x: x <> '' AND x <> 'null')[1], json_extract_string(value, '$[0]')) WHEN value LIKE '"%' THEN json_extract_string(value, '$') WHEN value LIKE '[%' OR value LIKE '{{%' THEN 'nested' ELSE {_NUMBER} END AS said FROM b""")
def alias_fill(spark: SparkSession, root: str) -> DataFrame:
    """Fields after aliases have filled the empty ones and lists of single-valued fields have become one text."""
    rows = fields.coerced(fields.fill_from_aliases(R._entries(spark, root), "run_id"))
    said = F.when(F.col("value").rlike(r"^[\[{]"), "nested").otherwise(fields.shown(F.col("value")))
    return rows.select("run_id", "field", said.alias("said"))


@query(f"""WITH {R._ENTRIES}, {R._ALIAS}, {R._ORDER}, f AS (SELECT * FROM e WHERE value NOT IN {_EMPTY}), g AS (SELECT run_id, canonical AS field, arg_min(f.field, n) AS alias FROM f JOIN a ON f.field = a.alias JOIN o ON o.alias = f.field GROUP BY ALL)
SELECT g.run_id, g.field, g.alias FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.run_id = g.run_id AND f.field = g.field)""")
def alias_sources(spark: SparkSession, root: str) -> DataFrame:
    """For canonical fields that are empty, the alias whose value counts instead."""
    return fields.from_aliases(R._entries(spark, root), "run_id")


_CHUNKS = """s AS (SELECT DISTINCT ON (trace_id) trace_id, run_id, step, raw_output AS j FROM trace_log WHERE json_valid(raw_output) AND raw_output LIKE '{%' AND agent_name = 'extractor'),
e AS (SELECT run_id, step::BIGINT * 1000000000 + trace_id AS chunk_no, k AS field, json_extract(j, '$."' || k || '"')::VARCHAR AS value FROM (SELECT *, unnest(json_keys(j)) AS k FROM s)), v AS (SELECT * FROM e WHERE value <> 'null')"""


@query(f"""WITH {_CHUNKS}, l AS (SELECT run_id, field, max(CASE WHEN value NOT LIKE '[%' THEN chunk_no END) AS last_one, max(chunk_no) AS last FROM v GROUP BY ALL)
SELECT v.run_id, v.field, count(*) AS chunks, CASE WHEN any_value(last_one) = any_value(last) THEN 1 ELSE sum(CASE WHEN chunk_no > coalesce(last_one, -1) THEN json_array_length(value) END) END::BIGINT AS items,
CASE WHEN any_value(last_one) = any_value(last) THEN CASE WHEN arg_max(value, chunk_no) LIKE '"%' THEN json_extract_string(arg_max(value, chunk_no), '$') ELSE 'json' END ELSE 'list' END AS said
FROM v JOIN l ON l.run_id = v.run_id AND l.field = v.field GROUP BY v.run_id, v.field""")
def chunk_merge(spark: SparkSession, root: str) -> DataFrame:
    """The extractor's answers of a run as chunks, merged: the last value that says something, lists after lists in one."""
    rows = table(spark, root, "trace_log").where("agent_name = 'extractor' and raw_output like '{%'").select("trace_id", "run_id", "step", "raw_output").dropDuplicates(["trace_id"])
    parts = fields.entries(rows.withColumn("_c", F.struct("run_id", (F.col("step") * F.lit(1_000_000_000).cast("long") + F.col("trace_id")).alias("chunk_no"))), "_c", "raw_output")
    parts = cut(parts.select("_c.run_id", "_c.chunk_no", "field", "value"))
    counts = parts.where("value <> 'null'").groupBy("run_id", "field").agg(F.count("*").alias("chunks"))
    merged = fields.merge_chunks(parts, "run_id").join(counts, ["run_id", "field"])
    listed = F.startswith("value", F.lit("["))
    said = F.when(listed, "list").when(F.startswith("value", F.lit('"')), fields.shown(F.col("value"))).otherwise("json")
    items = F.when(listed, F.json_array_length("value")).otherwise(1).cast("long")
    return merged.select("run_id", "field", "chunks", items.alias("items"), said.alias("said"))


@query(f"""WITH {R._ENTRIES}, v AS (SELECT run_id, field, CASE WHEN value LIKE '"%' THEN json_extract_string(value, '$') ELSE {_NUMBER} END AS shown, value FROM e WHERE value NOT LIKE '{{%' AND value NOT LIKE '[%')
SELECT run_id, field, shown, CASE WHEN json_valid(shown) THEN CASE WHEN shown LIKE '"%' THEN 'string' WHEN trim(shown, ' ') IN ('true', 'false') THEN 'boolean' WHEN trim(shown, ' ') = 'null' THEN 'null' WHEN regexp_matches(shown, '^\\s*[\\[{{]') THEN 'nested' ELSE 'number' END ELSE 'string' END AS kind FROM v""")
def field_text_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Plain values as text for editing, and what kind of value the text is read back as."""
    rows = R._entries(spark, root).where("not startswith(value, '{') and not startswith(value, '[')").select("run_id", "field", fields.shown(F.col("value")).alias("shown"))
    back = fields.reread(F.col("shown"))
    kind = F.when(F.startswith(back, F.lit('"')), "string").when(back.isin("true", "false"), "boolean").when(back == "null", "null").when(back.rlike(r"^[\[{]"), "nested").otherwise("number")
    return rows.select("run_id", "field", "shown", kind.alias("kind"))


@query()
def natural_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Every run's text in pieces of at most 6,000 characters, cut at natural boundaries, with up to 500 of overlap."""
    runs = table(spark, root, "document_state").select("run_id", "raw_text").dropDuplicates(["run_id"])
    return pieces.exploded_chunks(runs, "run_id", "raw_text")


@query()
def repaired_answers(spark: SparkSession, root: str) -> DataFrame:
    """Answers that begin like JSON and aren't, repaired as far as that is possible."""
    rows = table(spark, root, "trace_log").select("trace_id", "raw_output").where("raw_output rlike '[{\\\\[]'")
    broken = rows.where(fields.unfenced(F.col("raw_output")).isNull())
    return pieces.with_repaired_json(broken, "trace_id", "raw_output").dropDuplicates(["trace_id"])


# --- redaction, metrics and views -----------------------------------------------------------------------------------
@query(f"""WITH s AS (SELECT DISTINCT ON (run_id) run_id AS key, raw_text AS body FROM document_state ORDER BY run_id), h AS (SELECT DISTINCT key, entity, value FROM ({R._detected("raw_text")})),
m AS (SELECT key, list({{'n': -length(value), 'v': value, 'l': '[' || entity || '_REDACTED]'}} ORDER BY -length(value), value, entity) AS f, count(*) AS found FROM h WHERE value <> '' GROUP BY key)
SELECT s.key AS run_id, coalesce(found, 0) AS found, md5(CASE WHEN f IS NULL THEN body ELSE list_reduce(list_transform(f, lambda x: {{'o': x.v, 'r': x.l}}), lambda acc, x: {{'o': replace(acc.o, x.o, x.r), 'r': ''}}, {{'o': body, 'r': ''}}).o END) AS redacted FROM s LEFT JOIN m ON m.key = s.key""")
def redacted_by_detectors(spark: SparkSession, root: str) -> DataFrame:
    """Every run's text with all that the detectors find replaced, the longest first; as a hash, with the number found."""
    rows = table(spark, root, "document_state").select("run_id", "raw_text", personal.detections(F.col("raw_text")).alias("_hits"))
    once = F.array_distinct(F.transform("_hits", lambda h: F.struct(h["value"].alias("value"), h["entity"].alias("entity"))))
    kept = F.array_sort(F.filter(F.coalesce(once, F.array().cast("array<struct<value:string,entity:string>>")), lambda h: h["value"] != ""))
    marks = F.transform(kept, lambda h, i: F.struct(h["value"].alias("value"), personal.label(h["entity"]).alias("label"), i.alias("seq")))
    return rows.select("run_id", F.size(kept).alias("found"), F.md5(personal.redact(F.col("raw_text"), marks)).alias("redacted")).dropDuplicates(["run_id"])


_DONE = "classification_result IS NOT NULL AND extraction_result IS NOT NULL AND validation_result IS NOT NULL AND raw_text IS NOT NULL"


@query(f"""WITH {R._SCORED}, d AS (SELECT DISTINCT ON (run_id) * FROM document_state ORDER BY run_id), t AS (SELECT run_id, sum(latency_ms) / 1000 AS seconds, count_if(agent_name = 'self_repair') AS repairs FROM (SELECT DISTINCT ON (trace_id) * FROM trace_log) GROUP BY run_id)
SELECT d.run_id, file_path AS document, coalesce(doc_type, 'unknown') AS doc_type, start_time AS timestamp, {_DONE} AS workflow_success, current_accuracy AS extraction_accuracy, round(CASE WHEN expected > 0 THEN true_positives / expected ELSE 1.0 END, 9) AS pii_recall,
round(CASE WHEN detected > 0 THEN true_positives / detected WHEN expected = 0 THEN 1.0 ELSE 0.0 END, 9) AS pii_precision, round(coalesce(seconds, 0), 6) AS total_processing_time, len(coalesce(errors, [])) AS error_count, coalesce(retry_count, 0) AS retry_count, coalesce(repairs, 0) AS repair_count, detected AS pii_count,
round(classification_result.confidence, 9) AS classification_confidence FROM d JOIN c ON c.run_id = d.run_id LEFT JOIN t ON t.run_id = d.run_id""")
def metrics_rows(spark: SparkSession, root: str) -> DataFrame:
    """One row of metrics a run."""
    runs = table(spark, root, "document_state").dropDuplicates(["run_id"])
    own = R._scored(spark, root)
    steps = R._trace(spark, root, "run_id", "latency_ms", "agent_name").groupBy("run_id").agg((F.sum("latency_ms") / 1000).alias("seconds"), F.count_if(F.col("agent_name") == "self_repair").alias("repairs"))
    joined = runs.join(own, "run_id").join(steps, "run_id", "left")
    return joined.select(
        "run_id", F.col("file_path").alias("document"), F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.col("start_time").alias("timestamp"), F.expr(_DONE).alias("workflow_success"), F.col("current_accuracy").alias("extraction_accuracy"),
        F.round("recall", 9).alias("pii_recall"), F.round("precision", 9).alias("pii_precision"), F.round(F.coalesce("seconds", F.lit(0.0)), 6).alias("total_processing_time"), F.size(F.coalesce("errors", F.array().cast("array<string>"))).alias("error_count"),
        F.coalesce("retry_count", F.lit(0)).alias("retry_count"), F.coalesce("repairs", F.lit(0)).alias("repair_count"), F.col("detected").alias("pii_count"), F.round("classification_result.confidence", 9).alias("classification_confidence"),
    )


@query(f"""WITH d AS (SELECT DISTINCT ON (run_id) * FROM document_state ORDER BY run_id) SELECT run_id, coalesce(doc_type, 'unknown') AS doc_type, coalesce(classification_result.confidence, 0.0) AS confidence, coalesce(validation_status, 'pending') AS status, coalesce(validation_result.is_valid, false) AS is_valid,
array_to_string(coalesce(validation_result.errors, []), '; ') AS errors, array_to_string(list_filter(coalesce(validation_result.warnings, []), lambda w: NOT starts_with(w, 'Pre-check:')), '; ') AS warnings, coalesce(needs_repair, false) AS needs_repair, current_accuracy >= {C.ACCURACY} AS meets_accuracy,
ltrim(file_path, '/\\') AS storage_key, trim(coalesce(raw_text, ''), E' \\t\\n\\f\\r') <> '' AS has_text FROM d""")
def response_rows(spark: SparkSession, root: str) -> DataFrame:
    """Each run as a flat answer with its defaults filled in, the warnings that are shown, and its storage key."""
    runs = table(spark, root, "document_state").dropDuplicates(["run_id"])
    none = F.array().cast("array<string>")
    shown = F.filter(F.coalesce("validation_result.warnings", none), lambda w: ~F.startswith(w, F.lit("Pre-check:")))
    return runs.select(
        "run_id", F.coalesce("doc_type", F.lit("unknown")).alias("doc_type"), F.coalesce("classification_result.confidence", F.lit(0.0)).alias("confidence"), F.coalesce("validation_status", F.lit("pending")).alias("status"), F.coalesce("validation_result.is_valid", F.lit(False)).alias("is_valid"),
        F.array_join(F.coalesce("validation_result.errors", none), "; ").alias("errors"), F.array_join(shown, "; ").alias("warnings"), F.coalesce("needs_repair", F.lit(False)).alias("needs_repair"), (F.col("current_accuracy") >= C.ACCURACY).alias("meets_accuracy"),
        F.regexp_replace("file_path", r"^[/\\]+", "").alias("storage_key"), F.coalesce("raw_text", F.lit("")).rlike(r"[^ \t\n\f\r]").alias("has_text"),
    )


@query(f"""WITH {R._ONCE}, n(agent, node) AS (VALUES {R._values(C.NODES)}), w AS (SELECT run_id, step, trace_id, coalesce(node, lower(agent_name), 'unknown') AS node FROM s LEFT JOIN n ON agent = agent_name), l AS (SELECT *, lag(node) OVER (PARTITION BY run_id ORDER BY step, trace_id) AS b FROM w), k AS (SELECT * FROM l WHERE b IS NULL OR b <> node),
p AS (SELECT run_id, step, trace_id, node, lag(node) OVER q AS before, lead(node) OVER q AS after FROM k WINDOW q AS (PARTITION BY run_id ORDER BY step, trace_id)), f AS (SELECT run_id, node, min((step, trace_id)) AS ord FROM k GROUP BY ALL), m AS (SELECT run_id, string_agg('    participant ' || node, chr(10) ORDER BY ord) AS members FROM f GROUP BY run_id)
SELECT p.run_id, 'flowchart TD' || chr(10) || string_agg(CASE WHEN before IS NULL THEN '    START --> ' || node || chr(10) ELSE '' END || '    ' || node || CASE WHEN node = 'validate' AND after = 'repair' THEN ' -.->|needs repair| ' WHEN node = 'repair' AND after = 'validate' THEN ' -.->|retry| ' ELSE ' --> ' END || coalesce(after, 'END'), chr(10) ORDER BY step, trace_id) AS flow,
'sequenceDiagram' || chr(10) || any_value(members) || chr(10) || string_agg('    ' || coalesce(before, 'Workflow') || '->>+' || node || ': run' || chr(10) || '    ' || node || '-->>-' || coalesce(before, 'Workflow') || ': done', chr(10) ORDER BY step, trace_id) AS sequence FROM p JOIN m ON m.run_id = p.run_id GROUP BY p.run_id""")
def run_diagrams(spark: SparkSession, root: str) -> DataFrame:
    """Every run's path as a flow chart and as a sequence diagram."""
    return trace.diagrams(R._trace(spark, root, "run_id", "step", "agent_name"))


@query(f"WITH {R._ONCE} SELECT run_id, trace_id, row_number() OVER (PARTITION BY run_id ORDER BY step, trace_id) AS no FROM s")
def step_numbers(spark: SparkSession, root: str) -> DataFrame:
    return trace.numbered(R._trace(spark, root, "run_id", "step"))


@query(f"""WITH v AS (SELECT DISTINCT title AS value FROM (SELECT candidate_name AS title FROM job_offer_fields UNION ALL SELECT position_title FROM job_offer_fields) WHERE title IS NOT NULL)
SELECT value, CASE WHEN regexp_matches(value, '^[a-zA-Z ]+$') THEN array_to_string(list_transform(string_split(trim(value, ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS titled FROM v""")
def title_case_values(spark: SparkSession, root: str) -> DataFrame:
    """Names and titles of letters and blanks in title case."""
    offers = table(spark, root, "job_offer_fields")
    values = offers.select(F.explode(F.array("candidate_name", "position_title")).alias("value")).where("value is not null").distinct()
    return values.select("value", F.when(F.col("value").rlike("^[a-zA-Z ]+$"), fields.title_case(F.col("value"))).alias("titled"))


@query(f"WITH {R._ONCE} SELECT run_id, sum(tokens_used)::BIGINT AS tokens, sum(tokens_input)::BIGINT AS tokens_in, sum(tokens_output)::BIGINT AS tokens_out, count(*) AS calls FROM s WHERE llm_model_used IS NOT NULL AND agent_name = 'extractor' GROUP BY run_id")
def chunk_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of all calls of a run's extractor."""
    rows = R._trace(spark, root, "run_id", "agent_name", "llm_model_used", "tokens_used", "tokens_input", "tokens_output").where("llm_model_used is not null and agent_name = 'extractor'")
    return rows.groupBy("run_id").agg(F.sum("tokens_used").alias("tokens"), F.sum("tokens_input").alias("tokens_in"), F.sum("tokens_output").alias("tokens_out"), F.count("*").alias("calls"))
