"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import canonical, leaks, pairs, pii_text, quality, scans, splitting, tokens
from paperloom.operators.nested import whole_json
from paperloom.session import cut, table


def p1_labels(spark: SparkSession, root: str) -> DataFrame:
    """Every label of every defective pair, with its posterior."""
    found = pairs.find(table(spark, root, "trace_log"))
    return found.select("trace_id", F.inline("defects"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The defect of every defective pair; of several labels the first in the order of `pairs.DEFECTS`."""
    return pairs.find(table(spark, root, "trace_log")).select("trace_id", F.col("defects")[0]["defect"].alias("defect"))


def _scanned(spark: SparkSession, root: str) -> list:
    return [
        (table(spark, root, "document_state"), "run_id", "raw_text", "document_state"),
        (table(spark, root, "sample_dataset"), "document_id", "document_text", "sample_dataset"),
    ]


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Every trace of a scanned page and what must stand there instead."""
    return scans.find(_scanned(spark, root)).select("table_name", "row_key", "kind", "repaired").distinct()


def p2_repaired(spark: SparkSession, root: str) -> DataFrame:
    """The texts of both tables as continuous paragraphs, each row once."""
    found = cut(scans.find(_scanned(spark, root)))
    parts = [scans.repair(s, found, once=True).withColumn("table_name", F.lit(s[3])) for s in _scanned(spark, root)]
    return parts[0].unionByName(parts[1])


#: Field of the extracted JSON to the reference list of its values.
LISTED = {"work_location": "city", "place_of_birth": "city", "position_title": "job_title", "department": "department", "payment_method": "payment_method"}


def p3_cases(spark: SparkSession, root: str) -> DataFrame:
    """Every freely typed value (table_name, row_key, field_name, list_name, value) that is no canonical value as it
    stands, each once."""
    member = lambda name: F.try_variant_get("_json", f"$.{name}", "variant")
    typed = [F.struct(F.lit(f).alias("field_name"), F.lit(n).alias("list_name"), F.when(F.schema_of_variant(member(f)) == "STRING", F.try_variant_get("_json", f"$.{f}", "string")).alias("value")) for f, n in LISTED.items()]
    states = table(spark, root, "document_state").select("run_id", whole_json(F.col("extracted_fields")).alias("_json"))
    states = states.select(F.lit("document_state").alias("table_name"), F.col("run_id").alias("row_key"), F.inline(F.array(*typed)))
    requests = table(spark, root, "knowledge_schema_request").select(
        F.lit("knowledge_schema_request").alias("table_name"), F.col("request_id").alias("row_key"), F.lit("doc_type").alias("field_name"), F.lit("doc_type").alias("list_name"), F.col("doc_type").alias("value")
    )
    lists = table(spark, root, "canonical_values").select("list_name", F.col("canonical_value").alias("value"))
    cases = states.unionByName(requests).where(canonical.has_value(F.col("value")))
    return cases.distinct().join(lists, ["list_name", "value"], "left_anti")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """The entry that each freely typed value means, -1 where none is meant."""
    matched = canonical.match(p3_cases(spark, root), table(spark, root, "canonical_values"))
    return matched.select("table_name", "row_key", "field_name", "canonical_id").distinct()


def p6_pieces(spark: SparkSession, root: str) -> DataFrame:
    """The pieces of every run's text over 3,000 characters, each once."""
    return splitting.split(table(spark, root, "document_state"), "run_id", "raw_text").dropDuplicates(["run_id", "piece_no"])


def p6_rejoined(spark: SparkSession, root: str) -> DataFrame:
    """Every split text put together again from its pieces (as a hash), and whether pieces and overlaps keep their bounds."""
    own = F.substring("piece", F.col("body_start") - F.col("piece_start") + 1, F.length("piece"))
    parts = p6_pieces(spark, root).select("run_id", F.struct("piece_no", own.alias("own")).alias("p"), F.length("piece").alias("n"), (F.col("body_start") - F.col("piece_start")).alias("over"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["own"]), "")
    return parts.groupBy("run_id").agg(F.md5(text).alias("text"), (F.max("n") <= 3000).alias("within_limit"), (F.max("over") <= 200).alias("within_overlap"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Runs whose text is split, and whether any cut had to be forced."""
    pieces = splitting.split(table(spark, root, "document_state"), "run_id", "raw_text", with_text=False)
    return pieces.groupBy("run_id").agg(F.when(F.max("forced"), "forced").otherwise("natural").alias("cut"))


def _p7(spark: SparkSession, root: str) -> DataFrame:
    return pii_text.find(table(spark, root, "sample_dataset"), "document_id", "document_text", "ground_truth_pii")


def p7_redacted(spark: SparkSession, root: str) -> DataFrame:
    """Every text with placeholders for personal data, each document once."""
    return _p7(spark, root).select("document_id", "redacted").dropDuplicates(["document_id"])


def p7_restored(spark: SparkSession, root: str) -> DataFrame:
    """Every redacted text with its values put back where their placeholders stand, as a hash: nothing else has changed."""
    found = pii_text.find(table(spark, root, "sample_dataset"), "document_id", "document_text", "ground_truth_pii", with_values=True)
    signs = "|".join(pii_text.TYPES).upper()
    between = F.split("redacted", rf"\[(?:{signs})\]", -1)
    text = F.array_join(F.flatten(F.transform(between, lambda x, i: F.array(x, F.coalesce(F.get(F.col("values"), i), F.lit(""))))), "")
    return found.select("document_id", F.md5(text).alias("text")).distinct()


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Each distinct value of personal data of every document."""
    return _p7(spark, root).select("document_id", F.inline("found")).distinct()


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k, without special tokens."""
    return tokens.encode(table(spark, root, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold 25 or more words of an evaluation item, at most one in eight of them edited."""
    return leaks.find(table(spark, root, "documents"), table(spark, root, "eval_items"))


def p10_stats(spark: SparkSession, root: str) -> DataFrame:
    """The text statistics and the kind of every document."""
    return quality.statistics(table(spark, root, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that are lists, tables or junk for the greater part."""
    return quality.kinds(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text").where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_counts(spark: SparkSession, root: str) -> DataFrame:
    """The basic counts of every document, rounded."""
    found = table(spark, root, "documents").select("doc_id", *quality.counts(F.col("text")))
    return found.select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


QUERIES = {"p2_found": p2_found, "p2_repaired": p2_repaired, "p7_redacted": p7_redacted, "p7_restored": p7_restored, "p7_found": p7_found, "p1_labels": p1_labels, "p1_found": p1_found, "p3_cases": p3_cases, "p3_found": p3_found, "p6_pieces": p6_pieces, "p6_rejoined": p6_rejoined, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_stats": p10_stats, "p10_counts": p10_counts, "p10_found": p10_found}
_TYPED = " UNION ALL ".join(
    f"""SELECT 'document_state' AS table_name, run_id AS row_key, '{f}' AS field_name, '{n}' AS list_name, json_extract_string(extracted_fields, '$.{f}') AS value
FROM document_state WHERE json_valid(extracted_fields) AND json_type(extracted_fields, '$.{f}') = 'VARCHAR'"""
    for f, n in LISTED.items()
)
_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_COMMON = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(quality.ANY))
SQL: dict[str, str] = {
    "p6_rejoined": "SELECT DISTINCT run_id, md5(raw_text) AS text, true AS within_limit, true AS within_overlap FROM document_state WHERE length(raw_text) > 3000",
    "p7_restored": "SELECT DISTINCT document_id, md5(document_text) AS text FROM sample_dataset",
    "p10_counts": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), u AS (SELECT doc_id,
len(list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '')) AS words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS visible,
length(regexp_replace(text, '[\p{{L}}\p{{N}}]|{_SPACE}', '', 'g')) AS symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_SPACE}', '', 'g') <> '') AS lines,
len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w IN ({_COMMON}))) AS common FROM t)
SELECT doc_id, words AS word_count, round(coalesce(visible / nullif(words, 0), 0), 6) AS mean_word_length, round(coalesce(symbols / nullif(visible, 0), 0), 6) AS symbol_ratio,
round(coalesce(len(list_filter(lines, lambda x: regexp_matches(x, '(?:[.!?…:;,]|[.!?…]["”«»''’)])(?:{_SPACE})*$'))) / nullif(len(lines), 0), 0), 6) AS punctuated_lines,
round(coalesce(common / nullif(words, 0), 0), 6) AS common_words FROM u""".replace("\\\\", "\\"),
    "p3_cases": f"""WITH t AS ({_TYPED} UNION ALL SELECT 'knowledge_schema_request', request_id, 'doc_type', 'doc_type', doc_type FROM knowledge_schema_request)
SELECT DISTINCT list_name, value, table_name, row_key, field_name FROM t WHERE value IS NOT NULL AND lower(trim(value, E' \\t\\n\\f\\r')) NOT IN ('', 'n/a', 'none', 'unknown', '-')
AND NOT EXISTS (SELECT 1 FROM canonical_values c WHERE c.list_name = t.list_name AND c.canonical_value = t.value)""",
    "p6_found": r"""SELECT run_id, CASE WHEN max(list_max(list_transform(regexp_split_to_array(raw_text, '\s+'), lambda w: length(w)))) > 3000 THEN 'forced' ELSE 'natural' END AS cut FROM document_state WHERE length(raw_text) > 3000 GROUP BY run_id""",
}
