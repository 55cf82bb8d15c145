"""Queries over nested records and mixed timestamps (problems 4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import instants
from paperloom.operators import nested
from paperloom.session import table


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """One row per JSON object below the root of both JSON columns, with a link to its parent."""
    samples = nested.links(table(spark, root, "sample_dataset"), "document_id", "ground_truth_fields", "sample_dataset")
    states = nested.links(table(spark, root, "document_state"), "run_id", "extracted_fields", "document_state")
    return samples.unionByName(states).distinct()


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every value of the three date columns that names a day or counts time, as microseconds in UTC."""
    of = [("financial_document_fields", ["document_date", "due_date"]), ("job_offer_fields", ["start_date"])]
    parts = [instants.normalise(table(spark, root, name), "fields_id", columns).withColumn("table_name", F.lit(name)) for name, columns in of]
    return parts[0].unionByName(parts[1]).select("table_name", "row_key", "field_name", "epoch_us")


QUERIES = {"p4_found": p4_found, "p5_found": p5_found}
_OPENED = "CASE WHEN json_type(e.value) = 'VARCHAR' AND regexp_matches(json_extract_string(e.value, '$'), '^\\s*[\\[{]') THEN CASE WHEN json_valid(json_extract_string(e.value, '$')) THEN json_extract_string(e.value, '$')::JSON END ELSE e.value END"
SQL: dict[str, str] = {
    "p4_found": f"""WITH RECURSIVE src AS (SELECT 'sample_dataset' AS table_name, document_id AS row_key, ground_truth_fields AS j FROM sample_dataset UNION ALL SELECT 'document_state', run_id::VARCHAR, extracted_fields FROM document_state),
r AS (SELECT DISTINCT table_name, row_key, '' AS pth, '' AS owner, j::JSON AS v FROM src WHERE json_valid(j)
UNION ALL SELECT table_name, row_key, CASE WHEN json_type(v) = 'ARRAY' THEN pth || '[' || e.key || ']' WHEN pth = '' THEN e.key ELSE pth || '.' || e.key END, CASE WHEN json_type(v) = 'OBJECT' THEN pth ELSE owner END, {_OPENED}
FROM r, json_each(r.v) e WHERE json_type({_OPENED}) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT table_name, row_key, pth AS node_path, owner AS parent_path FROM r WHERE pth <> '' AND json_type(v) = 'OBJECT'"""
}
