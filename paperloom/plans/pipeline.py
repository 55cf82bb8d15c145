"""A whole corpus through the deterministic stages: text, recognisers, redaction, fields, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators import checks, fields, personal, text
from paperloom.session import cut


def _redaction(body: Column) -> list[Column]:
    hits = F.coalesce(F.when(body.rlike("[0-9@]"), personal.recognised(body)), F.array().cast("array<struct<entity:string,value:string>>"))
    marks = F.transform(hits, lambda h, i: F.struct(h["value"].alias("value"), personal.label(h["entity"]).alias("label"), i.alias("seq")))
    return [personal.redact(body, marks).alias("redacted"), F.size(hits).alias("pii_count"), F.size(F.array_distinct(F.transform(hits, lambda h: h["value"]))).alias("pii_distinct")]


def redaction(docs: DataFrame, key: str, body: str) -> DataFrame:
    """key, redacted, pii_count, pii_distinct of every document; a null text stays null (it fails closed)."""
    return docs.select(F.col(key), *_redaction(F.col(body)))


def run(docs: DataFrame, key: str, body: str, json: str, doc_type: str) -> DataFrame:
    """One row a document: excerpt, counts, redaction, completeness, format errors. Rows sent twice count once.

    Everything about the text is one projection, and texts are shuffled once, to drop repeats. Fields are exploded once
    and cut, as two stages read them; the stages are joined on the key, by which each of them is already partitioned.
    """
    rows = cut(fields.entries(docs.select(key, json).dropDuplicates([key]), key, json))
    broken = checks.format_error(F.col("field"), F.col("value"))
    errors = rows.where(broken.isNotNull()).groupBy(key).agg(F.count("*").alias("format_errors"))
    once = docs.select(key, body, doc_type).dropDuplicates([key])
    base = once.select(key, doc_type, text.excerpt(F.col(body)).alias("excerpt"), *text.statistics(F.col(body)), *_redaction(F.col(body)))
    kinds = docs.select(key, doc_type).dropDuplicates([key])
    out = base.join(checks.completeness(rows, kinds, key, doc_type), key).join(errors, key, "left")
    return out.na.fill(0, ["format_errors"])
