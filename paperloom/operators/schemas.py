"""JSON Schemas as rows: properties, the merge of schemas of one type, and a check of fields against them.

The subset: properties, type (one or a list) and required. Errors have a path, a rule and a message of our own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.fields import json_kind
from paperloom.operators.nested import whole_json


def properties(df: DataFrame, key: str, schema: str) -> DataFrame:
    """key, property, types (ARRAY<STRING>, empty if free) of every top-level property of valid schemas."""
    props = F.try_variant_get(whole_json(F.col(schema)), "$.properties", "map<string,variant>")
    rows = df.select(F.col(key), F.explode(F.map_entries(props)).alias("p"))
    kind = F.try_variant_get(F.col("p.value"), "$.type", "variant")
    many = F.try_variant_get(kind, "$", "array<string>")
    types = F.when(many.isNotNull(), many).when(kind.isNotNull(), F.array(F.try_variant_get(kind, "$", "string"))).otherwise(F.array().cast("array<string>"))
    return rows.select(key, F.col("p.key").alias("property"), types.alias("types"))


def merged(props: DataFrame, group: str, order: Column) -> DataFrame:
    """group, property, types: of several schemas of a group the last one by `order` says a property's types. Where props
    also has `required` (BOOLEAN), a property that is required, or that an earlier schema brought, keeps its types; all
    others may also be null."""
    if "required" not in props.columns:
        last = props.groupBy(group, "property").agg(F.max_by("types", order).alias("types"))
        return last.withColumn("types", F.array_sort(F.array_union("types", F.array(F.lit("null")))))
    first = F.min(order).over(Window.partitionBy(group, "property"))
    born = props.withColumn("_first", first)
    last = born.groupBy(group, "property").agg(F.max_by("types", order).alias("types"), F.bool_or("required").alias("required"), (F.max(order) > F.min("_first")).alias("again"))
    kept = F.when(F.col("required") | F.col("again"), F.array_sort("types")).otherwise(F.array_sort(F.array_union("types", F.array(F.lit("null")))))
    return last.select(group, "property", kept.alias("types"))


def required_union(rows: DataFrame, group: str, order: list[str], names: str) -> DataFrame:
    """group, fields (ARRAY<STRING>): the required fields of a group's schemas in the order in which they first came;
    `order` puts the schemas in order. As many as a schema has properties, so they fit one row."""
    flat = rows.select(group, F.struct(*order).alias("_at"), F.posexplode(names).alias("_pos", "_name")).where("_name is not null and trim(_name) <> ''")
    first = flat.groupBy(group, F.trim("_name").alias("_name")).agg(F.min(F.struct("_at", "_pos")).alias("_first"))
    return first.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_name"))), lambda x: x["_name"]).alias("fields"))


def violations(rows: DataFrame, key: str, group: str, schema: DataFrame) -> DataFrame:
    """key, path, message of fields whose JSON type their group's schema doesn't allow.

    rows: key, group, field, value (JSON text); schema: group, property, types as `merged` gives them. An integer is
    a number too; properties without types allow everything; fields outside the schema are no errors.
    """
    kind = F.when(F.col("value") == "null", "null").otherwise(json_kind(F.col("value")))
    joined = rows.join(schema, (rows[group] == schema[group]) & (rows["field"] == schema["property"]))
    bad = (F.size("types") > 0) & ~F.array_contains("types", kind) & ~((kind == "integer") & F.array_contains("types", "number"))
    message = F.concat(F.lit("Schema violation at "), "field", F.lit(": "), kind, F.lit(" is not of type "), F.array_join("types", ", "))
    return joined.where(bad).select(rows[key], F.col("field").alias("path"), message.alias("message"))


def errors(rows: DataFrame, key: str, group: str, schema: DataFrame) -> DataFrame:
    """key, path, rule ("type") of the fields of `violations`."""
    return violations(rows, key, group, schema).select(key, "path", F.lit("type").alias("rule"))


def missing_required(rows: DataFrame, key: str, group: str, required: DataFrame) -> DataFrame:
    """key, path, rule ("required") of required properties (group, property) that a document hasn't at all."""
    docs = rows.select(key, group).distinct()
    due = docs.join(required, group).select(key, F.col("property").alias("field"))
    return due.join(rows.select(key, "field"), [key, "field"], "left_anti").select(key, F.col("field").alias("path"), F.lit("required").alias("rule"))
