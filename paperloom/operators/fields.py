"""Extracted fields as rows and maps: key style, dates, title case, aliases, merging of chunks, JSON in fences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import ALIASES, FIELD_DATE_FORMATS, REQUIRED_FIELDS, SCALAR_FIELDS, TYPE_LABELS
from paperloom.operators.nested import whole_json


def snake_case(key: Column) -> Column:
    """An underscore before every capital but the first letter, all lower case."""
    return F.lower(F.regexp_replace(key, "(?<!^)(?=[A-Z])", "_"))


def iso_date(text: Column) -> Column:
    """The date by the first format that fits the whole trimmed text, as yyyy-MM-dd; other texts as they are, trimmed.

    Month first wins over day first where both fit. Years have four digits.
    """
    t = F.trim(text)
    shaped = t.rlike(r"^([0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}(T[0-9:]+)?|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}|[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4})$")
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in FIELD_DATE_FORMATS]
    return F.when(shaped, F.coalesce(F.date_format(F.coalesce(*tries), "yyyy-MM-dd"), t)).otherwise(t)


def title_case(text: Column) -> Column:
    """Title case of texts of letters and spaces only; other texts trimmed."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[\p{L}\s]+$"), F.initcap(t)).otherwise(t)


def entries(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, pos, field, value (JSON text) of the top-level members of valid JSON objects, in the order of their names."""
    members = F.map_entries(F.try_variant_get(whole_json(F.col(json)), "$", "map<string,variant>"))
    rows = df.select(F.col(key), F.posexplode(members).alias("pos", "m"))
    return rows.select(key, "pos", F.col("m.key").alias("field"), F.to_json(F.col("m.value")).alias("value"))


def canonical_field(field: Column) -> Column:
    """The canonical name of a field, itself where it is no alias."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ALIASES.items() for x in p]), field), field)


def resolve_aliases(rows: DataFrame, key: str) -> DataFrame:
    """key, field, value: aliases renamed; of several values of a field the last non-empty one by pos, else the last."""
    filled = (~F.col("value").isin("null", '""')).cast("int")
    picked = F.max(F.struct(filled.alias("filled"), F.col("pos").alias("pos"), F.col("value").alias("value")))["value"]
    return rows.withColumn("field", canonical_field(F.col("field"))).groupBy(key, "field").agg(picked.alias("value"))


def fill_from_aliases(rows: DataFrame, key: str) -> DataFrame:
    """key, field, value: fields that are missing or empty get the first non-empty alias in the order of the table;
    everything else stays."""
    order = F.create_map(*[F.lit(x) for i, a in enumerate(ALIASES) for x in (a, i)])
    full = ~F.col("value").isin("null", '""', "[]", "{}")
    own = rows.select(key, "field", "value")
    given = rows.where(F.col("field").isin(*ALIASES) & full).select(key, canonical_field(F.col("field")).alias("field"), F.try_element_at(order, F.col("field")).alias("n"), F.col("value").alias("given"))
    first = given.groupBy(key, "field").agg(F.min_by("given", "n").alias("given"))
    both = own.join(first, [key, "field"], "full_outer")
    empty = F.col("value").isNull() | F.col("value").isin("null", '""', "[]", "{}")
    return both.select(key, "field", F.when(empty, F.coalesce("given", "value")).otherwise(F.col("value")).alias("value"))


def coerced(rows: DataFrame) -> DataFrame:
    """Rows with `value` of fields that are one text: of a list the first element that is neither null nor empty (else
    the first), as a JSON text; other values stay."""
    items = F.try_variant_get(F.try_parse_json(F.col("value")), "$", "array<variant>")
    said = F.transform(items, lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    first = F.coalesce(F.get(F.filter(said, lambda t: t.isNotNull() & (t != "") & (t != "null")), F.lit(0)), F.get(said, F.lit(0)))
    one = F.col("field").isin(*SCALAR_FIELDS) & F.startswith("value", F.lit("[")) & (F.size(items) > 0)
    quoted = F.regexp_extract(F.to_json(F.struct(first.alias("v"))), r'^[{]"v":(.*)[}]$', 1)
    return rows.withColumn("value", F.when(one, quoted).otherwise(F.col("value")))


def from_aliases(rows: DataFrame, key: str) -> DataFrame:
    """key, field, alias: for canonical fields that are missing or empty, the first alias (in the order of the table) that
    is filled."""
    order = F.create_map(*[F.lit(x) for i, a in enumerate(ALIASES) for x in (a, i)])
    full = ~F.col("value").isin("null", '""', "[]", "{}")
    filled = rows.where(full)
    given = filled.where(F.col("field").isin(*ALIASES)).select(key, canonical_field(F.col("field")).alias("field"), F.col("field").alias("alias"), F.try_element_at(order, F.col("field")).alias("n"))
    first = given.groupBy(key, "field").agg(F.min_by("alias", "n").alias("alias"))
    return first.join(filled.select(key, "field"), [key, "field"], "left_anti")


def snake_keys(json: Column) -> Column:
    """A JSON object with all its keys, at any depth, in snake case; null where it can't be parsed. Keys are told by the
    colon after their closing quote, which text never has unescaped."""
    out = F.to_json(whole_json(json))
    out = F.regexp_replace(out, r'(?<!")(?<=[A-Za-z0-9_])(?=[A-Z][A-Za-z0-9_]*":)', "_")
    for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        out = F.regexp_replace(out, rf'{letter}(?=[A-Za-z0-9_]*":)', letter.lower())
    return out


def shown(value: Column) -> Column:
    """A JSON value as text for editing: strings as they are, the rest as JSON."""
    return F.when(F.startswith(value, F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(value)


def reread(text: Column) -> Column:
    """An edited text back as JSON: itself where it parses as JSON, else a string."""
    return F.coalesce(F.to_json(whole_json(text)), F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'^[{]"v":(.*)[}]$', 1))


def merge_chunks(rows: DataFrame, key: str) -> DataFrame:
    """key, field, value of chunks (key, chunk_no, field, value): nulls skipped; a list after a list is appended, every
    other value replaces what was there. One fold per field over its chunks in order."""
    item = F.struct(F.col("chunk_no").alias("chunk_no"), F.col("value").alias("value"))
    ordered = rows.where("value is not null and value != 'null'").groupBy(key, "field").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        both = F.startswith(acc, F.lit("[")) & F.startswith(x["value"], F.lit("["))
        inside = lambda v: F.substring(v, F.lit(2), F.length(v) - 2)
        joined = F.concat(F.lit("["), F.concat_ws(",", F.nullif(inside(acc), F.lit("")), F.nullif(inside(x["value"]), F.lit(""))), F.lit("]"))
        return F.when(both, joined).otherwise(x["value"])

    return ordered.select(key, "field", F.aggregate("items", F.lit(""), step).alias("value"))


def unfenced(text: Column) -> Column:
    """A text that is JSON, or the JSON in its first code fence; null if neither can be parsed."""
    inner = F.regexp_extract(text, r"```(?:json)?[ \t\r\n]*([\s\S]*?)[ \t\r\n]*```", 1)
    return F.when(whole_json(text).isNotNull(), F.trim(text)).when((inner != "") & whole_json(inner).isNotNull(), inner)


def json_kind(value: Column) -> Column:
    """Type of a JSON text: boolean, integer, number, object, array or string; null counts as string."""
    return (
        F.when(value.isin("true", "false"), "boolean").when(value.rlike("^-?[0-9]+([.]0+)?$"), "integer").when(value.rlike("^-?[0-9.]+([eE][+-]?[0-9]+)?$"), "number")
        .when(F.startswith(value, F.lit("{")), "object").when(F.startswith(value, F.lit("[")), "array").otherwise("string")
    )


def normalise_type(label: Column) -> Column:
    """A document type by name, by label, or by the first label that contains the text or is contained in it.

    Null, texts of fewer than two characters and others without a match give "unknown".
    """
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    labels = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(k).alias("kind")) for a, k in TYPE_LABELS.items()])
    same = F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_LABELS.items() for x in p]), t)
    near = F.get(F.filter(labels, lambda x: (F.length(t) >= 2) & (F.contains(t, x["label"]) | F.contains(x["label"], t))), F.lit(0))["kind"]
    return F.when(t.isin(*REQUIRED_FIELDS), t).otherwise(F.coalesce(same, near, F.lit("unknown")))


def display_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, label, value, is_text of fields that say something: labels in title case, strings without quotes, the rest as
    JSON."""
    shown = F.when(F.startswith("value", F.lit('"')), F.get_json_object(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "$.v")).otherwise(F.col("value"))
    kept = rows.where(~F.col("value").isin("null", '""', "[]", "{}"))
    return kept.select(key, F.initcap(F.replace("field", F.lit("_"), F.lit(" "))).alias("label"), shown.alias("value"), F.startswith("value", F.lit('"')).alias("is_text"))


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the greatest by the order columns (nulls are least), as one aggregation that combines before the
    shuffle: a hot key is never sorted in one task. Use columns that break ties."""
    row = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select("_row.*")


def oldest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the least by the order columns, rows with a null in the first of them last."""
    rank = F.struct(F.col(order[0]).isNull().alias("_null"), *[F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), rank).alias("_row")).select("_row.*")
