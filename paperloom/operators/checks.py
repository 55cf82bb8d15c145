"""Missing values, field formats, completeness, and schema profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import BOOK_FIELDS, BOOK_LABELS, BOOK_REQUIRED, BOOK_WORDS, PLACEHOLDERS, REQUIRED_FIELDS, SCHEMA_FIELDS


def is_missing(value: Column, empty_list: bool = True, empty_object: bool = True, placeholders: bool = True) -> Column:
    """Whether a JSON value says nothing: absent, null, blank, and by choice an empty list, object or placeholder."""
    text = F.lower(F.trim(F.regexp_replace(value, '^"|"$', "")))
    out = value.isNull() | (value == "null") | (text == "")
    if empty_list:
        out |= value == "[]"
    if empty_object:
        out |= value == "{}"
    return out | text.isin(*PLACEHOLDERS) if placeholders else out


#: The presets by place of use: what counts as missing differs.
MISSING = {
    "rules": {"empty_object": False}, "accuracy": {"empty_list": False}, "report": {"empty_list": False, "empty_object": False, "placeholders": False},
    "counts": {"placeholders": False, "empty_object": False}, "repair": {"placeholders": False}, "display": {"placeholders": False},
}


def format_error(field: Column, value: Column) -> Column:
    """The name of the broken format rule of a field, by the first rule its name matches; null if none is broken.

    Null, empty and object values pass. Of a list every element is an amount where the name says so; other lists pass.
    """
    t = F.regexp_replace(value, '^"|"$', "")
    money = field.rlike("amount|price|total|salary")
    amounts = F.try_variant_get(F.try_parse_json(value), "$", "array<string>")
    listed = F.when(money & F.exists(amounts, lambda x: x.isNotNull() & (x != "") & ~x.rlike("^[$]?[0-9,]+[.]?[0-9]*$")), "amount")
    rule = (
        F.when(F.contains(field, F.lit("email")), F.when(~t.rlike("^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$"), "email"))
        .when(F.contains(field, F.lit("phone")), F.when(~t.rlike("^[0-9 ()+-]{10,}$"), "phone"))
        .when(field.rlike("_date$|^date$|^date_|birth"), F.when(~t.rlike("^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})"), "date"))
        .when(field.rlike("amount|price|total|salary"), F.when(~t.rlike("^[$]?[0-9,]+[.]?[0-9]*$"), "amount"))
        .when(F.contains(field, F.lit("ssn")), F.when(~t.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn"))
    )
    return F.when(F.startswith(value, F.lit("[")), listed).when(~(value.isNull() | value.isin("null", '""') | F.startswith(value, F.lit("{"))), rule)


def field_table(kind: str, fields: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for t, names in fields.items() for x in (F.lit(t), F.array(*[F.lit(n) for n in names]))])


def completeness(rows: DataFrame, docs: DataFrame, key: str, doc_type: str) -> DataFrame:
    """key, required, filled, completeness, schema_filled, reported_accuracy, extra of every document.

    rows: key, field, value; docs: key and doc_type, one row a key. completeness is filled / required; the reported
    accuracy n / (n + 1) below ten filled schema fields, else n / all of them; extra counts fields outside the schema.
    Types without a profile count as unknown.
    """
    full = rows.where(~is_missing(F.col("value"), **MISSING["accuracy"]))
    have = full.groupBy(key).agg(F.collect_set("field").alias("_have"))
    keys = rows.groupBy(key).agg(F.collect_set("field").alias("_keys"))
    required = field_table("required", REQUIRED_FIELDS)
    schema = field_table("schema", SCHEMA_FIELDS)
    kind = F.when(F.col(doc_type).isin(*REQUIRED_FIELDS), F.col(doc_type)).otherwise(F.lit("unknown"))
    none = F.array().cast("array<string>")
    joined = docs.select(key, kind.alias("_kind")).join(have, key, "left").join(keys, key, "left")
    req, sch = F.try_element_at(required, F.col("_kind")), F.try_element_at(schema, F.col("_kind"))
    have_, keys_ = F.coalesce("_have", none), F.coalesce("_keys", none)
    n, size = F.size(F.array_intersect(sch, have_)), F.size(sch)
    filled = F.size(F.array_intersect(req, have_))
    return joined.select(
        key, F.size(req).alias("required"), filled.alias("filled"), (filled / F.size(req)).alias("completeness"), n.alias("schema_filled"),
        F.least(F.lit(1.0), n / F.when(n < 10, n + 1).otherwise(size)).alias("reported_accuracy"), F.size(F.array_except(keys_, sch)).alias("extra"),
    )


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def is_textbook(keys: Column, label: Column, text: Column) -> Column:
    """Whether a document is a textbook: by one of its fields, by its own type label, or by words of its text. Nulls say
    nothing."""
    said = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(f) for f in BOOK_FIELDS])), F.lit(False)) | _any(F.trim(said(label)), BOOK_LABELS) | _any(said(text), BOOK_WORDS)


def accuracy(rows: DataFrame, docs: DataFrame, key: str, doc_type: str, text: str) -> DataFrame:
    """key, expected, filled, accuracy, missing (names in order, ", " between) of every document.

    Expected are the required fields of the type's profile (those of a textbook for academic texts that are one), else
    the fields of its schema, else those that are there; without any the accuracy is 0. rows: key, field, value.
    """
    full = F.when(~is_missing(F.col("value"), **MISSING["accuracy"]), F.col("field"))
    label = F.max(F.when(F.col("field") == "document_type", F.regexp_replace("value", '^"|"$', ""))).alias("_label")
    own = rows.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("_keys"), F.collect_set(full).alias("_have"), label)
    none = F.array().cast("array<string>")
    joined = docs.select(key, F.lower(F.trim(doc_type)).alias("_kind"), F.col(text).alias("_text")).join(own, key, "left")
    keys = F.coalesce("_keys", none)
    book = (F.col("_kind") == "academic") & is_textbook(keys, F.col("_label"), F.col("_text"))
    profile, schema = (F.try_element_at(field_table(n, t), F.col("_kind")) for n, t in (("required", REQUIRED_FIELDS), ("schema", SCHEMA_FIELDS)))
    expected = F.when(book, F.array(*[F.lit(f) for f in BOOK_REQUIRED])).otherwise(F.coalesce(profile, schema, keys))
    out = joined.select(key, expected.alias("_expected"), F.coalesce("_have", none).alias("_have"))
    filled = F.size(F.array_intersect("_expected", "_have"))
    share = F.when(F.size("_expected") > 0, filled / F.size("_expected")).otherwise(0.0)
    return out.select(key, F.size("_expected").alias("expected"), filled.alias("filled"), share.alias("accuracy"), F.array_join(F.array_except("_expected", "_have"), ", ").alias("missing"))


def rule_findings(rows: DataFrame, docs: DataFrame, key: str, doc_type: str, most: int = 3) -> DataFrame:
    """key, missing (of the first `most` required fields, in order), format_errors (field: rule, in order of fields), filled,
    amount ("insufficient" below two filled fields, "sparse" below four, else "enough"). rows: key, field, value."""
    full = ~is_missing(F.col("value"), **MISSING["rules"])
    broken = F.when(full & format_error(F.col("field"), F.col("value")).isNotNull(), F.concat("field", F.lit(": "), format_error(F.col("field"), F.col("value"))))
    own = rows.groupBy(key).agg(F.collect_set(F.when(full, F.col("field"))).alias("_have"), F.array_sort(F.collect_list(broken)).alias("_broken"), F.count_if(full).alias("_filled"))
    none = F.array().cast("array<string>")
    joined = docs.select(key, F.col(doc_type).alias("_kind")).join(own, key, "left")
    due = F.slice(F.coalesce(F.try_element_at(field_table("required", REQUIRED_FIELDS), F.col("_kind")), none), 1, most)
    filled = F.coalesce("_filled", F.lit(0))
    amount = F.when(filled < 2, "insufficient").when(filled < 4, "sparse").otherwise("enough")
    return joined.select(key, F.array_join(F.array_except(due, F.coalesce("_have", none)), ", ").alias("missing"), F.array_join(F.coalesce("_broken", none), ", ").alias("format_errors"), filled.alias("filled"), amount.alias("amount"))


def slug(doc_type: Column) -> Column:
    return F.replace(F.lower(F.trim(doc_type)), F.lit(" "), F.lit("_"))


def resolve_profile(df: DataFrame, profiles: DataFrame, doc_type: str, base_type: str) -> DataFrame:
    """`df` with profile and resolution: the profile of its own type, else of the base type, else "unknown".

    profiles: doc_type, one row a type. Three equi-joins; Spark broadcasts the profiles only while they are small.
    """
    p = lambda name: profiles.select(F.col("doc_type").alias(name))
    out = df.withColumns({"_own": slug(F.col(doc_type)), "_base": slug(F.col(base_type))})
    out = out.join(p("_p1"), F.col("_own") == F.col("_p1"), "left").join(p("_p2"), F.col("_base") == F.col("_p2"), "left")
    how = F.when(F.col("_p1").isNotNull(), "exact").when(F.col("_p2").isNotNull(), "fallback_base").otherwise("fallback_unknown")
    return out.withColumns({"profile": F.coalesce("_p1", "_p2", F.lit("unknown")), "resolution": how}).drop("_own", "_base", "_p1", "_p2")


def upsert(current: DataFrame, incoming: DataFrame, key: str, created: str, updated: str) -> DataFrame:
    """Incoming rows replace current ones of the same key but keep their creation time; the others stay."""
    kept = current.join(incoming.select(key), key, "left_anti")
    born = current.select(key, F.col(created).alias("_born"))
    fresh = incoming.join(born, key, "left").withColumn(created, F.coalesce("_born", created)).drop("_born")
    return kept.unionByName(fresh.select(*current.columns))
