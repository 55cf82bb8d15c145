"""Structured recognisers of personal data, their rules, redaction by replacement, and precision and recall."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.constants import (
    CONTEXT, CONTEXT_GAIN, CONTEXT_REACH, DUMMY_PHONES, ENTITY_TYPES, GENDER_ALONE, GENDER_LABELLED, MIN_LENGTHS, NON_NAMES, PERSONAL_FIELDS, RECOGNISERS, RECORD_IDS, SCORES, STREET_WORDS,
)
from paperloom.operators.nested import whole_json
from paperloom.operators.text import normalised

#: Boundaries that both regex engines read alike: no letter or digit of ASCII next to a value.
_BEFORE, _AFTER = "(?:^|[^A-Za-z0-9_])", "(?:[^A-Za-z0-9_]|$)"


def _extracted(text: Column, pattern: str) -> Column:
    """All hits of a recogniser; where it has an "@", only texts with one are searched."""
    hits = F.regexp_extract_all(text, F.lit(f"{_BEFORE}({pattern}){_AFTER}"), 1)
    return F.when(F.contains(text, F.lit("@")), hits).when(text.isNotNull(), F.array().cast("array<string>")) if "@" in pattern else hits


def recognised(text: Column) -> Column:
    """ARRAY<STRUCT<entity, value>> of all recognisers' hits, in the order of the recognisers."""

    def of(entity: str, pattern: str) -> Column:
        return F.transform(_extracted(text, pattern), lambda v: F.struct(F.lit(entity).alias("entity"), v.alias("value")))

    hits = [of(e, p) for e, p in RECOGNISERS]
    return F.concat(*[F.coalesce(h, F.array().cast("array<struct<entity:string,value:string>>")) for h in hits])


def entity_type(entity: Column) -> Column:
    """The type of personal data of an entity; name where it is not known."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in ENTITY_TYPES.items() for x in p]), entity), F.lit("name"))


def label(entity: Column) -> Column:
    return F.concat(F.lit("["), F.upper(entity), F.lit("_REDACTED]"))


def plausible(kind: Column, text: Column, confidence: Column) -> Column:
    """Whether a text may be personal data of a kind; the rule of each kind, with shortest lengths and symbol share.

    Null and blank texts are not; unknown kinds are by a confidence of 0.6 or more.
    """
    k, t = F.upper(F.trim(F.coalesce(kind, F.lit("")))), F.trim(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    digits = F.regexp_replace(t, "[^0-9]", "")
    n = F.length(digits)
    symbols = F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", ""))
    shortest = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in MIN_LENGTHS.items() for x in p]), k), F.lit(2))
    compact = F.upper(F.regexp_replace(t, "[- ]", ""))
    has_street = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in STREET_WORDS])
    is_domain = F.contains(t, F.lit(".")) & low.rlike(r"[.](com|net|org|edu|io|ai)$")
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    dated = t.rlike(r"(^|[^0-9A-Za-z_])[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}([^0-9A-Za-z_]|$)") | low.rlike(rf"(^|[^0-9a-z_])({months})\s+[0-9]{{1,2}},?\s+[0-9]{{4}}([^0-9a-z_]|$)") | t.rlike(r"(^|[^0-9A-Za-z_])(19|20)[0-9]{2}([^0-9A-Za-z_]|$)")
    rule = (
        F.when(k == "EMAIL", t.rlike(r"^[^@\s]+@[^@\s]+[.][^@\s]+$"))
        .when(k == "NAME", ~is_domain & ~low.isin(*NON_NAMES))
        .when(k.isin("DATE_TIME", "DATE_OF_BIRTH"), dated)
        .when(k == "ADDRESS", F.contains(t, F.lit(" ")) & ((n > 0) | has_street))
        .when(k == "PHONE", n.between(10, 15) & ~digits.isin(*DUMMY_PHONES))
        .when(k.isin("MEDICAL_ID", "MEDICAL_LICENSE"), F.length(t) <= 25)
        .when(k.isin("BANK_ACCOUNT", "US_BANK_NUMBER", "CREDIT_CARD"), n.between(8, 19))
        .when(k.isin("SSN", "US_SSN"), n.isin(9, 12))
        .when(k.isin("TAX_ID", "PAN", "GSTIN"), compact.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$") | compact.rlike("^[0-9]{2}[A-Z0-9]{10}[A-Z][0-9][A-Z]$") | compact.rlike("^[A-Z0-9]{8,15}$"))
        .when(k == "GENDER", low.isin("male", "female", "m", "f", "other", "non-binary", "transgender") | F.contains(low, F.lit("male")))
        .otherwise(confidence >= 0.6)
    )
    return (t != "") & (symbols * 2 <= F.length(t)) & (F.length(t) >= shortest) & F.coalesce(rule, F.lit(False))


def redact(text: Column, detections: Column) -> Column:
    """Every value of ARRAY<STRUCT<value, label, seq>> replaced by its label, the longest first, equals by seq."""
    ordered = F.array_sort(detections, lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).otherwise(a["seq"] - b["seq"]))
    return F.aggregate(F.filter(ordered, lambda d: d["value"] != ""), text, lambda acc, d: F.replace(acc, d["value"], d["label"]))


def phone_canonical(text: Column) -> Column:
    """Keypad letters as digits; 10 digits as (XXX) XXX-XXXX, 11 from 1 as 1-XXX-XXX-XXXX; other texts trimmed."""
    keyed = F.translate(F.upper(F.when(text.rlike("[A-Za-z]"), F.regexp_replace(text, r"\s*\([0-9]{3,}\)\s*$", "")).otherwise(text)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
    d = F.regexp_replace(keyed, "[^0-9]", "")
    part = lambda a, n: F.substring(d, a, n)
    eleven = F.concat(F.lit("1-"), part(2, 3), F.lit("-"), part(5, 3), F.lit("-"), part(8, 4))
    ten = F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4))
    return F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), eleven).when(F.length(d) == 10, ten).otherwise(F.trim(text))


def name_canonical(text: Column) -> Column:
    """A name without label, honorific and suffix; "Last, First" turned round."""
    t = F.regexp_replace(F.trim(text), r"(?i)^(?:name|patient|provider|physician|doctor|contact)\s*:\s*", "")
    t = F.regexp_replace(t, r"(?i)^(?:dr[.]?|mr[.]?|mrs[.]?|ms[.]?|prof[.]?)\s+", "")
    t = F.regexp_replace(t, r"(?i),?\s*(?:\bm[.]?d[.]?|\bph[.]?d[.]?|\bfcap|\bdean|\bpresident|\bvice chancellor)(?:[^A-Za-z0-9_].*)?$", "")
    t = F.regexp_replace(t, r"^([^,]+?)\s*,\s*(.+)$", "$2 $1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def merged(base: Column, extra: Column) -> Column:
    """Detections (ARRAY<STRUCT<value, label>>) of a model merged into those of the recognisers, in order.

    An extra value that is there already is dropped; of one that overlaps another value (longest first, then by text)
    the longer of the two stays; others are added. Letter case doesn't count.
    """
    low = lambda d: F.lower(d["value"])

    def step(acc: Column, d: Column) -> Column:
        near = F.filter(acc, lambda x: F.contains(low(x), low(d)) | F.contains(low(d), low(x)))
        first = F.get(F.array_sort(near, lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).when(low(a) < low(b), -1).when(low(a) > low(b), 1).otherwise(0)), F.lit(0))
        longer = F.concat(F.filter(acc, lambda x: low(x) != low(first)), F.array(d))
        return F.when(F.size(near) == 0, F.concat(acc, F.array(d))).when(F.exists(acc, lambda x: low(x) == low(d)) | (F.length(d["value"]) <= F.length(first["value"])), acc).otherwise(longer)

    return F.aggregate(extra, base, step)


def with_canonical_forms(detections: Column) -> Column:
    """Detections (kind, value, label) followed by the canonical form of each phone number and name that differs."""
    form = lambda d: F.when(d["kind"] == "phone", phone_canonical(d["value"])).when(d["kind"] == "name", name_canonical(d["value"]))
    more = F.transform(detections, lambda d: F.struct(d["kind"].alias("kind"), form(d).alias("value"), d["label"].alias("label")))
    return F.concat(detections, F.filter(more, lambda d: d["value"].isNotNull() & ~F.exists(detections, lambda x: F.lower(x["value"]) == F.lower(d["value"]))))


def gender_hits(text: Column) -> Column:
    """ARRAY<STRING> of gender values as they stand: after a label, and "male" or "female" alone in a later line."""
    return F.concat(F.regexp_extract_all(text, F.lit(GENDER_LABELLED), 1), F.regexp_extract_all(text, F.lit(GENDER_ALONE), 1))


def record_ids(text: Column) -> Column:
    """ARRAY<STRING> of medical numbers, then of laboratory numbers, each after a label of its own."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in RECORD_IDS])


_DETECTION = "array<struct<entity:string,kind:string,value:string,source:string,score:double>>"


def detections(text: Column) -> Column:
    """ARRAY<STRUCT<entity, kind, value, source, score>>: what all detectors find, in the order recognisers, gender, record
    numbers, addresses of two lines. A word of its context in the characters before a value's first place raises the
    score of a recogniser's hit. Null texts give null; texts without digit or "@" are only searched for gender."""

    def scored(entity: str, score: float, words: list[str]):
        def of(v: Column) -> Column:
            at = F.instr(text, v)
            before = F.lower(F.substring(text, F.greatest(F.lit(1), at - CONTEXT_REACH), F.least(F.lit(CONTEXT_REACH), at - 1)))
            near = reduce(lambda a, b: a | b, [F.contains(before, F.lit(w)) for w in words]) if words else F.lit(False)
            return F.struct(F.lit(entity).alias("entity"), F.lit(ENTITY_TYPES[entity]).alias("kind"), v.alias("value"), F.lit("pattern").alias("source"), F.least(F.lit(1.0), F.lit(score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)).alias("score"))

        return of

    plain = lambda entity, kind, source, score: lambda v: F.struct(F.lit(entity).alias("entity"), F.lit(kind).alias("kind"), v.alias("value"), F.lit(source).alias("source"), F.lit(score).alias("score"))
    hits = [F.transform(_extracted(text, p), scored(e, SCORES[e], CONTEXT.get(e, []))) for e, p in RECOGNISERS]
    gender = F.transform(gender_hits(text), plain("GENDER", "gender", "gender", 0.98))
    none = F.array().cast("array<string>")
    # what each of the two must hold is looked for first
    records = F.when(text.rlike("(?i)(?:mrn|lab)-[0-9]"), record_ids(text)).otherwise(none)
    addresses = F.when(text.rlike("[A-Za-z]{2}[ \\t]+[0-9]{5}"), multiline_addresses(text)).otherwise(none)
    others = [F.transform(records, plain("MEDICAL_ID", "medical_id", "record", 0.95)), F.transform(addresses, plain("ADDRESS", "address", "address", 0.9))]
    numbered = F.concat(*[h.cast(_DETECTION) for h in hits], gender.cast(_DETECTION), *[h.cast(_DETECTION) for h in others])
    return F.when(text.rlike("[0-9@]"), numbered).when(text.isNotNull(), gender.cast(_DETECTION))


def confident(found: Column, floor: float = 0.2) -> Column:
    """Detections with a score of `floor` or more."""
    return F.filter(found, lambda d: d["score"] >= floor)


def personal_values(json: Column) -> Column:
    """ARRAY<STRING>: the texts at any depth of a JSON object whose own name, or that of the list they stand in, says that
    they are personal data; normalised, each once. Unparsable texts give none."""
    body = F.to_json(whole_json(json))
    name = f"[^\"\\\\]*(?:{'|'.join(PERSONAL_FIELDS)})[^\"\\\\]*"
    text = r'"((?:[^"\\]|\\.)*)"'
    single = F.regexp_extract_all(body, F.lit(rf'(?i)"{name}":{text}'), 1)
    lists = F.regexp_extract_all(body, F.lit(rf'(?i)"{name}":\[((?:[^\[\]{{}}"]|"(?:[^"\\]|\\.)*")*)\]'), 1)
    listed = F.flatten(F.transform(lists, lambda x: F.regexp_extract_all(x, F.lit(text), 1)))
    plain = F.transform(F.concat(single, listed), lambda v: normalised(F.get_json_object(F.concat(F.lit('{"v":"'), v, F.lit('"}')), "$.v")))
    return F.coalesce(F.filter(F.array_distinct(plain), lambda v: v.isNotNull() & (v != "")), F.array().cast("array<string>"))


def expanded_address(text: Column, value: Column) -> Column:
    """The first line that holds a value, with the next line if that has a state and postal code; the value, trimmed, where
    no line holds it."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    low = F.lower(value)
    pairs = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(lines, i + 1), F.lit("")).alias("next")))
    first = F.get(F.filter(pairs, lambda p: F.contains(F.lower(p["line"]), low)), F.lit(0))
    goes_on = first["next"].rlike(r"(?:^|[^A-Za-z0-9_])[A-Z]{2}\s+[0-9]{5}(?:-[0-9]{4})?(?:[^A-Za-z0-9_]|$)")
    both = F.concat(first["line"], F.when(F.contains(first["line"], F.lit(",")), " ").otherwise(", "), first["next"])
    return F.when(first.isNull(), F.trim(value)).when(goes_on, both).otherwise(first["line"])


def multiline_addresses(text: Column) -> Column:
    """ARRAY<STRING>: street lines joined with a next line of town, state and postal code."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t\\f\\r]+", " "))), lambda x: x != "")
    street = r"(?i)^[0-9]+[A-Za-z0-9_ .,#/-]*(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|court|ct|place|pl|boulevard|blvd|plaza|parkway|pkwy|apt|apartment|suite|ste|unit)(?:[ .,#/-][A-Za-z0-9_ .,#/-]*)?$"
    town = r"(?i)^([a-z .]+?),? ([a-z]{2}) ([0-9]{5}(?:-[0-9]{4})?)$"
    pairs = F.zip_with(lines, F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.size(lines) - 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hits = F.filter(pairs, lambda p: p["b"].isNotNull() & p["a"].rlike(street) & p["b"].rlike(town))
    return F.transform(hits, lambda p: F.concat(p["a"], F.lit(", "), F.trim(F.regexp_extract(p["b"], town, 1)), F.lit(", "), F.upper(F.regexp_extract(p["b"], town, 2)), F.lit(" "), F.regexp_extract(p["b"], town, 3)))


def precision_recall(found: Column, truth: Column) -> list[Column]:
    """true_positives, detected, expected, precision and recall of two ARRAY<STRING>, as sets of normalised values.

    Nothing detected has precision 1 if nothing was to be found, else 0; nothing to be found has recall 1.
    """
    clean = lambda a: F.filter(F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), normalised)), lambda v: v.isNotNull() & (v != ""))
    d, r = clean(found), clean(truth)
    tp, nd, nr = F.size(F.array_intersect(d, r)), F.size(d), F.size(r)
    precision = F.when(nd > 0, tp / nd).when(nr == 0, 1.0).otherwise(0.0)
    recall = F.when(nr > 0, tp / nr).otherwise(1.0)
    return [tp.alias("true_positives"), nd.alias("detected"), nr.alias("expected"), precision.alias("precision"), recall.alias("recall")]


def micro_average(df: DataFrame) -> DataFrame:
    """precision and recall over all rows of `precision_recall` columns."""
    total = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("true_positives", "detected", "expected")])
    tp, d, r = F.col("true_positives"), F.col("detected"), F.col("expected")
    return total.select("*", F.when(d > 0, tp / d).otherwise(1.0).alias("precision"), F.when(r > 0, tp / r).otherwise(1.0).alias("recall"))
