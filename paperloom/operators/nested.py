"""Nested JSON records as flat tables with parent-child links.

One projection does the whole tree: a fold over a per-row sequence expands a frontier of containers level by
level. Each step is a `transform` that attaches keys and list positions to the children of a node and a `flatten`
that joins the levels; a single `inline` emits the rows. The sequence is as long as the text has opening brackets,
which bounds its depth, so no depth is fixed in advance and nothing is collected or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The state of the fold: containers still to be opened, and the objects found so far.
_NODE = "struct<path:string,owner:string,v:variant,is_object:boolean>"
_FOUND = "struct<node_path:string,parent_path:string,depth:int,v:variant>"


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def whole_json(text: Column) -> Column:
    """The text as VARIANT if all of it is one JSON value, else null.

    The parser stops after the first value, so the text is read as the only item of a list: what follows it then
    makes the list invalid or longer.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    closed = F.when(text.rlike(r"^\s*\{"), text.rlike(r"\}\s*$")).when(text.rlike(r"^\s*\["), text.rlike(r"\]\s*$")).otherwise(True)
    return F.when(closed & (F.size(_get(listed, "array<variant>")) == 1), F.try_variant_get(listed, "$[0]", "variant"))


def _embedded(text: Column) -> Column:
    """A string whose whole content is an object or a list, as that value; else null."""
    return F.when(text.rlike(r"^\s*[\[{]"), whole_json(text))


def _opened(v: Column, is_container: Column) -> Column:
    """The container itself, or the container that a string holds; null for every other value."""
    return F.when(is_container, v).otherwise(_embedded(_get(v, "string")))


def _is_object(v: Column) -> Column:
    return _get(v, "map<string,variant>").isNotNull()


def _is_container(v: Column) -> Column:
    return _is_object(v) | _get(v, "array<variant>").isNotNull()


def _children(node: Column) -> Column:
    """The containers directly inside a container, each with its path and nearest enclosing object."""
    path, owner = node["path"], node["owner"]
    members = _get(node["v"], "map<string,variant>")
    items = _get(node["v"], "array<variant>")

    def member(entry: Column) -> Column:
        key = F.when(path == "", entry["key"]).otherwise(F.concat(path, F.lit("."), entry["key"]))
        return F.struct(key.alias("path"), path.alias("owner"), entry["value"].alias("v"))

    def item(value: Column, at: Column) -> Column:
        return F.struct(F.concat(path, F.lit("["), at.cast("string"), F.lit("]")).alias("path"), owner.alias("owner"), value.alias("v"))

    inner = F.when(node["is_object"], F.transform(F.map_entries(members), member)).otherwise(F.transform(items, item))
    # numbers, booleans, nulls and plain strings are leaves; what remains is opened and typed once
    kept = F.transform(
        inner,
        lambda c: F.struct(
            c["path"].alias("path"),
            c["owner"].alias("owner"),
            _opened(c["v"], _is_container(c["v"])).alias("v"),
        ),
    )
    return F.transform(
        F.filter(kept, lambda c: c["v"].isNotNull()),
        lambda c: F.struct(c["path"].alias("path"), c["owner"].alias("owner"), c["v"].alias("v"), _is_object(c["v"]).alias("is_object")),
    )


def node_array(text: Column) -> Column:
    """ARRAY<STRUCT<node_path, parent_path, depth, v>> of all objects below the root of a JSON text.

    Null, blank and unparsable texts, scalars and empty containers give an empty array.
    """
    root = whole_json(text)
    root = _opened(root, _is_container(root))
    brackets = F.length(text) - F.length(F.translate(text, "{[", ""))
    start = F.struct(
        F.array(F.struct(F.lit("").alias("path"), F.lit("").alias("owner"), root.alias("v"), _is_object(root).alias("is_object"))).cast(f"array<{_NODE}>").alias("open"),
        F.array().cast(f"array<{_FOUND}>").alias("found"),
    )

    def step(state: Column, level: Column) -> Column:
        nxt = F.flatten(F.transform(state["open"], _children)).cast(f"array<{_NODE}>")
        return F.struct(nxt.alias("open"), state["found"].alias("found"))

    def collect(state: Column, level: Column) -> Column:
        rows = F.transform(
            F.filter(state["open"], lambda n: n["is_object"]),
            lambda n: F.struct(n["path"].alias("node_path"), n["owner"].alias("parent_path"), level.alias("depth"), n["v"].alias("v")),
        ).cast(f"array<{_FOUND}>")
        return F.struct(state["open"].alias("open"), F.concat(state["found"], rows).alias("found"))

    def advance(state: Column, level: Column) -> Column:
        return F.when(F.size(state["open"]) == 0, state).otherwise(collect(step(state, level), level))

    nodes = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), brackets)), start, advance, lambda s: s["found"])
    return F.when(root.isNotNull(), nodes).otherwise(F.array().cast(f"array<{_FOUND}>"))


def nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per JSON object below the root of `text`: row_key, node_path, parent_path, depth, relation, fields.

    relation is the path without list positions, the name of the flat table the row belongs to; fields holds the
    scalar members as strings. Rows with a null key are kept; rows sent twice come twice (see `links`).
    """
    out = df.select(F.col(key).cast("string").alias("row_key"), F.inline(node_array(F.col(text))))
    members = _get(F.col("v"), "map<string,variant>")
    scalar = F.map_filter(members, lambda _, x: ~_is_container(x))
    return out.select(
        "row_key", "node_path", "parent_path", "depth",
        F.regexp_replace("node_path", r"\[\d+\]", "").alias("relation"),
        F.transform_values(scalar, lambda _, x: _get(x, "string")).alias("fields"),
    )


def relation(found: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The flat table `name` of `nodes`: its links and the named scalar members as string columns."""
    picked = [F.element_at("fields", c).alias(c) for c in columns]
    return found.where(F.col("relation") == name).select("row_key", "node_path", "parent_path", *picked)


def links(df: DataFrame, key: str, text: str, table_name: str) -> DataFrame:
    """table_name, row_key, node_path, parent_path of every nested object, each once however often a row was sent."""
    pairs = F.transform(node_array(F.col(text)), lambda n: F.struct(n["node_path"].alias("node_path"), n["parent_path"].alias("parent_path")))
    return df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("row_key"), F.inline(pairs))
