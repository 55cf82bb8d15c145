"""Nested records against a recursive walk, and the defined cases."""

import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from paperloom.operators import nested


def walk(value, path, owner, out):
    if isinstance(value, str):
        try:
            value = json.loads(value) if value.strip()[:1] in ("{", "[") else None
        except ValueError:
            return
    if isinstance(value, dict):
        if path:
            out.append((path, owner))
        for k, v in value.items():
            walk(v, f"{path}.{k}" if path else k, path, out)
    elif isinstance(value, list):
        for i, v in enumerate(value):
            walk(v, f"{path}[{i}]", owner, out)


def links(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "k long, t string, node_path string")
    return sorted((r.row_key, r.node_path, r.parent_path) for r in nested.links(df, "k", "t", "t").collect())


def expected(texts):
    out = []
    for i, t in enumerate(texts):
        try:
            value = json.loads(t) if t is not None else None
        except ValueError:
            continue
        found = []
        walk(value, "", "", found)
        out += [(str(i), a, b) for a, b in found]
    return sorted(out)


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-9, 9), st.text("ab {[\"\\", max_size=4))
TREE = st.recursive(LEAF, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.text("abc", min_size=1, max_size=2), c, max_size=3)), max_leaves=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TREE, min_size=8, max_size=20))
def test_random_trees(spark, trees):
    texts = [json.dumps(t) for t in trees] + [json.dumps({"s": json.dumps(t)}) for t in trees]
    assert links(spark, texts) == expected(texts)


def test_defined_cases(spark):
    deep = "{}"
    for _ in range(60):
        deep = '{"a":[%s]}' % deep
    texts = [None, "", "  ", "3", '"x"', "[]", "{}", '{"a":{}', '{"a":{}} x', '{"a":{}} {"b":{}}', "[[{}]]", '{"a":"[1,{\\"b\\":2}]"}', deep, '{"long":"%s","o":{}}' % ("y" * 50_000)]
    assert links(spark, texts) == expected(texts)
    assert links(spark, []) == []


def test_tables_and_repeats(spark):
    df = spark.createDataFrame([(1, '{"a":{"x":1,"l":[{"y":"p"},{"y":"q"}]}}')] * 2 + [(None, '{"a":{}}')], "k long, t string")
    rows = nested.nodes(df, "k", "t")
    table = nested.relation(rows, "a.l", ["y"]).distinct().orderBy("node_path").collect()
    assert [tuple(r) for r in table] == [("1", "a.l[0]", "a", "p"), ("1", "a.l[1]", "a", "q")]
    assert {r.depth for r in rows.where("relation = 'a.l'").collect()} == {3}
    assert rows.where("row_key is null").count() == 1
