import json

import pytest

from lodestrata.operators import nested


def test_equal_subtrees_share_an_identity_and_keep_all_places(spark):
    sub = {"title": "a", "children": [None, {"title": "b"}]}
    docs = [(1, json.dumps({"sections": [sub, sub]})), (2, json.dumps({"sections": {"children": [None, {"title": "b"}], "title": "a"}})), (2, json.dumps({"sections": {"children": [None, {"title": "b"}], "title": "a"}}))]
    df = spark.createDataFrame(docs, "id bigint, doc string")
    nodes = nested.nested_nodes(df, "id", "doc", "doc", nested.LISTS)
    places = [r for r in nested.occurrences(nodes).collect() if r.route == "sections"]
    assert {(r.record_id, r.pos, r.parent_pos) for r in places} == {(1, "0", ""), (1, "1", ""), (2, "0", "")}
    assert len({r.node_hash for r in places}) == 1
    assert nested.objects(nodes).where(nested.F.col("payload").contains('"b"')).count() == 1
    kids = [r for r in nested.occurrences(nodes).collect() if r.route == "sections.children"]
    assert {(r.record_id, r.pos, r.parent_pos) for r in kids} == {(1, "0/1", "0"), (1, "1/1", "1"), (2, "0/1", "0")}


def test_round_trip_of_objects(spark):
    value = {"a": [1, [{"x": None}, "t"], {"y": {"z": True}}], "b": {"c": "é"}, "n": None}
    df = spark.createDataFrame([(7, json.dumps(value))], "id bigint, doc string")
    nodes = nested.nested_nodes(df, "id", "doc", "d").collect()
    content = {r.node_hash: json.loads(r.payload) for r in nodes}

    def build(x):
        if isinstance(x, dict):
            return build(content[x["$ref"]]) if set(x) == {"$ref"} else {k: build(v) for k, v in x.items()}
        return [build(v) for v in x] if isinstance(x, list) else x

    assert build(content[next(r.node_hash for r in nodes if r.node == "")]) == value


def test_odd_records(spark):
    docs = [(1, None), (2, ""), (3, '{"sections":['), (4, '"[]"'), (5, "[1,2]"), (6, '{"x": NaN}'), (None, "{}"), (8, json.dumps(json.dumps({"sections": json.dumps([{"children": json.dumps({"t": 1})}])})))]
    nodes = nested.nested_nodes(spark.createDataFrame(docs, "id bigint, doc string"), "id", "doc", "d", nested.LISTS, r"sections.*").collect()
    assert {(r.record_id, r.pos, r.parent_pos) for r in nodes} == {(8, "0", ""), (8, "0/0", "0")}
    assert nested.nested_nodes(spark.createDataFrame([], "id bigint, doc string"), "id", "doc", "d").count() == 0


def test_very_deep_record(spark):
    deep = "{\"children\":[" * 1_500 + "{}" + "]}" * 1_500
    assert len(nested.record_nodes(nested.parse_json(deep), nested.LISTS)) == 1_501


@pytest.mark.parametrize("text", ['{"a":1}', "[]", "[1,[2,{}],null]", '{"a":{"b":[true,"x"]},"c":-1.5e3}', " 3 ", '{"a" : [ ] }'])
def test_deep_parser_agrees(text):
    assert nested._parse_deep(text) == json.loads(text)


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":1,}', "[1 2]", "1 2", '{"a"}', "{1:2}", "[}", "]"])
def test_deep_parser_rejects(text):
    with pytest.raises(ValueError):
        nested._parse_deep(text)


def test_found(spark):
    manifest = {"processing": {"cost_estimate": json.dumps({"by_model": {"m.1": {}, "m 2": 3}, "total_cost": " 5.2e-05"})}}
    packages = spark.createDataFrame([(1, json.dumps({"sections": [None, {"children": {"title": "x"}}]}), json.dumps(manifest))], "package_id bigint, doc_nav string, manifest string")
    examples = [{"question": {"text": "Why?"}, "citations": {"c": 1}}, {"question": " ", "citations": [None, {"c": 2}]}, {"question": "Who?"}, {"question": None}]
    catalog = spark.createDataFrame([(9, json.dumps({"catalog_metadata": {"examples": examples}}))], "catalog_line bigint, record_json string")
    got = {tuple(r) for r in nested.found(packages, catalog).collect()}
    assert got == {
        ("nav_section", 1, "1", ""), ("nav_section", 1, "1/0", "1"), ("cost_model", 1, "m.1", ""), ("cost_model", 1, "m 2", ""), ("total_cost", 1, "52", ""),
        ("example", 9, "0", ""), ("example", 9, "2", ""), ("citation", 9, "0/0", "0"), ("citation", 9, "1/1", "1"),
    }


def test_deep_parser_has_no_depth_limit():
    value = nested.parse_json("[" * 100_000 + "]" * 100_000)
    depth = 0
    while value:
        value, depth = value[0], depth + 1
    assert depth == 99_999
