import pytest
from pyspark.sql import functions as F

from lodestrata.operators import maps


def test_map_folds_the_least_scored_subtrees():
    nodes = [("A", "sum", 0.0), ("A / b", "x" * 50, 5.0), ("A / c", None, 0.1), ("A / c / d", None, 0.2), ("A / e", None, 9.0)]
    assert maps.render_map(nodes, budget=1000).split("\n")[0] == "- A: sum"
    assert maps.render_map(nodes, budget=40) == "- A\n  - b\n  - c\n    - d\n  - e"
    assert maps.render_map(nodes, budget=27) == "- A (+2 below)\n  - b\n  - e"
    long = [("A", None, 0.0), ("A / " + "b" * 40, None, 5.0), ("A / c", None, 0.1), ("A / c / d", None, 0.2), ("A / e", None, 9.0)]
    assert maps.render_map(long, keep={"A / c / d"}, budget=40) == "- A (+1 below)\n  - c\n    - d\n  - e"
    with pytest.raises(ValueError):
        maps.render_map(nodes, budget=5)
    assert maps.render_map([], budget=5) == ""


def test_evidence_parts(spark):
    assets = [("[T1]", "table", "<t/>"), ("[I]", "image", "one"), ("[I2]", "image", "two"), ("[gone]", "image", "none")]
    assert maps.compose("a [T1] b [I] c [I2]", assets) == [("text", "a <t/> b"), ("image", "one"), ("text", "c"), ("image", "two")]
    df = spark.createDataFrame([("x [I] y", [("[I]", "image", "one")]), (None, None)], "t string, a array<struct<mark:string,kind:string,body:string>>")
    got = [[tuple(p) for p in r.p] for r in df.select(maps.composed(F.col("t"), F.col("a")).alias("p")).collect()]
    assert got == [[("text", "x"), ("image", "one"), ("text", "y")], []]


def test_satellites(spark):
    blocks = spark.createDataFrame(
        [("w", "s", "t1", 0, 0, 5, 5, True, True), ("w", "s", "t2", 0, 20, 5, 25, True, True), ("w", "s", "near", 0, 18, 0, 18, False, True), ("w", "o", "linked", 0, 0, 0, 0, False, False), ("w", "o", "chain", 3, 3, 3, 3, False, True), ("w", "o", "empty", 9, 9, 9, 9, False, False), ("v", "s", "alone", 0, 0, 0, 0, False, False)],
        "workbook string, sheet string, block string, r0 int, c0 int, r1 int, c1 int, is_table boolean, has_text boolean",
    )
    links = spark.createDataFrame([("w", "linked", "t1"), ("w", "chain", "linked")], "workbook string, a string, b string")
    got = {(r.block, r.host) for r in maps.attach_satellites(blocks, links).collect()}
    assert got == {("t1", "t1"), ("t2", "t2"), ("near", "t2"), ("linked", "t1"), ("chain", "t1"), ("alone", "alone")}
