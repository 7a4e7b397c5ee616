import datetime

import pandas as pd
from pyspark.sql import functions as F

from lodestrata.functions import statistics
from lodestrata.operators import publication as P
from lodestrata.operators import sheets

SCHEMA = "revision string, scope_key string, id string, path string, chunk_type string, sort_order int"


def test_replace_scope(spark):
    old = spark.createDataFrame([("r", "p1", "a", "A", "text", 0), ("r", "p2", "b", "B", "text", 1), ("r", "p3", "c", "C", "video", 2), ("q", "p1", "z", "Z", "text", 0)], SCHEMA)
    new = spark.createDataFrame([("r", "p2", "n1", "B", "text", 0), ("r", "p2", "n2", "B", "text", 1), ("r", "p2", "n3", None, "text", 2), ("r", "p2", "n4", None, "text", 3)], SCHEMA)
    scope = lambda s: spark.createDataFrame([("r", s)], "revision string, scope_key string")
    assert {(r.revision, r.id, r.sort_order) for r in P.replace_scope(old, new, scope("p2")).collect()} == {("r", "a", 0), ("r", "n1", 1), ("r", "n3", 2), ("r", "n4", 3), ("r", "c", 4), ("q", "z", 0)}
    assert {r.id for r in P.replace_scope(old, new, scope("*")).collect()} == {"n1", "n3", "n4", "c", "z"}


def test_section_order(spark):
    chunks = spark.createDataFrame([("r", "x", "1", "B / c", "text", 0), ("r", "x", "2", "A", "text", 1)], SCHEMA)
    sections = spark.createDataFrame([("r", p) for p in ("A", "B", "B / c", "Z", "Y")], "revision string, path string")
    assert [r.path for r in P.section_order(chunks, sections).orderBy("position").collect()] == ["B", "B / c", "A", "Y", "Z"]


def test_claims(spark):
    t = datetime.datetime(2025, 1, 1)
    rows = [("a", 1, "running", 1, t), ("a", 2, "queued", 1, t), ("b", 1, "failed", 3, t), ("c", 1, "failed", 1, t), ("d", 1, "running", 1, t), ("e", 1, "running", 1, t + datetime.timedelta(hours=1)), ("f", 4, "done", 1, t)]
    claims = spark.createDataFrame(rows, "key string, generation int, state string, attempts int, updated_at timestamp")
    now = F.lit("2025-01-01 01:00:10").cast("timestamp")
    assert {r.key for r in P.claimable(claims, now, 600, 3).collect()} == {"a", "c", "d"}
    done = spark.createDataFrame([("a", 1, "done"), ("d", 1, "done")], "key string, generation int, state string")
    assert {(r.key, r.state) for r in P.apply_completions(claims, done).collect()} >= {("a", "queued"), ("d", "done"), ("f", "done")}


def test_statistics_and_rendering():
    mean, low, high = statistics.paired_bootstrap([1, 2, 3, 4], [2, 3, 4, 5])
    assert mean == low == high == 1 and abs(statistics.zero_failure_bound(59) - 0.95) < 0.001 and statistics.percentile([1, 2, 3], 50) == 2
    cells = pd.DataFrame([(0, 0, "h", None), (0, 1, None, None), (1, 0, "<a>", None), (1, 1, 2, "=B1*2")], columns=["row", "col", "value", "formula"])
    assert sheets.render_sheet(cells, [(0, 0, 0, 1)]) == '<table><thead><tr><th colspan="2">h</th></tr></thead><tbody><tr><td>&lt;a&gt;</td><td data-formula="=B1*2">2</td></tr></tbody></table>'
    assert sheets.grid_of(sheets.render_sheet(cells, [(0, 0, 0, 1)])) == [["h", "h"], ["<a>", "2"]]
