import random
import time

import pyarrow as pa
import pytest

from lodestrata.operators import pages as P


def brute(boxes, gap):
    least = {i: i for _, i, *_ in boxes}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    placed = [b for b in boxes if None not in b]
    for n, (s, i, x0, y0, x1, y1) in enumerate(placed):
        for t, j, a0, b0, a1, b1 in placed[:n]:
            if s == t and x0 - gap <= a1 and a0 - gap <= x1 and y0 - gap <= b1 and b0 - gap <= y1:
                a, b = sorted((top(i), top(j)))
                least[b] = a
    return {i: top(i) for i in least}


def some_boxes(seed, n):
    rng = random.Random(seed)
    boxes = []
    for k in range(n):
        x, y = rng.randrange(-300, 300), rng.randrange(-300, 300)
        boxes.append((rng.choice("st"), f"b{rng.randrange(10**6)}-{k}", x, y, x + rng.choice((0, 3, 9, 120)), y + rng.randrange(0, 20)))
    # an id in two scopes ties both; one without a scope, one without a place, one twice in the same place
    return boxes + [("u", boxes[0][1], 0, 0, 5, 5), ("u", "last", 6, 6, 7, 7), (None, "none", 0, 0, 5, 5), ("s", "lost", None, 0, 5, 5), boxes[1]]


@pytest.mark.parametrize("whole, held", [(20_000, 200_000), (10, 200_000), (20_000, 3), (10, 0)])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, whole, held):
    monkeypatch.setattr(P, "SWEPT_WHOLE", whole)
    monkeypatch.setattr(P, "HELD", held)
    boxes = some_boxes(3, 300)
    got = P.cluster_boxes(spark.createDataFrame(boxes, "scope string, id string, x0 int, y0 int, x1 int, y1 int"), 6).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.component for r in got} == brute(boxes, 6)


def test_boxes_at_one_place_are_compared_with_one():
    """Forty thousand of them: all with all is some minutes."""
    n = 40_000
    names = ["scope", "strip", "id", "x0", "y0", "x1", "y1"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, ("s", 0, k, 1.0, 1.0, 2.0, 2.0))) for k in range(n)])
    began = time.time()
    got = [r for b in P._ties(iter([batch]), 6, 10**6) for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(got) == [(k, 0) for k in range(1, n)] and time.time() - began < 20


def test_wide_boxes_make_one_tie_each(spark, monkeypatch):
    """Before, each of these boxes was compared with every other in a thousand cells."""
    ties, keep = [], P.graphs.components
    monkeypatch.setattr(P.graphs, "components", lambda e, nodes: ties.append(e.count()) or keep(e, nodes))
    boxes = [("s", k, 0, k, 20_000, k + 1) for k in range(200)]
    got = P.cluster_boxes(spark.createDataFrame(boxes, "scope string, id bigint, x0 int, y0 int, x1 int, y1 int"), 6).collect()
    assert ties == [199] and {(r.node, r.component) for r in got} == {(k, 0) for k in range(200)}
