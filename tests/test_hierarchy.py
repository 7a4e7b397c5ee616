import datetime
import random

import pytest

from lodestrata.operators import hierarchy

SCHEMA = "id string, parent string, title string, place string, ord int, t timestamp"
T0 = datetime.datetime(2025, 1, 1)


def brute(links):
    """id -> (root, depth, path, descendants), by walking."""
    kids = {}
    for i, p in links.items():
        kids.setdefault(p if p in links else None, []).append(i)
    out = {}
    for i in links:
        seen, x = [], i
        while x in links and x not in seen:
            seen.append(x)
            x = links[x]
        if x in links:
            out[i] = (min(seen[seen.index(x) :]), -1, None, -1)
        else:
            todo, n = list(kids.get(i, [])), 0
            while todo:
                n += 1
                todo += kids.get(todo.pop(), [])
            out[i] = (seen[-1], len(seen) - 1, tuple(reversed(seen)), n)
    return out


def run(spark, links, place=lambda i: "x", again=()):
    rows = [(i, p, f"T{i}", place(i), n, T0) for n, (i, p) in enumerate(links.items())]
    df = spark.createDataFrame(rows + [r for r in rows if r[0] in again], SCHEMA)
    got = hierarchy.resolve(df, "id", "parent", "title", "place", "ord", "t").collect()
    assert len(got) == len(links)
    return {r.id: (r.circle or r.root, r.depth, tuple(r.path_ids) if r.path_ids else None, r.n_descendants) for r in got}, got


def random_links(seed, n):
    rng = random.Random(seed)
    ids = [f"n{rng.randrange(10**6):06d}_{k}" for k in range(n)]
    return {i: rng.choice([None, "", "gone", *[rng.choice(ids)] * 9]) for i in ids}


@pytest.mark.parametrize("bound", [250_000, 30])
def test_matches_walking_at_any_fragment_size(spark, monkeypatch, bound):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", bound)
    links = random_links(bound, 40)
    links = {i: (p or None) for i, p in links.items()}
    got, rows = run(spark, links, place=lambda i: i[:2], again=set(list(links)[:20]))
    assert got == brute(links)
    assert all(r.path == [f"T{x}" for x in r.path_ids] for r in rows if r.path_ids)


def test_long_chain_and_long_circle_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 30)
    links = {f"c{k:03d}": f"c{k - 1:03d}" if k else None for k in range(24)} | {f"r{k:02d}": f"r{(k * 7 + 1) % 12:02d}" for k in range(12)} | {"z1": "r05", "z2": "z1", "s": "s"}
    assert run(spark, links, place=lambda i: str(hash(i) % 5))[0] == brute(links)


def test_star_with_many_children(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "FRAGMENT_ROWS", 30)
    links = {"hub": None} | {f"k{k:03d}": "hub" for k in range(30)} | {f"l{k:03d}": f"k{k:03d}" for k in range(8)}
    assert run(spark, links, place=lambda i: i[1:])[0] == brute(links)


def test_empty_nulls_and_clashing_columns(spark):
    assert hierarchy.resolve(spark.createDataFrame([], SCHEMA), "id", "parent", "title", "place", "ord", "t").count() == 0
    df = spark.createDataFrame([(None, "a", None, None, None, None), ("a", None, None, None, None, None), ("b", "a", "x/y", None, None, None)], "root string, depth string, title string, low string, top int, circle timestamp")
    got = {r.id: r for r in hierarchy.resolve(df, "root", "depth", "title", "low", "top", "circle").collect()}
    assert set(got) == {"a", "b"} and got["b"].path == ["", "x/y"] and got["a"].n_descendants == 1


def test_descendants(spark):
    df = spark.createDataFrame([(i, p, i, "x", 0, T0) for i, p in [("a", None), ("b", "a"), ("c", "b"), ("q", "q")]], SCHEMA)
    pairs = hierarchy.descendants(hierarchy.resolve(df, "id", "parent", "title", "place", "ord", "t")).collect()
    assert {tuple(r) for r in pairs} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_contraction_by_coins(spark):
    links = {f"c{k:02d}": f"c{k - 1:02d}" if k else None for k in range(14)} | {f"r{k}": f"r{(k + 1) % 6}" for k in range(6)} | {"t1": "r2", "t2": "t1", "b": "c03"}
    edges = spark.createDataFrame([(i, p, 1, i, [i], [i], 1, "x") for i, p in links.items()], hierarchy._EDGE)
    got = {r.id: (r.circle or r.root, r.depth, None if r.circle else (r.root, *r.ids), -1 if r.circle else r.below - 1) for r in hierarchy.solve(edges, 2, len(links), coins=True).collect()}
    want = brute(links)
    assert {i: (a, None if c is None else b, c, d) for i, (a, b, c, d) in got.items()} == {i: (a, None if c is None else b, c, d) for i, (a, b, c, d) in want.items()}
