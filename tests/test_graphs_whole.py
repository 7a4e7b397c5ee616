import os
import random

import pytest

from lodestrata.operators import graphs as G
from lodestrata.plans import registry


def test_overlaps_are_counted_without_shuffling_pairs(spark, monkeypatch):
    rng = random.Random(3)
    sets = spark.createDataFrame([(f"k{rng.randrange(40)}", f"item{rng.randrange(25)}") for _ in range(300)], "k string, i string")
    found = G.overlaps(sets, "k", "i", 0.2, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "hashpartitioning(a#" in line and ", b#" in line]
    here = {tuple(r) for r in found.collect()}
    monkeypatch.setattr(G, "BROADCAST_ITEMS", 0)
    assert here and here == {tuple(r) for r in G.overlaps(sets, "k", "i", 0.2, 2).collect()}


def test_edges_of_components_are_written_before_the_rounds(spark, monkeypatch):
    written, keep = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, label="step": written.append(label) or keep(df, label))
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a int, b int")
    assert {tuple(r) for r in G.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert written[0] == "edges"


def sharing(n, keys, items, seed=5):
    rng = random.Random(seed)
    rows = [(rng.choice(("é", "k", "Z", "\U0001f600")) + str(rng.randrange(keys)), "w" * rng.randrange(0, 9) + str(rng.randrange(items))) for _ in range(n)]
    return rows + rows[:9] + [("only", ""), ("nothing", ""), (None, "w1"), ("k0", None)]


def brute(rows, least, least_shared):
    sets = {}
    for k, i in rows:
        if k is not None and i is not None:
            sets.setdefault(k, set()).add(i)
    out = set()
    for a in sets:
        for b in sets:
            both = sets[a] & sets[b]
            if a < b and both and len(both) >= least_shared:
                total = min(sum(map(len, sets[x])) for x in (a, b))
                score = round(sum(map(len, both)) / total, 6) if total else None
                if least <= 0 or score is not None and score >= least:
                    out.add((a, b, len(both), score))
    return out


def test_beyond_broadcast_blocks_meet_and_no_pair_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_ITEMS", 0)
    rows = sharing(700, 60, 12)
    sets = spark.createDataFrame(rows, "k string, i string")
    for block, pairs, chunk in ((10**6, 10**9, 10**6), (50, 10**9, 10**6), (10**6, 40, 1), (100, 10**9, 33)):
        monkeypatch.setattr(G, "BLOCK_ITEMS", block)
        monkeypatch.setattr(G, "BLOCK_PAIRS", pairs)
        monkeypatch.setattr(G, "CHUNK_PAIRS", chunk)
        for least, least_shared in ((0.0, 1), (0.3, 2)):
            found = G.overlaps(sets, "k", "i", least, least_shared)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not [x for x in plan.splitlines() if "Exchange" in x and ("a#" in x or "b#" in x)]
            got = [tuple(r) for r in found.collect()]
            assert len(got) == len(set(got)) and set(got) == brute(rows, least, least_shared)


def test_sets_without_characters_share_too(spark):
    sets = spark.createDataFrame([("a", ""), ("b", ""), ("b", "x")], "k string, i string")
    assert [tuple(r) for r in G.overlaps(sets, "k", "i", 0.0, 1).collect()] == [("a", "b", 1, None)]
    assert G.overlaps(sets, "k", "i", 0.5, 1).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_document_graph_over_blocks(spark, monkeypatch):
    query = registry.queries()["set_04_cor_19_document_graph"]
    here = query(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(G, "BROADCAST_ITEMS", 0)
    met = query(spark, "/root/testdata/sf0.001")
    assert "MapInArrow" in met._jdf.queryExecution().executedPlan().toString()
    assert sorted(here) == sorted(met.collect()) and here
