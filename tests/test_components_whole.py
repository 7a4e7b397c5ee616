import pytest

from lodestrata.plans import registry


def brute(edges):
    least = {}

    def top(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        least[b] = a
    return {x: top(x) for x in list(least)}


@pytest.mark.parametrize("whole", [True, False])
def test_components_of_all_edges(spark, tmp_path, whole):
    edges = [(k, k % 40 if whole else k) for k in range(1, 400)] + [(1, None), (1, 1), (1, 1)]
    df = spark.createDataFrame([(a, b, 1.0 + a % 50) for a, b in edges], "l_partkey bigint, l_suppkey bigint, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = registry.queries()["tab_08_all_components"](spark, str(tmp_path)).collect()
    want = brute([(a, b + 1000000) for a, b in edges if b is not None])
    assert "tab_08_all_components" not in registry.oracle_sql()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want
