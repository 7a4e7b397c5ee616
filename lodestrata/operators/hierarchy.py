"""Parent-child rows of unknown depth to paths, depths, roots, descendants and circles.

Method: partition-local parent chains are contracted to fragments, each known by
its topmost node and its exit (the parent it has in another partition). The
fragments form a much smaller quotient forest, which is solved the same way,
recursively with fewer partitions; the solution is then expanded back to the
nodes. Circles show either inside one partition or, in the quotient, as circles
of fragments; the smallest node on a circle is carried along the contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.session import materialize

#: Most nodes in one partition of the contraction (about 200 bytes each in memory).
FRAGMENT_ROWS = 250_000

#: An edge to solve: node, parent (null at a root), levels between them, smallest id from the node up to
#: below its parent, ids and titles on that way (top down), nodes it stands for, where it lies.
_EDGE = "id string, parent string, step bigint, low string, ids array<string>, titles array<string>, weight bigint, place string"
_LOCAL = (
    "id string, place string, top string, depth bigint, low string, ids array<string>, titles array<string>, "
    "exit string, exit_step bigint, exit_low string, exit_ids array<string>, exit_titles array<string>, circle string, below bigint"
)


def contract_partition(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow parent chains within one partition (input ``_EDGE``, output ``_LOCAL``).

    ``top`` is the last node reached, ``exit`` its parent outside, ``depth``, ``low``, ``ids`` and
    ``titles`` tell the way below the top, ``below`` the weight of the local subtree with the node itself.
    On or below a local circle, ``circle`` is the smallest id on it and the rest is null.
    """
    n = len(pdf)
    node, parent = pdf["id"].tolist(), pdf["parent"].tolist()
    step, low = pdf["step"].tolist(), pdf["low"].tolist()
    ids, titles = [list(x) for x in pdf["ids"]], [list(x) for x in pdf["titles"]]
    below = pdf["weight"].tolist()
    at = {x: i for i, x in enumerate(node)}
    up = [at.get(p, -1) if p is not None else -1 for p in parent]
    top: list = [None] * n
    circle: list = [None] * n
    depth, low_in, ids_in, titles_in = [0] * n, [None] * n, [[] for _ in range(n)], [[] for _ in range(n)]
    state, order = [0] * n, []
    for start in range(n):
        chain, i = [], start
        while i >= 0 and state[i] == 0:
            state[i] = 1
            chain.append(i)
            i = up[i]
        if i >= 0 and state[i] == 1:  # the walk met itself: all from i on is a circle
            ring = chain[chain.index(i) :]
            least = min(low[j] for j in ring)
            for j in ring:
                circle[j], state[j] = least, 2
        for j in reversed(chain):
            if state[j] == 2:
                continue
            state[j], u = 2, up[j]
            order.append(j)
            if u < 0:
                top[j] = node[j]
            elif circle[u] is not None:
                circle[j] = circle[u]
            else:
                top[j], depth[j] = top[u], depth[u] + step[j]
                low_in[j] = low[j] if low_in[u] is None else min(low[j], low_in[u])
                ids_in[j], titles_in[j] = ids_in[u] + ids[j], titles_in[u] + titles[j]
    for j in reversed(order):
        if up[j] >= 0 and circle[j] is None:
            below[up[j]] += below[j]
    is_top = [up[j] < 0 for j in range(n)]
    return pd.DataFrame(
        {
            "id": node, "place": pdf["place"].tolist(), "top": top, "depth": depth, "low": low_in, "ids": ids_in, "titles": titles_in,
            "exit": [parent[j] if is_top[j] else None for j in range(n)], "exit_step": [step[j] if is_top[j] else None for j in range(n)], "exit_low": [low[j] if is_top[j] else None for j in range(n)],
            "exit_ids": [ids[j] if is_top[j] else None for j in range(n)], "exit_titles": [titles[j] if is_top[j] else None for j in range(n)], "circle": circle, "below": below,
        }
    ).astype({"exit_step": "Int64"})


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = [b for b in batches if len(b)]
    if parts:
        yield contract_partition(pd.concat(parts, ignore_index=True))


def _fragments(edges: DataFrame, parts: int) -> DataFrame:
    """Contraction along places: neighbours share a partition, chains inside it become fragments."""
    near = edges.repartition(1) if parts == 1 else edges.repartitionByRange(parts, "place", "id")
    return near.mapInPandas(_whole, _LOCAL)


def _stars(edges: DataFrame) -> DataFrame:
    """Contraction by coins, where places no longer help: a node showing tails joins a parent showing heads.

    Needs no partition to hold a node with its parent, so a node with any number of children is no burden;
    about a quarter of a chain's nodes go each time. All parents must be nodes.
    """
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit("coin"), F.length(c)), F.lit(2)) == 0
    tossed = edges.withColumn("moves", F.coalesce(~heads("id") & heads("parent"), F.lit(False)))
    none = F.lit(None)
    moved = tossed.where("moves").select(
        "id", "place", F.col("parent").alias("top"), F.col("step").alias("depth"), "low", "ids", "titles", none.cast("string").alias("exit"), none.cast("bigint").alias("exit_step"),
        none.cast("string").alias("exit_low"), none.cast("array<string>").alias("exit_ids"), none.cast("array<string>").alias("exit_titles"), none.cast("string").alias("circle"), F.col("weight").alias("below"),
    )
    gained = tossed.where("moves").groupBy(F.col("parent").alias("id")).agg(F.sum("weight").alias("gained"))
    empty = F.array().cast("array<string>")
    stay = tossed.where("not moves").join(gained, "id", "left").select(
        "id", "place", F.col("id").alias("top"), F.lit(0).cast("bigint").alias("depth"), none.cast("string").alias("low"), empty.alias("ids"), empty.alias("titles"), F.col("parent").alias("exit"), F.col("step").alias("exit_step"),
        F.col("low").alias("exit_low"), F.col("ids").alias("exit_ids"), F.col("titles").alias("exit_titles"), none.cast("string").alias("circle"), (F.col("weight") + F.coalesce("gained", F.lit(0))).alias("below"),
    )
    return moved.unionByName(stay)


def solve(edges: DataFrame, parts: int, rows: int, coins: bool = False) -> DataFrame:
    """(id, root, depth, ids, titles, circle, below) of every edge of ``_EDGE``; ids are unique.

    ``parts``: partitions of this level; ``rows``: number of edges. A node whose parent is no node is a root.
    """
    local = materialize(_stars(edges) if coins else _fragments(edges, parts), "fragments")
    exits = local.where("exit is not null and circle is null")
    # Where a fragment's exit lies: in which fragment, how deep, whether on a circle.
    into = local.select(
        F.col("id").alias("exit"), F.col("top").alias("to_top"), F.col("depth").alias("to_depth"), F.col("low").alias("to_low"),
        F.col("ids").alias("to_ids"), F.col("titles").alias("to_titles"), F.col("circle").alias("to_circle"),
    )
    links = materialize(
        exits.join(into, "exit", "left").select(
            "id", "place", "exit", "to_top", "to_circle",
            (F.col("exit_step") + F.col("to_depth")).alias("step"),
            F.least("exit_low", "to_low").alias("low"),
            F.concat("to_ids", "exit_ids").alias("ids"), F.concat("to_titles", "exit_titles").alias("titles"),
            F.col("below").alias("weight"),
        ),
        "links",
    )
    n = links.where("to_top is not null or to_circle is not null").count() if parts > 1 or coins else 0
    own = local.where("circle is null")
    if n == 0:
        done = own.select("id", F.col("top").alias("root"), "depth", "ids", "titles", F.lit(None).cast("string").alias("circle"), "below", "top", "exit_titles", "exit_ids")
    else:
        none = F.array().cast("array<string>")
        # The quotient: fragments with a live exit and the fragments these lead to.
        live = links.where("to_top is not null").select("id", F.col("to_top").alias("parent"), "step", "low", "ids", "titles", "weight", "place")
        ends = (
            local.where("top = id").join(live.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").join(live.select("id"), "id", "left_anti")
            .select("id", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("step"), F.col("id").alias("low"),
                    none.alias("ids"), none.alias("titles"), F.col("below").alias("weight"), "place")
        )
        quotient = materialize(live.unionByName(ends), "quotient")
        size = quotient.count()
        fewer = math.ceil(size / FRAGMENT_ROWS) if size else 1
        above = solve(quotient, fewer, size, coins=fewer > 1 and size > rows // 2)
        # A fragment whose exit lies on or below a local circle is below it, and so is what hangs on it.
        cursed = links.where("to_circle is not null").select("id", F.col("to_circle").alias("curse"))
        above = above.join(cursed.withColumnRenamed("id", "root"), "root", "full_outer").select(
            F.coalesce("id", "root").alias("top"), F.coalesce("circle", "curse").alias("top_circle"), F.when(F.col("id").isNotNull(), F.col("root")).alias("top_root"),
            F.col("depth").alias("top_depth"), F.col("ids").alias("top_ids"), F.col("titles").alias("top_titles"), F.col("below").alias("top_below"),
        )
        above = materialize(above, "above")
        # Whole subtrees hanging on a node through exits count for it and all local nodes above it.
        hung = live.join(above.select(F.col("top").alias("id"), "top_below"), "id").join(links.select("id", "exit"), "id").groupBy(F.col("exit").alias("id")).agg(F.sum("top_below").alias("hung"))
        done = _recount(own, hung).join(above.drop("top_below"), "top", "left").select(
            "id", F.coalesce("top_root", "top").alias("root"), (F.col("depth") + F.coalesce("top_depth", F.lit(0))).alias("depth"),
            F.concat(F.coalesce("top_ids", none), "ids").alias("ids"), F.concat(F.coalesce("top_titles", none), "titles").alias("titles"),
            F.col("top_circle").alias("circle"), "below", "top", "exit_titles", "exit_ids",
        )
    broken = local.where("circle is not null").select("id", F.lit(None).cast("string").alias("root"), F.lit(-1).cast("bigint").alias("depth"), "ids", "titles", "circle", F.lit(-1).cast("bigint").alias("below"))
    return done.drop("top", "exit_titles", "exit_ids").unionByName(broken)


def _recount(own: DataFrame, hung: DataFrame) -> DataFrame:
    """``own`` with ``below`` raised by what hangs on the node or on local nodes below it."""
    # A node's ids name its local ancestors, so what hangs on it is added to each of them; only exits' targets are exploded.
    gain = own.join(hung, "id").select(F.explode(F.array_union(F.concat(F.array("top"), "ids"), F.array("id"))).alias("id"), "hung").groupBy("id").agg(F.sum("hung").alias("gain"))
    return own.join(gain, "id", "left").withColumn("below", F.col("below") + F.coalesce("gain", F.lit(0))).drop("gain")


def resolve(df: DataFrame, node: str, parent: str, title: str, place: str, order: str, latest: str) -> DataFrame:
    """Every node's place in its tree, one row per distinct node id.

    Columns: id, parent, root, depth, path_ids, path (titles from the root down, null titles as ''),
    n_descendants, circle (smallest id on the circle the node lies on or below, else null). A node with no
    parent, a blank one or one that is no node is a root of depth 0. On or below a circle, root, path and
    path_ids are null and depth and n_descendants -1. Rows delivered again count once, the latest one by
    ``latest`` (ties by content); null ids give no row. ``place`` and ``order`` only tell which rows lie near
    each other. An empty table gives an empty result.
    """
    text = lambda c: F.col(c).cast("string")
    rows = (
        df.where(F.col(node).isNotNull())
        .select(
            text(node).alias("id"),
            F.struct(
                F.col(latest).alias("t"), F.when(F.trim(text(parent)) != "", text(parent)).alias("parent"), F.coalesce(text(title), F.lit("")).alias("title"),
                F.concat_ws("\u0001", F.coalesce(text(place), F.lit("")), F.lpad(F.coalesce(text(order), F.lit("")), 20, "0")).alias("place"),
            ).alias("row"),
        )
        .groupBy("id").agg(F.max("row").alias("row")).select("id", "row.parent", "row.title", "row.place")
    )
    rows = materialize(rows, "nodes")
    count = rows.count()
    edges = rows.select(
        "id", "parent", F.lit(1).cast("bigint").alias("step"), F.col("id").alias("low"), F.array("id").alias("ids"), F.array("title").alias("titles"), F.lit(1).cast("bigint").alias("weight"), "place"
    )
    parts = max(math.ceil(count / FRAGMENT_ROWS), min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(count / 10_000)), 1)
    done = solve(edges, parts, count)
    fine = F.col("circle").isNull()
    names = rows.select(F.col("id").alias("root"), F.col("title").alias("root_title"))
    return (
        done.join(rows.select("id", "parent"), "id").join(names, "root", "left")
        .select(
            "id", "parent", F.when(fine, F.col("root")).alias("root"), F.when(fine, F.col("depth")).otherwise(-1).alias("depth"),
            F.when(fine, F.concat(F.array("root"), "ids")).alias("path_ids"), F.when(fine, F.concat(F.array("root_title"), "titles")).alias("path"),
            F.when(fine, F.col("below") - 1).otherwise(-1).alias("n_descendants"), "circle",
        )
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of nodes that aren't on or below a circle."""
    return (
        resolved.where("circle is null and depth > 0")
        .select(F.col("id").alias("descendant"), "depth", F.posexplode(F.slice("path_ids", 1, F.col("depth").cast("int"))).alias("at", "ancestor"))
        .select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("bigint").alias("distance"))
    )


def found(sections: DataFrame) -> DataFrame:
    """p2: (section_id, root_section_id, tree_depth, n_descendants)."""
    return resolve(sections, "section_id", "parent_section_id", "section_title", "job_result_id", "sort_order", "created_at").select(
        F.col("id").alias("section_id"), F.coalesce("circle", "root").alias("root_section_id"), F.col("depth").alias("tree_depth"), "n_descendants"
    )


