"""Document graph: keywords, overlaps, connected components, connections between chunks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.session import materialize

#: Relations followed when connections are expanded (fixed values).
FORWARD = ("embeds", "related", "derives")

#: Items of all sets up to which they are broadcast (some 120 bytes each), pairs that a task counts then, and tasks at most.
BROADCAST_ITEMS, TASK_PAIRS, MOST_TASKS = 100_000, 1_000_000, 5_000
#: Beyond: items of a block at most, pairs that two blocks make, blocks that are made for the sake of pairs only, and pairs counted at a time.
BLOCK_ITEMS, BLOCK_PAIRS, MOST_BLOCKS, CHUNK_PAIRS = 150_000, 8_000_000, 32, 250_000


def keywords(texts: DataFrame, scope: str, content: str, k: int = 10) -> DataFrame:
    """(scope, keyword, score, rank): the k best of tf * (ln(total / df) + 1) of each scope; tf over its texts, df over all texts.

    Words of one character and mere numbers don't count; ties by keyword.
    """
    words = texts.withColumn("_t", F.monotonically_increasing_id()).select(scope, "_t", F.explode(text.tokens(F.col(content))).alias("keyword")).where(~F.col("keyword").rlike(r"^\d+$"))
    counts = words.groupBy(scope, "_t", "keyword").agg(F.count(F.lit(1)).alias("n"))
    tf = counts.groupBy(scope, "keyword").agg(F.sum("n").alias("tf"))
    df = counts.groupBy("keyword").agg(F.count(F.lit(1)).alias("df"))
    total = texts.agg(F.count(F.lit(1)).alias("total"))
    scored = tf.join(df, "keyword").join(F.broadcast(total)).withColumn("score", F.round(F.col("tf") * (F.log(F.col("total") / F.col("df")) + 1), 6))
    w = Window.partitionBy(scope).orderBy(F.desc("score"), "keyword")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(scope, "keyword", "score", "rank")


def overlaps(sets: DataFrame, key: str, item: str, least: float = 0.8, least_shared: int = 3) -> DataFrame:
    """(a, b, shared, score) of keys whose item sets overlap: shared length over the smaller set's length, in characters.

    Sets meet on their items, never all with all. Items held by many keys make many pairs, which are
    never shuffled: up to ``BROADCAST_ITEMS`` items of all sets, they are counted where the one key's items lie;
    beyond, keys are divided into blocks, every two blocks meet in one task, and each item is sent once a block.
    A score over sets without characters is null, which only a ``least`` above 0 leaves out.
    """
    s = materialize(sets.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct(), "sets")
    s = s.where("k is not null and i is not null")
    items = s.count()
    pairs_of = s.groupBy("i").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
    if items > BROADCAST_ITEMS:
        pairs = _block_pairs(s, items, pairs_of // 2, least, least_shared)
    else:
        sized = materialize(s.join(s.groupBy("k").agg(F.sum(F.length("i")).alias("l")), "k"), "sized-sets")
        x, y = (sized.select(F.col("k").alias(side), "i", F.col("l").alias(f"l{side}")) for side in "ab")
        tasks = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        x, y = x.repartition(min(MOST_TASKS, max(tasks, pairs_of // TASK_PAIRS)), "a"), F.broadcast(y)
        pairs = x.join(y, "i").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.sum(F.length("i")).alias("len"), F.least(F.first("la"), F.first("lb")).alias("l"))
    scored = pairs.where(F.col("shared") >= least_shared).withColumn("score", F.round(F.try_divide("len", "l"), 6))
    return (scored.where(F.col("score") >= least) if least > 0 else scored).select("a", "b", "shared", "score")


def _block_pairs(s: DataFrame, items: int, pairs: int, least: float, least_shared: int) -> DataFrame:
    """(a, b, shared, len, l) of keys with common items, a smaller; those with fewer shared or clearly below ``least`` may be missing."""
    tasks = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(math.ceil(items / BLOCK_ITEMS), min(MOST_BLOCKS, math.ceil(math.sqrt(2 * max(pairs / BLOCK_PAIRS, tasks)))))
    at_once = CHUNK_PAIRS
    met = s.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    cells = met.select((low * blocks + high).alias("cell"), (F.col("block") == low).alias("first"), (low == high).alias("same"), "k", "i")
    kind = s.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cell = [], None
        for batch in batches:
            at = np.asarray(batch.column("cell"))
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if at[x] != cell and held:
                    yield from _cell_pairs(pa.Table.from_batches(held), at_once, least, least_shared)
                    held = []
                cell = at[x]
                held.append(batch.slice(x, y - x))
        if held:
            yield from _cell_pairs(pa.Table.from_batches(held), at_once, least, least_shared)

    placed = cells.repartition(min(MOST_TASKS, blocks * (blocks + 1)), "cell").sortWithinPartitions("cell")
    return placed.mapInArrow(run, f"a {kind}, b {kind}, shared bigint, len bigint, l bigint")


def _cell_pairs(cell: pa.Table, at_once: int, least: float, least_shared: int) -> Iterator[pa.RecordBatch]:
    """Pairs between the first and the other block of a cell, or within its only one; some ``at_once`` at a time."""
    keys, items = (cell.column(c).combine_chunks().dictionary_encode() for c in ("k", "i"))
    order = np.asarray(pc.sort_indices(keys.dictionary))
    names, rank = keys.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    k, i = rank[np.asarray(keys.indices)], np.asarray(items.indices).astype(np.int64)
    lengths = np.asarray(pc.utf8_length(items.dictionary)).astype(np.int64)
    total = np.bincount(k, lengths[i], len(order)).astype(np.int64)
    first, same = np.asarray(cell.column("first").combine_chunks().cast(pa.int8())).astype(bool), cell.column("same")[0].as_py()
    left, right = np.flatnonzero(first), np.flatnonzero(first if same else ~first)
    left = left[np.argsort(k[left], kind="stable")]
    right = right[np.argsort(i[right], kind="stable")]
    held = np.bincount(i[right], minlength=len(lengths))
    begin = np.cumsum(held) - held
    k_right, k_left, i_left = k[right], k[left], i[left]
    made = held[i_left]
    ends = np.append(np.flatnonzero(np.diff(k_left)) + 1, len(left)) if len(left) else np.empty(0, np.int64)
    so_far = np.append(0, np.cumsum(made))
    x = 0
    while x < len(left):
        # whole keys of the left, up to so many pairs
        most = np.searchsorted(so_far[ends], so_far[x] + at_once, "right") - 1
        y = max(ends[max(most, 0)], ends[np.searchsorted(ends, x, "right")])
        y = min(y, np.searchsorted(k_left, k_left[x] + max(1, (1 << 34) // len(names))))
        each, n = made[x:y], so_far[y] - so_far[x]
        places = np.arange(n) - np.repeat(so_far[x:y] - so_far[x], each) + np.repeat(begin[i_left[x:y]], each)
        a, b = np.repeat(k_left[x:y], each), k_right[places]
        # the left key, the right one and the item's length in one number, which sorts fastest: 34 and 29 bits
        low = k_left[x]
        both = (((a - low) * len(names) + b) << 29) | np.repeat(lengths[i_left[x:y]], each)
        x = y
        if same:
            both = both[a < b]
        if not len(both):
            continue
        both.sort()
        pair = both >> 29
        starts = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        shared = np.diff(np.append(starts, len(pair)))
        common = np.add.reduceat(both & ((1 << 29) - 1), starts)
        a, b = pair[starts] // len(names) + low, pair[starts] % len(names)
        l = np.minimum(total[a], total[b])  # noqa: E741
        kept = (shared >= least_shared) & (common >= (least - 1e-5) * l)
        a, b = np.minimum(a, b)[kept], np.maximum(a, b)[kept]
        if len(a):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(shared[kept]), pa.array(common[kept]), pa.array(l[kept])], names=["a", "b", "shared", "len", "l"])


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): connected components, each named by its least node.

    Rounds of large-star and small-star: every node's neighbours are tied to the
    least one, until nothing changes; about log(size) rounds, no node needs all
    its neighbours in one place, as only minima and new edges are formed.
    """
    # written before the rounds: each reads it several times, and its plan would stand in theirs as often
    e = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u is not null and v is not null").distinct(), "edges")
    every = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node")))
    every = (every if nodes is None else every.union(nodes.select("node"))).distinct()
    now, seen = e.where("u <> v"), None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        after = materialize(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct(), "components")
        state = after.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        now, seen = after, state
    return every.join(now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other, weight) of undirected edges (a, b, weight) from both ends."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").union(edges.select("b", "a", "weight"))


def connected(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Targets of the wanted chunks' forward connections in the same revision that aren't wanted themselves.

    chunks (revision, chunk_id, connect_to array<struct<target, relation>>), wanted (revision, chunk_id).
    """
    links = chunks.join(wanted, ["revision", "chunk_id"], "left_semi").select("revision", F.col("chunk_id").alias("host"), F.explode("connect_to").alias("c")).where(F.col("c.relation").isin(*FORWARD))
    targets = links.select("revision", "host", F.col("c.target").alias("chunk_id"), F.col("c.relation").alias("relation")).distinct()
    return targets.join(chunks.select("revision", "chunk_id"), ["revision", "chunk_id"], "left_semi").join(wanted, ["revision", "chunk_id"], "left_anti")


def hosts(chunks: DataFrame) -> DataFrame:
    """(revision, asset, host): the first body chunk, by order and id, that connects forward to each asset."""
    links = chunks.where(F.col("chunk_type").isin("text", "page")).select("revision", "sort_order", "chunk_id", F.explode("connect_to").alias("c")).where(F.col("c.relation").isin(*FORWARD))
    return links.groupBy("revision", F.col("c.target").alias("asset")).agg(F.min(F.struct("sort_order", "chunk_id")).alias("h")).select("revision", "asset", F.col("h.chunk_id").alias("host"))


def merge_connections(links: DataFrame) -> DataFrame:
    """(host, target, relation, position): each link once, one with a position before one without."""
    w = Window.partitionBy("host", "target", "relation", F.coalesce("position", F.lit(-1)))
    best = links.withColumn("n", F.count("position").over(Window.partitionBy("host", "target", "relation")))
    return best.where("position is not null or n = 0").withColumn("r", F.row_number().over(w.orderBy("position"))).where("r = 1").select("host", "target", "relation", "position")
