"""Operators on trees whose nodes carry their path ('A / B / C')."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text


def with_ancestors(nodes: DataFrame, path: str = "path", out: str = "ancestor") -> DataFrame:
    """Each node once per ancestor-or-self path: prefix joins become equi joins on (scope, prefix)."""
    return nodes.withColumn(out, F.explode(text.path_prefixes(F.col(path))))


def subtree(nodes: DataFrame, targets: DataFrame, scope: str, path: str = "path") -> DataFrame:
    """Nodes at or below a target of the same scope; targets (scope, target)."""
    return with_ancestors(nodes, path, "target").join(targets.select(scope, "target").distinct(), [scope, "target"])


def pool_max(scores: DataFrame, scope: str, path: str = "path", score: str = "score") -> DataFrame:
    """(scope, ancestor, score): the best score at or below each ancestor."""
    return with_ancestors(scores, path).groupBy(scope, "ancestor").agg(F.max(score).alias(score))


def interval_union(leaves: DataFrame, scope: str, start: str, end: str, path: str = "path") -> DataFrame:
    """(scope, ancestor, start, end): least start and greatest end at or below each ancestor."""
    return with_ancestors(leaves, path).groupBy(scope, "ancestor").agg(F.min(start).alias(start), F.max(end).alias(end))


def outline(nodes: DataFrame, targets: DataFrame, scope: str, depth: int | None = None, path: str = "path") -> DataFrame:
    """Nodes below each target with their level relative to it, at most ``depth`` levels down."""
    level = F.size(F.split(F.col(path), text.SEPARATOR)) - F.size(F.split(F.col("target"), text.SEPARATOR))
    below = subtree(nodes, targets, scope, path).withColumn("level", level)
    return below if depth is None else below.where(F.col("level") <= depth)


def node_filter(nodes: DataFrame, scope: str, predicate, path: str = "path") -> DataFrame:
    """Hits of a predicate column with all their ancestors and descendants, each node once with its ``role`` (hit, ancestor, descendant)."""
    marked = nodes.withColumn("_hit", F.coalesce(predicate, F.lit(False)))
    hits = marked.where("_hit").select(scope, F.col(path).alias("target")).distinct()
    down = subtree(marked, hits, scope, path).select(scope, path, F.when(F.col("_hit"), 0).otherwise(2).alias("rank"))
    up = with_ancestors(hits.withColumnRenamed("target", path), path).select(scope, F.col("ancestor").alias(path), F.lit(1).alias("rank"))
    up = up.join(nodes.select(scope, path).distinct(), [scope, path], "left_semi")
    best = down.unionByName(up).groupBy(scope, path).agg(F.min("rank").alias("rank"))
    return best.select(scope, path, F.when(F.col("rank") == 0, "hit").when(F.col("rank") == 1, "ancestor").otherwise("descendant").alias("role"))


def containing_section(spans: DataFrame, sections: DataFrame, scope: str) -> DataFrame:
    """(span_id, section_id): the innermost section of the scope that covers the span; latest start, then deepest, then id.

    spans (scope, span_id, start, end), sections (scope, section_id, s_start, s_end, s_level).
    """
    inside = spans.join(sections, scope).where((F.col("s_start") <= F.col("start")) & (F.col("s_end") >= F.col("end")))
    best = inside.groupBy("span_id").agg(F.max(F.struct("s_start", "s_level", "section_id")).alias("b"))
    return best.select("span_id", "b.section_id")


def sibling_ranges(nodes: DataFrame, last_page: str) -> DataFrame:
    """Closed page ranges of siblings (group, node_id, ord, page): up to the next located sibling's start.

    An unlocated node starts where the siblings so far have got to; the last one
    ends at ``last_page``; an end never lies before its start.
    """
    w = Window.partitionBy("group").orderBy("ord", "node_id")
    start = F.coalesce(F.max("page").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    following = F.first("page", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return nodes.withColumn("start", start).withColumn("end", F.greatest(F.col("start"), F.coalesce(following, F.col(last_page))))


def level_parents(lines: DataFrame, scope: str, order: str, level: str, max_level: int = 6) -> DataFrame:
    """Each heading's parent: the last earlier heading of a smaller level (``parent_order``), by one running value per level."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = lines
    for k in range(1, max_level):
        out = out.withColumn(f"_p{k}", F.max(F.when(F.col(level) == k, F.col(order))).over(w))
    earlier = [F.when(F.col(level) > k, F.col(f"_p{k}")) for k in range(1, max_level)]
    return out.withColumn("parent_order", F.greatest(*earlier)).drop(*[f"_p{k}" for k in range(1, max_level)])
