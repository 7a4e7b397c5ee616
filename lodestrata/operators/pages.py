"""Sections on pages: anchoring, pruning, ranges, coverage, ownership of shared pages, plans, clusters of boxes.

Nodes carry their path ('A / B / C') inside a scope (a parsed result). Descendants are met by equi joins on exploded
ancestor paths, never by comparing all nodes of a scope.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import graphs, trees
from lodestrata.session import materialize

#: Runs of so many pages with the same hits are running lines (fixed value).
LEAST_RUN = 2
#: Pages of a bucket when page spans are joined.
BUCKET = 16
#: A scope of more boxes is swept in strips; a sweep writes out the ties it holds beyond so many.
SWEPT_WHOLE, HELD = 20_000, 200_000


def _below(nodes: DataFrame, *columns: str) -> DataFrame:
    """(scope, ancestor, *columns) of every node for each path above it."""
    return trees.with_ancestors(nodes.select("scope", "path", *columns)).where("ancestor <> path")


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without others below them."""
    return nodes.join(_below(nodes).select("scope", F.col("ancestor").alias("path")).distinct(), ["scope", "path"], "left_anti")


def anchored(nodes: DataFrame, offset: int, counts: DataFrame) -> DataFrame:
    """(scope, path, page): leaves of (scope, path, printed) on page printed + offset, if the scope (scope, page_count) has it."""
    page = F.col("printed") + offset
    return leaves(nodes).where("printed is not null").join(counts, "scope", "left").where((page >= 1) & (F.col("page_count").isNull() | (page <= F.col("page_count")))).select("scope", "path", page.alias("page"))


def pruned(nodes: DataFrame, offset: int, counts: DataFrame) -> DataFrame:
    """(scope, path) of nodes that stay: leaves unless their page lies outside the document, and what has a leaf that stays below it."""
    page = F.col("printed") + offset
    last = leaves(nodes).join(counts, "scope", "left")
    stay = last.where(F.col("printed").isNull() | (page >= 1) & (F.col("page_count").isNull() | (page <= F.col("page_count")))).select("scope", "path")
    up = trees.with_ancestors(stay).select("scope", F.col("ancestor").alias("path")).distinct()
    return nodes.select("scope", "path").distinct().join(up, ["scope", "path"], "left_semi")


def own_spans(nodes: DataFrame) -> DataFrame:
    """(scope, path, start, end) of inner nodes (scope, path, start) that start before their first leaf: up to that leaf's start."""
    first = _below(leaves(nodes).where("start is not null"), "start").groupBy("scope", F.col("ancestor").alias("path")).agg(F.min("start").alias("end"))
    return nodes.where("start is not null").groupBy("scope", "path").agg(F.min("start").alias("start")).join(first, ["scope", "path"]).where("start < end")


def containing(spans: DataFrame, sections: DataFrame) -> DataFrame:
    """(span_id, section_id): the innermost section of the scope that covers the span; latest start, then deepest, then id.

    spans (scope, span_id, start, end), sections (scope, section_id, s_start, s_end, s_level). Spans meet sections in buckets
    of ``BUCKET`` pages, so that a scope with very many of both is not compared whole.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET)
    s = sections.where("s_end >= s_start").withColumn("bucket", F.explode(F.sequence(bucket("s_start"), bucket("s_end"))))
    inside = spans.withColumn("bucket", bucket("start")).join(s, ["scope", "bucket"]).where((F.col("s_start") <= F.col("start")) & (F.col("s_end") >= F.col("end")))
    return inside.groupBy("span_id").agg(F.max(F.struct("s_start", "s_level", "section_id")).alias("b")).select("span_id", "b.section_id")


def page_bodies(nodes: DataFrame) -> DataFrame:
    """(scope, path, page, owner) of the pages that nodes (scope, path, ord, pages array) tell themselves.

    Leaves have all of their pages, others those nothing below them has. A page's owner is the first of its nodes in reading order:
    by their first own page, then by ``ord`` and path.
    """
    n = nodes.groupBy("scope", "path").agg(F.min("ord").alias("ord"), F.array_distinct(F.flatten(F.collect_list("pages"))).alias("pages"))
    page = n.select("scope", "path", "ord", F.explode("pages").alias("page"))
    covered = _below(page, "page").select("scope", F.col("ancestor").alias("path"), "page").distinct()
    body = page.join(covered, ["scope", "path", "page"], "left_anti")
    first = body.groupBy("scope", "path").agg(F.min("page").alias("first"))
    placed = body.join(first, ["scope", "path"])
    owner = placed.groupBy("scope", "page").agg(F.min(F.struct("first", "ord", "path")).alias("o")).select("scope", "page", F.col("o.path").alias("owner"))
    return placed.join(owner, ["scope", "page"]).select("scope", "path", "page", "owner")


def page_plan(counts: DataFrame, blank: DataFrame) -> DataFrame:
    """(scope, page, plan): every page 1 to page_count of (scope, page_count); those in ``blank`` (scope, page) skip tagging."""
    every = counts.where("page_count >= 1").select("scope", F.explode(F.sequence(F.lit(1), F.col("page_count"))).alias("page"))
    marked = blank.select("scope", "page").distinct().withColumn("is_blank", F.lit(True))
    return every.join(marked, ["scope", "page"], "left").select("scope", "page", F.when(F.col("is_blank"), "skip_tagging").otherwise("vlm_lite").alias("plan"))


def without_running_lines(hits: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """Hits (scope, page, mark) without those of pages whose sorted marks are the same as a neighbouring page's, in runs of ``least`` pages."""
    signed = hits.groupBy("scope", "page").agg(F.sort_array(F.collect_list("mark")).alias("marks"))
    w = Window.partitionBy("scope", "marks")
    runs = signed.withColumn("run", F.col("page") - F.row_number().over(w.orderBy("page"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("scope", "marks", "run")))
    return hits.join(runs.where(F.col("n") >= least).select("scope", "page"), ["scope", "page"], "left_anti")


def _ties(batches: Iterator[pa.RecordBatch], gap: float, held: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of boxes (scope, strip, id, x0, y0, x1, y1) in order of scope, strip and y0: each box with the least id of its cluster so far, so one tie a box at most.

    Open boxes are those that the next ones may still reach, without those that another of the same cluster covers; only they are compared.
    """
    above: dict = {}
    place, open_ = None, []

    def top(x):
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    def ties() -> list:
        out = [(x, top(x)) for x in above]
        above.clear()
        return out

    schema = None
    for batch in batches:
        schema, out = pa.schema([("a", batch.schema.field("id").type), ("b", batch.schema.field("id").type)]), []
        for scope, strip, i, x0, y0, x1, y1 in zip(*(batch.column(c).to_pylist() for c in ("scope", "strip", "id", "x0", "y0", "x1", "y1"))):
            if place != (scope, strip):
                out += ties()
                place, open_ = (scope, strip), []
            elif len(above) > held:
                # what is still open goes on by its cluster's least id
                open_ = [(top(k), *box) for k, *box in open_]
                out += ties()
            own, reached, covered = top(i), [], False
            for box in open_:
                k, a0, b0, a1, b1 = box
                if y0 - gap > b1:
                    continue
                if a0 - gap <= x1 and x0 - gap <= a1 and b0 - gap <= y1:
                    if (other := top(k)) != own:
                        own, other = (own, other) if own < other else (other, own)
                        above[other] = own
                    if x0 <= a0 and a1 <= x1 and b1 <= y1:
                        continue
                    covered = covered or (a0 <= x0 and x1 <= a1 and y1 <= b1)
                reached.append(box)
            open_ = reached if covered else [*reached, (i, x0, y0, x1, y1)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
    if above:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ties()), schema.types)], schema=schema)


def cluster_boxes(boxes: DataFrame, gap: int) -> DataFrame:
    """(node, component): boxes (scope, id, x0, y0, x1, y1) that lie within ``gap`` of each other, directly or over others.

    Each scope is swept from its least y on, which ties every box to one of its cluster, not to all near it. A scope of
    more than ``SWEPT_WHOLE`` boxes is swept in strips of x as wide as its boxes are on average: three rows a box
    on average at most, whatever the boxes' sizes. Boxes without a scope or a coordinate are alone.
    """
    held = HELD
    boxes = materialize(boxes, "boxes")
    placed = boxes.dropna().select("scope", "id", *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    sizes = placed.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), (F.avg(F.col("x1") - F.col("x0")) + max(2 * gap, 1)).alias("width")).where(F.col("n") > SWEPT_WHOLE).select("scope", "width")
    large = materialize(sizes, "large-scopes")
    if large.isEmpty():
        strips = placed.withColumn("strip", F.lit(0).cast("bigint"))
    else:
        within = F.sequence(F.floor((F.col("x0") - gap) / F.col("width")), F.floor(F.col("x1") / F.col("width")))
        strips = placed.join(large, "scope", "left").withColumn("strip", F.explode(F.when(F.col("width").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(within))).drop("width")
    swept = strips.repartition("scope", "strip").sortWithinPartitions("scope", "strip", "y0")
    kind = boxes.schema["id"].dataType.simpleString()
    ties = swept.mapInArrow(lambda batches: _ties(batches, gap, held), f"a {kind}, b {kind}")
    return graphs.components(ties, boxes.select(F.col("id").alias("node")))


def unique_paths(rows: DataFrame) -> DataFrame:
    """(scope, ord, path, unique_path): repeated paths get _2, _3 by occurrence, and rows below a repeated path follow its latest occurrence before them.

    rows (scope, ord, path), segments divided by '/'; a path repeated itself keeps its own number. Of several repeated paths above, the one that came first in the scope counts.
    """
    w = Window.partitionBy("scope", "path").orderBy("ord")
    named = rows.withColumn("k", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("scope", "path")))
    own = F.when(F.col("k") == 1, F.col("path")).otherwise(F.concat_ws("_", "path", "k"))
    named = named.withColumn("own", own)
    above = named.where("n > 1").select("scope", F.col("path").alias("up"), F.col("ord").alias("up_ord"), F.col("own").alias("renamed"))
    born = above.groupBy("scope", "up").agg(F.min("up_ord").alias("born"))
    parts = F.split("path", "/")
    below = named.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).where("up <> path")
    met = below.join(above, ["scope", "up"]).where("up_ord < ord").groupBy("scope", "ord", "path", "own", "up").agg(F.max(F.struct("up_ord", "renamed")).alias("x")).join(born, ["scope", "up"])
    picked = met.groupBy("scope", "ord", "path").agg(F.min(F.struct("born", "up", "x", "own")).alias("m"))
    moved = picked.select("scope", "ord", "path", F.concat(F.col("m.x.renamed"), F.expr("substring(m.own, length(m.up) + 1)")).alias("moved"))
    return named.join(moved, ["scope", "ord", "path"], "left").select("scope", "ord", "path", F.coalesce("moved", "own").alias("unique_path"))


def allocated(hits: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(shown, folded) of hits (term, place, doc, ord), ``place`` being the term's place in the request.

    Terms with the fewest hits come first and take up to what is left of ``limit``; the rest is counted by term and doc.
    Only counts of terms meet in one place; of each term's hits the first ``limit`` are ordered.
    """
    counts = hits.groupBy("term", "place").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("n", "place").rowsBetween(Window.unboundedPreceding, -1))  # one row a term
    room = counts.withColumn("room", F.greatest(F.lit(limit) - F.coalesce(before, F.lit(0)), F.lit(0)))
    ranked = hits.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("doc", "ord")))
    both = ranked.join(F.broadcast(room.select("term", "n", "room")), "term")
    shown = both.where("r <= room").select("term", "doc", "ord", "r")
    return shown, both.where("r > room").groupBy("term", "doc").agg(F.count(F.lit(1)).alias("folded"))


def merged_tables(rows: DataFrame) -> DataFrame:
    """(id, table_id): tables (scope, path, ord, id, width) right behind each other on a path, of the same width, are one; named by the first."""
    w = Window.partitionBy("scope", "path").orderBy("ord", "id")
    goes_on = (F.col("ord") - F.lag("ord").over(w) == 1) & (F.col("width") == F.lag("width").over(w))
    runs = rows.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = runs.groupBy("scope", "path", "run").agg(F.min(F.struct("ord", "id")).alias("f"))
    return runs.join(first, ["scope", "path", "run"]).select("id", F.col("f.id").alias("table_id"))


def monotone(rows: DataFrame) -> DataFrame:
    """(scope, ord, page): pages of leaves in reading order that never go back; a leaf not located is on the page reached, at least 1."""
    w = Window.partitionBy("scope").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("scope", "ord", F.greatest(F.coalesce(F.max("page").over(w), F.lit(1)), F.lit(1)).alias("page"))


def summaries(nodes: DataFrame, self_texts: DataFrame) -> DataFrame:
    """(scope, path, summary) of nodes (scope, path, title, ord): what a section covers, its own text and then its children's titles.

    self_texts (scope, path, self_text). A child's title counts wherever its parent is a node.
    """
    child = nodes.withColumn("parent", text.parent_path(F.col("path"))).where("parent is not null")
    titles = child.groupBy("scope", F.col("parent").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "path", "title"))), lambda x: x["title"]), ", ").alias("titles"))
    n = nodes.select("scope", "path").distinct().join(self_texts, ["scope", "path"], "left").join(titles, ["scope", "path"], "left")
    top = ~F.contains(F.col("path"), F.lit(text.SEPARATOR))
    own = F.nullif(F.trim("self_text"), F.lit(""))
    whole = F.concat(F.when(top, "This document includes: ").otherwise("This section covers: "), F.concat_ws(" ", own, F.nullif("titles", F.lit(""))))
    return n.select("scope", "path", text.preview(F.trim(whole), 100, 100).alias("summary"))


def contents_anchors(hits: DataFrame, cap: int) -> DataFrame:
    """(scope, page) where lists of contents may start: pages of hits (scope, page, mark, at_edge, in_body) without running lines.

    A scope with more than ``cap`` pages keeps those of hits at a line's edge; if these are still more, those in the body as well;
    if there are still more, none.
    """
    kept = without_running_lines(hits.select("scope", "page", "mark").distinct()).select("scope", "page").distinct()
    page = hits.join(kept, ["scope", "page"]).groupBy("scope", "page").agg(F.max("at_edge").alias("edge"), F.max(F.col("at_edge") & F.col("in_body")).alias("body"))
    n = page.groupBy("scope").agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("edge"), 1)).alias("edges"), F.count(F.when(F.col("body"), 1)).alias("bodies"))
    rule = F.when(F.col("all") <= cap, F.lit(True)).when(F.col("edges") <= cap, F.col("edge")).when(F.col("bodies") <= cap, F.col("body")).otherwise(False)
    return page.join(n, "scope").where(rule).select("scope", "page")


def refined(leaf: DataFrame, candidates: DataFrame, least_pages: int = 3) -> DataFrame:
    """(scope, path, page, pos, title): headings that may divide leaves of ``least_pages`` pages or more.

    leaf (scope, path, start, end, start_pos, end_pos), candidates (scope, page, pos, title). Candidates up to the leaf's own
    place on its first page and from the end's place on its last page are dropped; without a place of the end the whole last
    page is. Of equal titles (whatever their case and blanks) the first stays.
    """
    fat = leaf.where(F.col("end") - F.col("start") + 1 >= least_pages)
    page = fat.withColumn("page", F.explode(F.sequence("start", "end")))
    after = (F.col("page") > F.col("start")) | (F.col("pos") > F.coalesce("start_pos", F.lit(-1)))
    before = (F.col("page") < F.col("end")) | F.col("end_pos").isNotNull() & (F.col("pos") < F.col("end_pos"))
    inside = page.join(candidates, ["scope", "page"]).where(after & before).withColumn("key", F.lower(F.regexp_replace(F.trim("title"), r"\s+", " ")))
    return inside.groupBy("scope", "path", "key").agg(F.min(F.struct("page", "pos", "title")).alias("x")).select("scope", "path", "x.page", "x.pos", "x.title")
