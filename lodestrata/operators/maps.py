"""Rendering of a section map within a budget, and composition of evidence."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters a rendered map may have (fixed value).
BUDGET = 20_000


def _line(depth: int, title: str, summary: str | None, folded: int) -> str:
    return "  " * depth + "- " + title + (f": {summary}" if summary else "") + (f" (+{folded} below)" if folded else "")


def render_map(nodes: list[tuple[str, str | None, float]], keep: set[str] | None = None, budget: int = BUDGET) -> str:
    """A map of (path, summary, score) nodes as indented lines of at most ``budget`` characters.

    Whole if it fits; else without summaries; else with the subtrees of least
    score folded into their parents, one after another, but never the chain to
    the best node nor nodes in ``keep`` or above them. ValueError if even that
    is too long. Nodes are few: the map of the scope asked for.
    """
    score = {p: s for p, _, s in nodes}
    paths = sorted(score)
    parent = {p: p.rsplit(" / ", 1)[0] if " / " in p and p.rsplit(" / ", 1)[0] in score else None for p in paths}
    summary = {p: x for p, x, _ in nodes}

    def text(shown: set[str], folded: dict[str, int], with_summary: bool) -> str:
        return "\n".join(_line(p.count(" / "), p.rsplit(" / ", 1)[-1], summary[p] if with_summary else None, folded.get(p, 0)) for p in paths if p in shown)

    shown = set(paths)
    for with_summary in (True, False):
        if len(out := text(shown, {}, with_summary)) <= budget:
            return out
    fixed = set(keep or ())
    if paths:
        fixed.add(min(paths, key=lambda p: (-score[p], p)))
    for p in list(fixed):
        while (p := parent.get(p)) is not None:
            fixed.add(p)
    kids: dict[str | None, set[str]] = {}
    for p in paths:
        kids.setdefault(parent[p], set()).add(p)
    pooled: dict[str, float] = {}
    for p in reversed(paths):
        pooled[p] = max([score[p], *(pooled[k] for k in kids.get(p, ()))])
    # leaves first: the least of them folds into its parent, which may then become a leaf itself
    heap = [(pooled[p], p) for p in paths if not kids.get(p) and p not in fixed and parent[p] is not None]
    heapq.heapify(heap)
    folded: dict[str, int] = {}
    size = len(text(shown, folded, False))
    while heap and size > budget:
        _, p = heapq.heappop(heap)
        up = parent[p]
        before = len(_line(up.count(" / "), up.rsplit(" / ", 1)[-1], None, folded.get(up, 0)))
        shown.discard(p)
        kids[up].discard(p)
        size -= len(_line(p.count(" / "), p.rsplit(" / ", 1)[-1], None, folded.get(p, 0))) + 1
        folded[up] = folded.get(up, 0) + 1 + folded.pop(p, 0)
        size += len(_line(up.count(" / "), up.rsplit(" / ", 1)[-1], None, folded[up])) - before
        if not kids[up] and up not in fixed and parent[up] is not None:
            heapq.heappush(heap, (pooled[up], up))
    if size > budget:
        raise ValueError(f"the map needs {size} characters, {budget} are allowed; narrow the scope")
    return text(shown, folded, False)


def compose(text: str, assets: list[tuple[str, str, str]]) -> list[tuple[str, str]]:
    """Parts (kind, content) of a text with its assets (placeholder, kind, body).

    Tables stand in place of their placeholders, within the text; images cut it:
    text before, image, text behind. Of placeholders at the same place the
    longest counts; those that don't occur are left out.
    """
    parts, images = text, []
    for mark, kind, body in sorted(assets, key=lambda a: -len(a[0])):
        if mark and mark in parts:
            if kind == "table":
                parts = parts.replace(mark, body)
            else:
                images.append((mark, body))
    out: list[tuple[str, str]] = []
    while images and (hits := [(parts.find(m), -len(m), m, b) for m, b in images if m in parts]):
        at, _, mark, body = min(hits)
        if parts[:at].strip():
            out.append(("text", parts[:at].strip()))
        out.append(("image", body))
        parts = parts[at + len(mark) :]
    return out + ([("text", parts.strip())] if parts.strip() else [])


def composed(text: Column, assets: Column) -> Column:
    """``compose`` over columns; assets array<struct<mark, kind, body>>."""

    def run(t: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "content": c} for k, c in compose(x or "", [(y["mark"], y["kind"], y["body"]) for y in (z if z is not None else [])])] for x, z in zip(t, a)])

    return F.pandas_udf(run, "array<struct<kind:string,content:string>>", F.PandasUDFType.SCALAR)(text, assets)


def attach_satellites(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(workbook, block, host): where small blocks of a workbook belong.

    blocks (workbook, sheet, block, r0, c0, r1, c1, is_table, has_text), links (workbook, a, b) by formulas.
    A satellite goes to a table it is linked with, directly or over satellites; else to the nearest table of its
    sheet (least gap, then id); without a table it stands alone; a textless one is dropped if the workbook has any table.
    """

    def run(key: tuple, own: pd.DataFrame, tied: pd.DataFrame) -> pd.DataFrame:
        tables = own[own["is_table"]]
        host = {b: b for b in tables["block"]}
        near = {}
        for a, b in zip(tied["a"], tied["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        todo = sorted(set(own["block"]) - set(host))
        changed = True
        while changed:
            changed = False
            for s in todo:
                if s not in host and (found := sorted(host[x] for x in near.get(s, ()) if x in host)):
                    host[s], changed = found[0], True
        rows = []
        for r in own.sort_values("block").itertuples():
            h = host.get(r.block)
            if h is None and len(tables) and not r.has_text:
                continue
            same = tables[tables["sheet"] == r.sheet]
            if h is None and len(same):
                gap = [(max(t.r0 - r.r1, r.r0 - t.r1, 0) + max(t.c0 - r.c1, r.c0 - t.c1, 0), t.block) for t in same.itertuples()]
                h = min(gap)[1]
            rows.append((key[0], r.block, h if h is not None else r.block))
        return pd.DataFrame(rows, columns=["workbook", "block", "host"])

    return blocks.groupBy("workbook").cogroup(links.groupBy("workbook")).applyInPandas(run, "workbook string, block string, host string")
