"""Cutting oversized texts at natural ends, by recursive bisection.

A span that is too long is cut at the strongest natural end near its middle,
and its halves again, until all bodies fit the limit less the overlap; then the
end of the text before is put in front of each piece. Where a span holds no
natural end and is still longer than the limit itself, it is cut by force.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Natural ends: line ends, table row ends, . ! ? before white space, 。！？ anywhere. The groups are in order of strength.
ENDS = re.compile(r"(\n[^\S\n]*\n\s*|\r\n\r\n\s*)|(\r\n|[\n\r\x0b\x0c\x85  ]|</tr>)|([.!?](?=\s)|[。！？])", re.IGNORECASE)
_GAP = re.compile(r"\s+")


def natural_ends(text: str) -> tuple[list[int], list[int]]:
    """Places behind natural ends within the text, ascending, and their strengths (3 a blank line, 2 a line or row, 1 a sentence)."""
    at, strength = [], []
    for m in ENDS.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            strength.append(4 - m.lastindex)
    return at, strength


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    return a, b


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, bool]]:
    """Pieces (start, body start, end, forced) in order; start..body start repeats the text before.

    Pieces are at most ``limit`` long and bodies cover all but white space at
    cuts. The overlap is ``overlap`` characters, less only where a natural
    stretch leaves less room, or at the text's start. ``forced``: one of the
    body's ends is no natural one.
    """
    overlap = max(0, min(overlap, limit - 1))
    at, strength = natural_ends(text)
    bodies: list[tuple[int, int, bool]] = []
    stack = [(0, len(text), False)]
    while stack:
        a0, b0, forced = stack.pop()
        a, b = _trim(text, a0, b0)
        if a == b:
            continue
        if b - a <= (limit - overlap if a else limit):
            bodies.append((a, b, forced))
            continue
        lo, hi, middle = bisect_left(at, a + 1), bisect_left(at, b), (a + b) // 2
        if lo < hi:
            near_lo, near_hi = bisect_left(at, middle - (b - a) // 4, lo, hi), bisect_left(at, middle + (b - a) // 4 + 1, lo, hi)
            if near_lo < near_hi:
                k = min(range(near_lo, near_hi), key=lambda i: (-strength[i], abs(at[i] - middle)))
            else:
                k = bisect_left(at, middle, lo, hi)
                k = min((i for i in (k - 1, k) if lo <= i < hi), key=lambda i: abs(at[i] - middle))
            cut = at[k]
            stack += [(cut, b, forced), (a, cut, forced)]
        elif b - a <= limit:
            bodies.append((a, b, forced))  # a natural stretch is kept whole, with less overlap
        else:
            cut = _forced_cut(text, a, b, middle, limit - overlap)
            stack += [(cut, b, True), (a, cut, True)]
    pieces = []
    for a, b, forced in bodies:
        start = max(0, a - min(overlap, limit - (b - a))) if a else 0
        pieces.append((start, a, b, forced))
    return pieces


def _forced_cut(text: str, a: int, b: int, middle: int, size: int) -> int:
    """The white space nearest to the middle, if within a quarter of the size; else the middle, not inside a cluster of marks."""
    best = None
    for m in _GAP.finditer(text, max(a + 1, middle - size // 4), min(b - 1, middle + size // 4)):
        if best is None or abs(m.end() - middle) < abs(best - middle):
            best = m.end()
    if best is None:
        import unicodedata

        best = middle
        while best > a + 1 and unicodedata.combining(text[best]):
            best -= 1
    return best


PIECES = "id string, part int, n_parts int, start int, body_start int, end int, forced boolean, piece string"
_ARROW = pa.schema([("id", pa.string()), ("part", pa.int32()), ("n_parts", pa.int32()), ("start", pa.int32()), ("body_start", pa.int32()), ("end", pa.int32()), ("forced", pa.bool_()), ("piece", pa.string())])


def oversized(df: DataFrame, key: str, text: str, kind: str, limits: DataFrame) -> DataFrame:
    """(id, text, max_chars, overlap_chars): rows with more characters than the limit of their kind, each id once.

    ``limits`` (chunk_type, max_chars, overlap_chars) is one row per kind; of several the least limit holds.
    """
    bound = limits.groupBy(F.col("chunk_type").alias("kind")).agg(F.min(F.struct("max_chars", "overlap_chars")).alias("l")).select("kind", "l.max_chars", "l.overlap_chars")
    rows = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(kind).alias("kind")).where("id is not null and text is not null")
    return rows.join(bound, "kind").where("max_chars > 0 and length(text) > max_chars").drop("kind").dropDuplicates(["id"])


def split_rows(long: DataFrame) -> DataFrame:
    """Pieces (``PIECES``) of the rows of ``oversized``; whole texts, without further shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, limit, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split_text(text, limit, overlap or 0)
                rows += [(key, i, len(pieces), s, a, b, f, text[s:b]) for i, (s, a, b, f) in enumerate(pieces)]
                if len(rows) > 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    return long.select("id", "text", "max_chars", "overlap_chars").mapInArrow(run, PIECES)


def pieces(df: DataFrame, limits: DataFrame, key: str = "id", text: str = "text", kind: str = "chunk_type", path: str = "path") -> DataFrame:
    """All rows as pieces under their path: rows within their limit, or of a kind without one, stay one piece.

    Null ids, null and empty texts give no piece; rows delivered again are taken once per id.
    """
    once = df.select(F.col(key).cast("string").alias("id"), F.col(path).alias("path"), F.col(text).alias("text"), F.col(kind).alias("chunk_type")).where("id is not null").dropDuplicates(["id"])
    cut = split_rows(oversized(once, "id", "text", "chunk_type", limits))
    rest = once.where("text <> ''").join(cut.select("id").distinct(), "id", "left_anti")
    n = F.length("text")
    whole = rest.select("id", "path", F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.lit(0).alias("start"), F.lit(0).alias("body_start"), n.alias("end"), F.lit(False).alias("forced"), F.col("text").alias("piece"))
    return cut.join(once.select("id", "path"), "id").select(whole.columns).unionByName(whole)


def found(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """p6: (id, cut_kind) of every row longer than its limit."""
    cut = split_rows(oversized(chunks, "id", "text", "chunk_type", limits))
    return cut.groupBy("id").agg(F.when(F.max("forced"), F.lit("forced")).otherwise(F.lit("natural")).alias("cut_kind"))
