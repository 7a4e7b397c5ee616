"""Routes from a question to results: hybrid discovery, ranking, reading, and the short cut for small scopes."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring
from lodestrata.operators import lexical, ranking
from lodestrata.session import materialize

LEXICAL_WEIGHT, VISUAL_WEIGHT = 3.0, 1.5
#: Candidates found for each result asked for, unless told otherwise.
RECALL = 2


def recall_k(top_k: int, override: int | None = None) -> int:
    return override if override is not None else top_k * RECALL


def hybrid(found: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score, rank, discovery_score): the k best of lexical rows ``found`` (query_id, key, lex, rank) and
    visual rows ``seen`` (query_id, key, similarity, rank), by weighted reciprocal ranks; a key of both adds up.

    Questions with rows of one channel only keep that channel's own scores. Scores are normalised per question.
    """
    a = found.select("query_id", "key", "lex", F.col("rank").alias("l"))
    b = seen.select("query_id", "key", "similarity", F.col("rank").alias("v"))
    w = Window.partitionBy("query_id")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (scoring.RRF_K + F.col(rank)), F.lit(0.0))
    both = (F.count("l").over(w) > 0) & (F.count("v").over(w) > 0)
    merged = a.join(b, ["query_id", "key"], "full").withColumn("score", F.when(both, F.round(part(LEXICAL_WEIGHT, "l") + part(VISUAL_WEIGHT, "v"), 9)).otherwise(F.coalesce("lex", "similarity")))
    best = merged.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return lexical.min_max(best, "score", "discovery_score").select("query_id", "key", "score", "rank", "discovery_score")


def classic(candidates: DataFrame, heat: DataFrame, rows: DataFrame, top_k: int) -> DataFrame:
    """(query_id, rank, id, score, row_no): hybrid candidates ranked with usage heat, the best ``top_k`` read as their rows
    (key, id, sort_order, chunk_id) in order; a row shows once per question."""
    none = candidates.select("query_id", "key", F.lit(0.0).alias("agent_score"), F.lit(0).alias("place")).limit(0)
    ranked = ranking.rank_candidates(candidates.withColumnRenamed("rank", "place"), none, heat, top_k)
    read = ranked.join(rows, "key").groupBy("query_id", "id").agg(F.min(F.struct("rank", "sort_order", "chunk_id", "id", "score")).alias("x"))
    w = Window.partitionBy("query_id").orderBy("x.rank", "x.sort_order", "x.chunk_id", "x.id")
    return read.withColumn("row_no", F.row_number().over(w)).select("query_id", "x.rank", "id", "x.score", "row_no")


def small_scopes(rows: DataFrame, scope: str, top_k: int, *order: str) -> DataFrame:
    """All rows, numbered by ``order``, of the scopes with at most ``top_k`` of them: these need no search."""
    few = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= top_k).select(scope)
    w = Window.partitionBy(scope).orderBy(*order)
    return rows.join(few, scope, "left_semi").withColumn("row_no", F.row_number().over(w))


def is_small(rows: DataFrame, top_k: int) -> bool:
    """Whether one scope has at most ``top_k`` rows; reads no more than needed to know."""
    return rows.limit(top_k + 1).count() <= top_k


def require_scope(known: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """``wanted`` if all of it is known, else ``ValueError``: a scope with an unknown document or section fails as a whole."""
    missing = wanted.join(known.select(*on).distinct(), on, "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"unknown scope: {missing[0].asDict()}")
    return wanted


def entry_documents(terms: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, revision, via, hits): documents whose section titles or paths hold a term (term), or where no document's do, whose texts do.

    ``sections`` (revision, title, path), ``chunks`` (revision, text); terms are few, each compared in one pass over either table.
    """
    shown = F.broadcast(terms.select(F.lower("term").alias("t"), "term").distinct())
    by_title = sections.join(shown, F.contains(F.lower(F.concat_ws(" ", "title", "path")), F.col("t"))).groupBy("term", "revision").agg(F.lit("section").alias("via"), F.count(F.lit(1)).alias("hits"))
    rest = F.broadcast(shown.join(by_title.select("term").distinct(), "term", "left_anti"))
    by_text = chunks.join(rest, F.contains(F.lower("text"), F.col("t"))).groupBy("term", "revision").agg(F.lit("content").alias("via"), F.count(F.lit(1)).alias("hits"))
    return by_title.unionByName(by_text)


def query_mode(answer: Column) -> Column:
    """The mode a router's JSON answer names, 'agent' or 'classic'; whatever else it holds falls back to 'agent'."""
    named = F.lower(F.trim(F.get_json_object(answer, "$.mode")))
    return F.when(named.isin("agent", "classic"), named).otherwise("agent")


class ResultCache:
    """Results of requests for some time, by namespace, its version, and a digest of the request's shape.

    A new version of a namespace is a new key, so what was kept for the old one is never given again. Results are written
    steps in the shared folder; at most ``size`` are known, the oldest is forgotten first.
    """

    def __init__(self, seconds: float = 300, size: int = 1_000, clock=time.monotonic):
        self.seconds, self.size, self.clock, self.kept = seconds, size, clock, {}

    @staticmethod
    def digest(request: dict) -> str:
        """The same for requests of the same shape, whatever the order of their keys and listed ids."""
        normal = {k: sorted(v, key=str) if isinstance(v, (list, set, tuple)) else v for k, v in request.items() if v is not None}
        return hashlib.sha256(json.dumps(normal, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    def get(self, namespace: str, version: int, request: dict, build) -> DataFrame:
        key, now = (namespace, version, self.digest(request)), self.clock()
        if key in self.kept and now - self.kept[key][0] < self.seconds:
            return self.kept[key][1]
        while len(self.kept) >= self.size:
            self.kept.pop(min(self.kept, key=lambda k: self.kept[k][0]))
        out = materialize(build(), "cached")
        self.kept[key] = (now, out)
        return out
