"""Vector retrieval over page embeddings, and fusion with lexical results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring

#: Query vectors compared with all pages in one pass; more go in further passes.
QUERY_BLOCK = 2_000


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def top_pages(queries: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """(query_id, page_id, similarity, rank): the k pages of highest cosine for each query vector, ties by page id.

    ``queries`` (query_id, vector) is a stated query set, broadcast in blocks;
    pages (page_id, vector) are read in place, and each batch sends only its own
    k best per query on. Null vectors match nothing, vectors of no length have
    similarity 0; all vectors have the same length.
    """
    spark = pages.sparkSession
    rows = queries.where("vector is not null").select("query_id", "vector").orderBy("query_id")
    clean = pages.where("vector is not null and page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), "vector")
    kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, page_id bigint, similarity double"
    out, block = None, []

    def search(block: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r[0] for r in block], _unit([r[1] for r in block])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                page = np.array(batch.column(0).to_pylist(), np.int64)
                sims = np.round(q @ _unit(batch.column(1).to_pylist()).T, 9)
                order = np.lexsort((np.broadcast_to(page, sims.shape), -sims), axis=1)[:, :k]
                at = np.repeat(np.arange(len(ids)), order.shape[1])
                found = order.ravel()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at]), pa.array(page[found]), pa.array(sims[at, found])], names=["query_id", "page_id", "similarity"])

        return clean.mapInArrow(run, schema)

    for row in rows.toLocalIterator():
        block.append((row.query_id, row.vector))
        if len(block) == QUERY_BLOCK:
            out, block = search(block) if out is None else out.unionByName(search(block)), []
    if block or out is None:
        last = search(block) if block else spark.createDataFrame([], schema)
        out = last if out is None else out.unionByName(last)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "page_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse_hybrid(lexical: DataFrame, visual: DataFrame, k: int, lexical_weight: float = 3.0, visual_weight: float = 1.5) -> DataFrame:
    """(query_id, key, score, rank) of lexical and visual rows (query_id, key, rank); a key's rows add up."""
    part = lambda df, w: df.select("query_id", "key", (F.lit(w) / (scoring.RRF_K + F.col("rank"))).alias("s"))
    total = part(lexical, lexical_weight).unionByName(part(visual, visual_weight)).groupBy("query_id", "key").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
