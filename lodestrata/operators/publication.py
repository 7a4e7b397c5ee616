"""Publication: replacing a scope of a revision, and completions that count only for the claim they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A scope that stands for all of a revision but its media.
EVERYTHING, MEDIA = "*", ("audio", "video")


def replace_scope(chunks: DataFrame, fresh: DataFrame, scopes: DataFrame) -> DataFrame:
    """Chunks with those of some scopes replaced, numbered anew from 0 within each revision.

    chunks and fresh (revision, scope_key, id, path, chunk_type, sort_order, ...), scopes (revision, scope_key).
    The scope '*' takes all chunks but audio and video. Of fresh chunks with the same path the first stays
    (a null path is no path); fresh chunks take the place of kept ones with their id.
    """
    marks = scopes.select("revision", F.col("scope_key").alias("_s")).distinct()
    whole = marks.where(F.col("_s") == EVERYTHING).select("revision").withColumn("_all", F.lit(True))
    kept = chunks.join(marks.withColumnRenamed("_s", "scope_key"), ["revision", "scope_key"], "left_anti").join(whole, "revision", "left")
    kept = kept.where(F.col("_all").isNull() | F.col("chunk_type").isin(*MEDIA)).drop("_all").join(fresh.select("revision", "id"), ["revision", "id"], "left_anti")
    w = Window.partitionBy("revision", "path").orderBy("sort_order", "id")
    once = fresh.withColumn("_r", F.row_number().over(w)).where("_r = 1 or path is null").drop("_r")
    order = Window.partitionBy("revision").orderBy("scope_key", "_old", "id")
    return kept.unionByName(once.select(*kept.columns)).withColumnRenamed("sort_order", "_old").withColumn("sort_order", F.row_number().over(order) - 1).drop("_old")


def section_order(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(revision, path, position): sections by the first chunk at or below them, those above first; unvisited ones at the end by path."""
    from lodestrata.functions import text

    first = chunks.withColumn("node", F.explode(text.path_prefixes(F.col("path")))).groupBy("revision", F.col("node").alias("path")).agg(F.min("sort_order").alias("first"))
    w = Window.partitionBy("revision").orderBy(F.col("first").isNull(), "first", F.size(F.split("path", text.SEPARATOR)), "path")
    return sections.select("revision", "path").distinct().join(first, ["revision", "path"], "left").select("revision", "path", (F.row_number().over(w) - 1).alias("position"))


def claimable(claims: DataFrame, now, lease_seconds: int, max_attempts: int) -> DataFrame:
    """Latest claim of each key that may be taken: coarse or queued, failed with attempts left, or running beyond its lease."""
    latest = claims.groupBy("key").agg(F.max_by(F.struct("generation", "state", "attempts", "updated_at"), "generation").alias("c")).select("key", "c.*")
    stale = (F.col("state") == "running") & (F.col("updated_at").cast("timestamp").cast("double") < now.cast("double") - lease_seconds)
    return latest.where(F.col("state").isin("coarse", "queued") | ((F.col("state") == "failed") & (F.col("attempts") < max_attempts)) | stale)


def apply_completions(claims: DataFrame, completions: DataFrame) -> DataFrame:
    """(key, generation, state): a completion counts only for the latest generation of its key; late ones change nothing."""
    latest = claims.groupBy("key").agg(F.max_by(F.struct("generation", "state"), "generation").alias("c")).select("key", "c.generation", "c.state")
    done = completions.groupBy("key", "generation").agg(F.max("state").alias("new_state"))
    return latest.join(done, ["key", "generation"], "left").select("key", "generation", F.coalesce("new_state", "state").alias("state"))
