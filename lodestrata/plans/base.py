"""Common pieces of the plans: views of the input tables, and queries stated once for both engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.session import materialize, once, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that states the same."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, tables: str, statement: str, oracle: str | None = None) -> None:
    """Register a query in Spark SQL; ``oracle`` is its SQL for the other engine where dialects differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(statement, **{t: table(spark, sf_dir, t) for t in tables.split()})

    QUERIES[name] = run
    names = {t: t for t in tables.split()}
    ORACLES[name] = (oracle or statement).format(**names)


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by ``order``; keys are many and their rows few."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, each id once."""
    return latest(table(spark, sf_dir, "job_chunks"), "id", "created_at", "chunk_id")


#: Ids delivered again, by their hashes, that are broadcast.
BROADCAST_KEYS = 1_000_000


def chunks_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``chunks``; only rows of ids delivered again are shuffled. Ids that share a hash only take the longer way."""
    rows = table(spark, sf_dir, "job_chunks")
    seen = rows.groupBy(F.xxhash64("id").alias("_h")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_h")
    again = once(spark, ("again", sf_dir), lambda: materialize(seen, "again"))
    if again.count() > BROADCAST_KEYS:
        return chunks(spark, sf_dir)
    hashed = rows.withColumn("_h", F.xxhash64("id"))
    several = hashed.join(F.broadcast(again), "_h", "left_semi").drop("_h")
    return hashed.join(F.broadcast(again), "_h", "left_anti").drop("_h").unionByName(latest(several, "id", "created_at", "chunk_id"))


CHUNKS = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, chunk_id DESC NULLS LAST) rn FROM job_chunks) WHERE rn = 1)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory sections, each id once."""
    return latest(table(spark, sf_dir, "directory_sections"), "section_id", "created_at")


SECTIONS = "(SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY created_at DESC NULLS LAST) rn FROM directory_sections) WHERE rn = 1)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query): the question that each evaluation item asks."""
    items = table(spark, sf_dir, "eval_items")
    return items.select(F.col("item_id").alias("query_id"), F.regexp_extract("text", QUESTION, 1).alias("query")).where("query <> ''")


QUESTION = r"([^.:\n?？。]+[?？])"
QUESTIONS = f"(SELECT * FROM (SELECT item_id AS query_id, regexp_extract(text, '{QUESTION}', 1) AS query FROM eval_items) WHERE query <> '')"


def sql_tokens(c: str) -> str:
    low = f"lower(regexp_replace(coalesce({c}, ''), '\\[\\[?(?:chunk|image|table):[^\\]\\s]+\\]?\\]', ' ', 'g'))"
    runs = f"list_filter(regexp_extract_all(regexp_replace({low}, '([一-鿿]+)', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2 AND regexp_matches(x, '[a-z0-9一-鿿]'))"
    return f"flatten(list_transform({runs}, lambda x: CASE WHEN regexp_matches(x, '^[一-鿿]') THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [x] END))"


def sql_path(c: str) -> str:
    return f"coalesce(nullif(array_to_string(list_filter(list_transform(string_split(coalesce({c}, ''), '/'), lambda x: trim(x)), lambda x: x <> ''), ' / '), ''), 'Root')"


__all__ = ["CHUNKS", "ORACLES", "QUERIES", "QUESTIONS", "SECTIONS", "chunks", "chunks_in_place", "latest", "query", "questions", "sections", "sql", "sql_path", "sql_tokens", "table", "text"]
