"""Retrieval: indexes, lexical and vector discovery, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring, text
from lodestrata.operators import lexical, ranking, vector
from lodestrata.plans.base import CHUNKS, QUESTIONS, chunks_in_place, query, questions, sql_path, sql_tokens, table
from lodestrata.session import once
from lodestrata.sources import formats

UNITS = f"all_units AS (SELECT DISTINCT job_result_id AS revision, {sql_path('path')} AS path, job_result_id || '#' || {sql_path('path')} AS unit_id FROM c)"


def posted_sql(scope: str = "TRUE") -> str:
    """Postings and statistics of the units in a scope, a condition on (unit_id, revision, path)."""
    return f"""c AS (SELECT * FROM {CHUNKS} WHERE job_result_id IS NOT NULL), {UNITS}, units AS (SELECT * FROM all_units WHERE {scope}),
posted AS (SELECT unit_id, revision, channel, token, count(*) AS tf FROM (
  SELECT job_result_id || '#' || {sql_path('path')} AS unit_id, job_result_id AS revision, 'content' AS channel, unnest({sql_tokens('text')}) AS token FROM c
  UNION ALL SELECT unit_id, revision, 'path', unnest({sql_tokens('path')}) FROM units) WHERE unit_id IN (SELECT unit_id FROM units) GROUP BY ALL),
lens AS (SELECT unit_id, channel, sum(tf) AS len FROM posted GROUP BY ALL),
stats AS (SELECT channel, count(*) AS n, avg(len) AS avg_len FROM lens GROUP BY ALL),
dfs AS (SELECT channel, token, count(*) AS df FROM posted GROUP BY ALL),
avg_idf AS (SELECT channel, sum(m * n_r) / sum(n_r) AS avg_idf FROM (
  SELECT revision, channel, avg(ln(n_r - df_r + 0.5) - ln(df_r + 0.5)) AS m, any_value(n_r) AS n_r
  FROM (SELECT revision, channel, token, count(*) AS df_r FROM posted GROUP BY ALL) JOIN (SELECT revision, count(*) AS n_r FROM units GROUP BY ALL) USING (revision) GROUP BY ALL) GROUP BY ALL)"""


def scored_sql(scope: str = "TRUE", k: int = 20) -> str:
    """The k best units of each question among those in a scope."""
    return f"""WITH {posted_sql(scope)}, q AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS token FROM {QUESTIONS}),
scored AS (SELECT query_id, unit_id, channel, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score FROM (
  SELECT q.query_id, p.unit_id, p.channel, p.tf, l.len, s.avg_len, CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) >= 0 THEN ln(n - df + 0.5) - ln(df + 0.5) ELSE 0.25 * avg_idf END AS idf
  FROM q JOIN posted p USING (token) JOIN lens l ON l.unit_id = p.unit_id AND l.channel = p.channel JOIN stats s ON s.channel = p.channel JOIN dfs d ON d.channel = p.channel AND d.token = p.token JOIN avg_idf a ON a.channel = p.channel) GROUP BY ALL),
fused AS (SELECT query_id, unit_id, round(sum(CASE channel WHEN 'path' THEN 1.0 ELSE 2.0 END / (60 + r)), 6) AS lex FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, unit_id) AS r FROM scored WHERE score > 0) GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, unit_id) AS rank FROM fused) WHERE rank <= {k})"""


POSTED, SCORED = posted_sql(), scored_sql()


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_in_place(spark, sf_dir).where("job_result_id is not null")


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The index of all chunks, written once for all queries of a session."""
    return once(spark, ("lexical", sf_dir), lambda: lexical.build_index(_chunks(spark, sf_dir)))


def _lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("agg_01_term_frequency", f"WITH {POSTED} SELECT unit_id, channel, token, tf FROM posted")
def term_frequency(spark, sf_dir):
    return lexical.postings(_chunks(spark, sf_dir)).drop("revision")


@query("agg_02_document_frequency", f"WITH {POSTED} SELECT channel, token, df FROM dfs")
def document_frequency(spark, sf_dir):
    return lexical.document_frequency(lexical.postings(_chunks(spark, sf_dir)))


@query("agg_03_channel_stats", f"WITH {POSTED} SELECT channel, n, round(avg_len, 6) AS avg_len FROM stats")
def channel_stats(spark, sf_dir):
    return lexical.channel_stats(lexical.unit_lengths(lexical.postings(_chunks(spark, sf_dir)))).select("channel", "n", F.round("avg_len", 6).alias("avg_len"))


@query("agg_04_05_average_idf", f"WITH {POSTED} SELECT channel, round(avg_idf, 6) AS avg_idf FROM avg_idf")
def average_idf(spark, sf_dir):
    return _index(spark, sf_dir).stats.select("channel", F.round("avg_idf", 6).alias("avg_idf"))


@query("cor_20_map_units", f"WITH c AS (SELECT * FROM {CHUNKS} WHERE job_result_id IS NOT NULL), {UNITS} SELECT unit_id, revision, path FROM all_units")
def units(spark, sf_dir):
    return lexical.map_units(_chunks(spark, sf_dir))


@query("cor_01_lexical_discovery", SCORED + """ SELECT query_id, rank, unit_id, lex, round(CASE WHEN max(lex) OVER w = min(lex) OVER w THEN 0.5 ELSE (lex - min(lex) OVER w) / (max(lex) OVER w - min(lex) OVER w) END, 6) AS discovery_score
FROM top WINDOW w AS (PARTITION BY query_id)""")  # fmt: skip
def discovery(spark, sf_dir):
    return lexical.discover(_index(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "rank", "unit_id", "lex", "discovery_score")


@query("ma_01_bm25_scores", SCORED + " SELECT query_id, unit_id, channel, round(score, 6) AS score FROM scored")
def bm25_scores(spark, sf_dir):
    return lexical.score(lexical.query_tokens(questions(spark, sf_dir)), _index(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("jop_units_to_chunks", SCORED + f""" SELECT query_id, rank, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, sort_order, chunk_id, id) AS row_no
FROM top JOIN (SELECT *, job_result_id || '#' || {sql_path('path')} AS unit_id FROM c) USING (unit_id)""")  # fmt: skip
def units_to_chunks(spark, sf_dir):
    """A unit stands for all chunks of its section, in their order."""
    c = _chunks(spark, sf_dir)
    rows = c.select("id", "chunk_id", "sort_order", F.concat_ws("#", "job_result_id", text.normal_path(F.col("path"))).alias("unit_id"))
    w = Window.partitionBy("query_id").orderBy("rank", "sort_order", "chunk_id", "id")
    return rows.join(F.broadcast(lexical.discover(_index(spark, sf_dir), questions(spark, sf_dir))), "unit_id").select("query_id", "rank", "id", F.row_number().over(w).alias("row_no"))


PAGES = """sims AS (SELECT q.vec_id AS query_id, p.vec_id AS page_id, round(CASE WHEN list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) IS NULL THEN 0 ELSE list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]) END, 9) AS similarity
 FROM embeddings q CROSS JOIN embeddings p WHERE q.vec_id % 50 = 0), pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, page_id) AS rank FROM sims) WHERE rank <= 10)"""


def _pages(spark, sf_dir, k=10):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector"))
    return vector.top_pages(e.where("page_id % 50 = 0").withColumnRenamed("page_id", "query_id"), e, k)


@query("cor_02_visual_discovery", f"WITH {PAGES} SELECT query_id, page_id, round(similarity, 6) AS similarity, rank FROM pages")
def visual(spark, sf_dir):
    return _pages(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


@query("agg_06_visual_hits_by_document", f"""WITH {PAGES} SELECT query_id, label, round(greatest(max(similarity), 0), 6) AS similarity, list_sort(list_distinct(list(page_id))) AS page_nums
FROM pages JOIN embeddings ON vec_id = page_id GROUP BY ALL""")  # fmt: skip
def visual_hits(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), "label")
    return _pages(spark, sf_dir).join(e, "page_id").groupBy("query_id", "label").agg(F.round(F.greatest(F.max("similarity"), F.lit(0.0)), 6).alias("similarity"), F.sort_array(F.collect_set("page_id")).alias("page_nums"))


HEAT = """h AS (SELECT user_id, count(*) AS hits, max(ts) AS last_hit, min(ts) AS created FROM events GROUP BY ALL),
heat AS (SELECT user_id, hits, round(0.7 * hits * exp(-0.693 * (epoch(TIMESTAMP '2024-02-01') - epoch(last_hit)) / 86400 / 30) + 0.3 * exp(-0.693 * (epoch(TIMESTAMP '2024-02-01') - epoch(created)) / 86400 / 30), 4) AS heat FROM h)"""


def _heat(spark, sf_dir):
    return ranking.usage_heat(table(spark, sf_dir, "events").select(F.col("user_id"), "ts"), "user_id", "ts", F.to_timestamp(F.lit("2024-02-01 00:00:00")))


@query("ma_06_usage_heat", f"WITH {HEAT} SELECT user_id, hits, round(heat, 3) AS heat FROM heat")
def heat(spark, sf_dir):
    return _heat(spark, sf_dir).select("user_id", "hits", F.round("heat", 3).alias("heat"))


@query("win_05_importance", f"""WITH {HEAT}, o AS (SELECT list(heat ORDER BY heat) AS l, count(*) AS n FROM heat), z AS (SELECT l[n // 2 + 1] AS m, CASE WHEN n < 4 THEN l[1] ELSE l[n // 4 + 1] END AS q1, CASE WHEN n < 4 THEN l[n] ELSE l[3 * n // 4 + 1] END AS q3 FROM o)
SELECT user_id, round(CASE WHEN q3 - q1 <= 1e-9 THEN 1 ELSE 0.1 + 1.9 / (1 + exp(-(heat - m) / (q3 - q1))) END, 2) AS importance FROM heat, z""")  # fmt: skip
def importance(spark, sf_dir):
    return ranking.importance(_heat(spark, sf_dir), "heat").select("user_id", F.round("importance", 2).alias("importance"))


@query("ma_04_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.alias("a").join(e.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", F.round(scoring.cosine(F.col("a.embedding"), F.col("b.embedding")), 6).alias("similarity"))
