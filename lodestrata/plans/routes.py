"""Plans of whole routes: scoped and hybrid discovery, ranking, recall, the classic route and its short cut.

Pages and questions have no vectors of their own in the input: a page chunk takes the vector its id's digest points to, a question that
of its number.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring, text
from lodestrata.operators import lexical, ranking, routes, vector
from lodestrata.plans.base import CHUNKS, QUESTIONS, SECTIONS, chunks, query, questions, sections, sql_path, table
from lodestrata.plans.retrieval import HEAT, _chunks, _heat, _index, scored_sql
from lodestrata.session import once

#: In scope: the latest result of each document, sections with text or pages, not the root.
PINS = "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) AS r FROM (SELECT DISTINCT id, document_id, created_at FROM job_results) WHERE document_id IS NOT NULL) WHERE r = 1"
SCOPE = f"path <> 'Root' AND revision IN ({PINS}) AND unit_id IN (SELECT job_result_id || '#' || {sql_path('path')} FROM c WHERE chunk_type IN ('text', 'page'))"
PREFIX = "('0x' || substr(md5({}), 1, 8))::BIGINT"
NORMAL = "round(CASE WHEN max({0}) OVER w <= 0 THEN 0 WHEN max({0}) OVER w = min({0}) OVER w THEN 0.5 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END, 6)"
COSINE = "round(coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0), 9)"


def hybrid_sql(scope: str = "TRUE", k: int = 20) -> str:
    return f"""{scored_sql(scope, k)}, size AS (SELECT count(*) AS n FROM embeddings),
pv AS (SELECT id, job_result_id || '#' || {sql_path('path')} AS key, {PREFIX.format('id')} % (SELECT n FROM size) AS vec_id FROM c WHERE chunk_type = 'page' AND id IS NOT NULL),
pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM (SELECT query_id, b.vec_id, {COSINE} AS similarity FROM {QUESTIONS} q JOIN embeddings a ON a.vec_id = query_id % (SELECT n FROM size) CROSS JOIN embeddings b)) WHERE r <= 10),
vis AS (SELECT * FROM (SELECT query_id, key, round(greatest(similarity, 0), 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY r, key) AS rank FROM (SELECT query_id, key, min(r) AS r, max(similarity) AS similarity FROM pg JOIN pv USING (vec_id) WHERE key IN (SELECT unit_id FROM units) GROUP BY ALL)) WHERE rank <= {k}),
merged AS (SELECT query_id, key, lex, l.rank AS l, similarity, v.rank AS v FROM (SELECT query_id, unit_id AS key, lex, rank FROM top) l FULL JOIN vis v USING (query_id, key)),
f AS (SELECT query_id, key, CASE WHEN count(l) OVER w > 0 AND count(v) OVER w > 0 THEN round(coalesce(3.0::DOUBLE / (60 + l), 0) + coalesce(1.5::DOUBLE / (60 + v), 0), 9) ELSE coalesce(lex, similarity) END AS score FROM merged WINDOW w AS (PARTITION BY query_id)),
hy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM f) WHERE rank <= {k}),
hs AS (SELECT *, {NORMAL.format('score')} AS discovery_score FROM hy WINDOW w AS (PARTITION BY query_id))"""


def _pointed(key, size: int):
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % size


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = max(1, e.count())
    pages = _chunks(spark, sf_dir).where("chunk_type = 'page' and id is not null").select("id", F.concat_ws("#", "job_result_id", text.normal_path(F.col("path"))).alias("key"), _pointed(F.col("id"), n).alias("vec_id"))
    asked = questions(spark, sf_dir).select("query_id", (F.col("query_id") % n).alias("vec_id")).join(e, "vec_id").select("query_id", F.col("embedding").alias("vector"))
    return e, pages, asked


def _seen(spark, sf_dir, units, k=20):
    e, pages, asked = _vectors(spark, sf_dir)
    best = vector.top_pages(asked, e.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector")), 10)
    hits = best.join(pages.join(units.select(F.col("unit_id").alias("key")), "key", "left_semi").withColumnRenamed("vec_id", "page_id"), "page_id").groupBy("query_id", "key").agg(F.min("rank").alias("r"), F.max("similarity").alias("similarity"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "key"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "key", F.round(F.greatest("similarity", F.lit(0.0)), 6).alias("similarity"), "rank")


def _scoped(spark, sf_dir):
    def build():
        r = table(spark, sf_dir, "job_results").where("document_id is not null")
        pins = r.groupBy("document_id").agg(F.max(F.struct("created_at", "id")).alias("x")).select(F.col("x.id").alias("revision"))
        allowed = _chunks(spark, sf_dir).where(F.col("chunk_type").isin("text", "page")).select(F.concat_ws("#", "job_result_id", text.normal_path(F.col("path"))).alias("unit_id"))
        index = _index(spark, sf_dir)
        return lexical.restrict(index, index.units.where("path <> 'Root'").join(pins, "revision", "left_semi").join(allowed, "unit_id", "left_semi"))

    return once(spark, ("scoped", sf_dir), build)


def _hybrid(spark, sf_dir, index, k=20):
    found = lexical.discover(index, questions(spark, sf_dir), k).withColumnRenamed("unit_id", "key")
    return routes.hybrid(found, _seen(spark, sf_dir, index.units, k), k)


@query("cor_01_scoped_discovery", scored_sql(SCOPE) + " SELECT query_id, rank, unit_id, lex FROM top")
def scoped_discovery(spark, sf_dir):
    """Revision pins, an excluded section and chunk types; statistics are those of the scope."""
    return lexical.discover(_scoped(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "rank", "unit_id", "lex")


@query("fil_scope_statistics", scored_sql(SCOPE) + " SELECT channel, n, round(avg_len, 6) AS avg_len, round(avg_idf, 6) AS avg_idf FROM stats JOIN avg_idf USING (channel)")
def scope_statistics(spark, sf_dir):
    return _scoped(spark, sf_dir).stats.select("channel", "n", F.round("avg_len", 6).alias("avg_len"), F.round("avg_idf", 6).alias("avg_idf"))


@query("cor_03_win_03_hybrid_discovery", hybrid_sql() + " SELECT query_id, key, round(score, 6) AS score, rank, discovery_score FROM hs")
def hybrid_discovery(spark, sf_dir):
    return _hybrid(spark, sf_dir, _index(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("cor_08_recall", hybrid_sql(SCOPE, 10) + " SELECT query_id, key, rank, discovery_score FROM hs")
def recall(spark, sf_dir):
    """Ten candidates in scope."""
    return _hybrid(spark, sf_dir, _scoped(spark, sf_dir), 10).select("query_id", "key", "rank", "discovery_score")


@query("cor_04_lit_pages", hybrid_sql() + f""", lit AS (SELECT query_id, key, pv.vec_id, {COSINE} AS similarity FROM hs JOIN pv USING (key) JOIN embeddings b ON b.vec_id = pv.vec_id JOIN embeddings a ON a.vec_id = query_id % (SELECT n FROM size))
SELECT query_id, key, vec_id, round(similarity, 6) AS similarity FROM (SELECT DISTINCT *, row_number() OVER (PARTITION BY query_id, key ORDER BY similarity DESC, vec_id) AS r FROM lit) WHERE r = 1""")  # fmt: skip
def lit_pages(spark, sf_dir):
    """The best page inside each section found; sections without pages have none."""
    e, pages, asked = _vectors(spark, sf_dir)
    rows = _hybrid(spark, sf_dir, _index(spark, sf_dir)).select("query_id", "key").join(pages.drop("id").distinct(), "key").join(e, "vec_id").join(asked, "query_id")
    sims = rows.select("query_id", "key", "vec_id", F.round(F.coalesce(scoring.cosine(F.col("vector"), F.col("embedding")), F.lit(0.0)), 9).alias("similarity"))
    best = sims.groupBy("query_id", "key").agg(F.max(F.struct("similarity", (-F.col("vec_id")).alias("at"))).alias("x"))
    return best.select("query_id", "key", (-F.col("x.at")).alias("vec_id"), F.round("x.similarity", 6).alias("similarity"))


UNIT_HEAT = f"""{HEAT}, unit_heat AS (SELECT unit_id AS key, heat FROM all_units JOIN heat ON user_id = {PREFIX.format('unit_id')} % (SELECT max(user_id) + 1 FROM events))"""
RANKED = """raw AS (SELECT d.*, coalesce(h.heat, 0) AS heat FROM both_rows d LEFT JOIN unit_heat h USING (key)), z AS (SELECT query_id, list_sort(list(heat)) AS l, count(*) AS n FROM raw GROUP BY ALL),
y AS (SELECT query_id, CASE WHEN n % 2 = 1 THEN l[n // 2 + 1] ELSE (l[n // 2] + l[n // 2 + 1]) / 2 END AS m, CASE WHEN n >= 4 THEN l[n // 4 + 1] ELSE l[1] END AS q1, CASE WHEN n >= 4 THEN l[3 * n // 4 + 1] ELSE l[n] END AS q3 FROM z),
x AS (SELECT raw.*, CASE WHEN q3 - q1 <= 1e-9 THEN 1 ELSE round(0.1 + 1.9 / (1 + exp(-(heat - m) / (q3 - q1))), 4) END AS mult, count(place_b) OVER (PARTITION BY query_id) > 0 AS routed FROM raw JOIN y USING (query_id)),
sc AS (SELECT query_id, key, routed, place, place_b, round(coalesce(a, 0) * mult, 6) AS agent_score, round(coalesce(d, 0) * mult, 6) AS discovery_score FROM x),
ranked AS (SELECT query_id, key, agent_score, discovery_score, CASE WHEN routed THEN agent_score ELSE greatest(agent_score, discovery_score) END AS score, rank FROM
 (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY routed AND agent_score <= 0, agent_score DESC, discovery_score DESC, place IS NULL, coalesce(place, place_b), key) AS rank FROM sc) WHERE rank <= 10)"""


def _unit_heat(spark, sf_dir):
    users = (table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] or 0) + 1
    return _index(spark, sf_dir).units.select(F.col("unit_id").alias("key"), _pointed(F.col("unit_id"), users).alias("user_id")).join(_heat(spark, sf_dir).select("user_id", "heat"), "user_id")


@query("cor_05_joi_18_top_05_rank_candidates", hybrid_sql() + f""", {UNIT_HEAT}, both_rows AS (SELECT query_id, key, h.discovery_score AS d, h.rank AS place, v.similarity AS a, v.rank AS place_b FROM hs h FULL JOIN (SELECT * FROM vis WHERE rank <= 5) v USING (query_id, key)), {RANKED}
SELECT query_id, key, agent_score, discovery_score, score, rank FROM ranked""")  # fmt: skip
def rank_candidates(spark, sf_dir):
    """The first visual hits stand for what an agent picked."""
    index = _index(spark, sf_dir)
    picked = _seen(spark, sf_dir, index.units).where("rank <= 5").select("query_id", "key", F.col("similarity").alias("agent_score"), F.col("rank").alias("place"))
    return ranking.rank_candidates(_hybrid(spark, sf_dir, index).withColumnRenamed("rank", "place"), picked, _unit_heat(spark, sf_dir), 10)


@query("cor_06_top_04_classic_route", hybrid_sql() + f""", {UNIT_HEAT}, both_rows AS (SELECT query_id, key, discovery_score AS d, rank AS place, NULL::DOUBLE AS a, NULL::BIGINT AS place_b FROM hs), {RANKED}
SELECT query_id, rank, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank, sort_order NULLS FIRST, chunk_id NULLS FIRST, id) AS row_no
FROM ranked JOIN (SELECT *, job_result_id || '#' || {sql_path('path')} AS key FROM c WHERE id IS NOT NULL) USING (key)""")  # fmt: skip
def classic_route(spark, sf_dir):
    rows = _chunks(spark, sf_dir).where("id is not null").select("id", "sort_order", "chunk_id", F.concat_ws("#", "job_result_id", text.normal_path(F.col("path"))).alias("key"))
    candidates = _hybrid(spark, sf_dir, _index(spark, sf_dir), routes.recall_k(10))
    return routes.classic(candidates, _unit_heat(spark, sf_dir), rows, 10)


@query("cor_07_src_16_small_corpus", f"SELECT job_result_id, id, row_number() OVER (PARTITION BY job_result_id ORDER BY sort_order, chunk_id, id) AS row_no FROM {CHUNKS} c WHERE job_result_id IN (SELECT job_result_id FROM {CHUNKS} GROUP BY ALL HAVING count(*) <= 10)")
def small_corpus(spark, sf_dir):
    """Results of ten chunks at most are returned whole."""
    return routes.small_scopes(_chunks(spark, sf_dir).select("job_result_id", "id", "chunk_id", "sort_order"), "job_result_id", 10, F.asc_nulls_last("sort_order"), F.asc_nulls_last("chunk_id"), F.asc_nulls_last("id")).select("job_result_id", "id", "row_no")


TERMS = ["glossary", "安全", "hydraulic press", "no such words at all", "webhook delivery"]


@query("cor_18_entry_documents", f"""WITH t AS (SELECT unnest({TERMS}) AS term), s AS (SELECT term, job_result_id AS revision, count(*) AS hits FROM {SECTIONS} JOIN t ON contains(lower(concat_ws(' ', section_title, section_path)), lower(term)) GROUP BY ALL)
SELECT term, revision, 'section' AS via, hits FROM s UNION ALL SELECT term, job_result_id, 'content', count(*) FROM {CHUNKS} JOIN t ON contains(lower(text), lower(term)) WHERE term NOT IN (SELECT term FROM s) GROUP BY ALL""")  # fmt: skip
def entry_documents(spark, sf_dir):
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    s = sections(spark, sf_dir).select(F.col("job_result_id").alias("revision"), F.col("section_title").alias("title"), F.col("section_path").alias("path"))
    return routes.entry_documents(terms, s, chunks(spark, sf_dir).select(F.col("job_result_id").alias("revision"), "text"))
