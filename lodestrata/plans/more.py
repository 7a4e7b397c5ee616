"""Plans over pages, scopes, costs, packages and result sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import graphs, lexical, sheets, structure, tools
from lodestrata.plans.base import CHUNKS, QUESTIONS, SECTIONS, chunks, chunks_in_place, latest, query, questions, sections, sql, sql_path, sql_tokens, table
from lodestrata.plans.relational import C, J, R, S
from lodestrata.plans.retrieval import POSTED, SCORED, _chunks, _index, _lines_of
from lodestrata.sources import sinks
from lodestrata.streaming import windows

# pages
sql("win_13_back_jumps", "directory_sections", f"SELECT section_id, sum(jump) OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT section_id, job_result_id, sort_order, CASE WHEN array_min(page_nums) < lag(array_min(page_nums)) OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id) THEN 1 ELSE 0 END AS jump FROM {S} s WHERE size(page_nums) > 0) x",
    f"SELECT section_id, CAST(sum(jump) OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM (SELECT section_id, job_result_id, sort_order, CASE WHEN list_min(page_nums) < lag(list_min(page_nums)) OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id) THEN 1 ELSE 0 END AS jump FROM {S} s WHERE len(page_nums) > 0) x")
sql("doc_14_fat_leaves", "directory_sections", f"SELECT s.section_id, size(s.page_nums) AS n_pages FROM {S} s WHERE size(s.page_nums) >= 3 AND NOT EXISTS (SELECT 1 FROM {S} c WHERE c.parent_section_id = s.section_id)", f"SELECT s.section_id, len(s.page_nums) AS n_pages FROM {S} s WHERE len(s.page_nums) >= 3 AND NOT EXISTS (SELECT 1 FROM {S} c WHERE c.parent_section_id = s.section_id)")
sql("cor_16_list_documents", "documents job_results job_chunks", f"SELECT d.document_id, count(DISTINCT r.id) AS n_results, count(c.id) AS n_chunks FROM {{documents}} d LEFT JOIN {R} r ON r.document_id = d.document_id LEFT JOIN {C} c ON c.job_result_id = r.id GROUP BY d.document_id")
sql("cor_27_versions", "job_results", f"SELECT document_id, id, row_number() OVER (PARTITION BY document_id ORDER BY created_at, id) AS version, CASE WHEN row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id DESC) = 1 THEN 1 ELSE 0 END AS is_current FROM {R} r WHERE document_id IS NOT NULL")
sql("stm_03_earliest_retry", "events", "SELECT user_id, min(ts) + INTERVAL '60' SECOND AS retry_at, count(*) AS n FROM (SELECT user_id, ts, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM {events}) x WHERE ts > last_ts - INTERVAL '1' DAY GROUP BY user_id")
sql("stm_08_outbox_claims", "jobs", f"SELECT job_id, updated_at, row_number() OVER (PARTITION BY user_id ORDER BY updated_at, job_id) AS attempt_order FROM {J} j WHERE status NOT IN ('done', 'failed')")
@query("joi_02_posting_lookup", f"WITH {POSTED}, q AS (SELECT DISTINCT query_id, unnest({sql_tokens('query')}) AS token FROM {QUESTIONS}) SELECT query_id, channel, count(*) AS n, sum(tf)::BIGINT AS tf FROM q JOIN posted USING (token) GROUP BY ALL")
def posting_lookup(spark, sf_dir):
    tokens = questions(spark, sf_dir).select("query_id", F.explode(text.distinct_tokens(F.col("query"))).alias("token"))
    return lexical.postings(_chunks(spark, sf_dir)).join(tokens, "token").groupBy("query_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))


@query("joi_14_keyword_peers", f"""WITH k AS (SELECT DISTINCT job_result_id AS r, unnest(from_json(chunk_metadata->'$.keywords', '["VARCHAR"]')) AS k FROM {CHUNKS} WHERE json_type(chunk_metadata, '$.keywords') = 'ARRAY') SELECT a.r AS a, b.r AS b, count(*) AS shared FROM k a JOIN k b ON a.k = b.k AND a.r < b.r GROUP BY ALL""")
def keyword_peers(spark, sf_dir):
    s = chunks_in_place(spark, sf_dir).select("job_result_id", F.explode(F.from_json(F.get_json_object("chunk_metadata", "$.keywords"), "array<string>")).alias("keyword"))
    return graphs.overlaps(s, "job_result_id", "keyword", 0.0, 1).select("a", "b", "shared")


@query("cor_15_neighbours", """WITH e AS (SELECT l_partkey AS a, l_suppkey + 1000000 AS b, count(*) AS weight FROM lineitem GROUP BY ALL) SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e""")
def neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).agg(F.count(F.lit(1)).alias("weight"))
    return graphs.neighbours(e)


@query("cor_13_read", f"""WITH c AS (SELECT id, {sql_path('path')} AS path FROM {CHUNKS} WHERE chunk_type IN ('text', 'page')), refs AS (SELECT unnest(['Root', 'tender_file.pdf', 'no such path']) AS ref)
SELECT ref, CASE WHEN id IS NULL THEN 'failed' ELSE 'ok' END AS status, id FROM refs LEFT JOIN c ON path = ref OR starts_with(path, ref || ' / ')""")  # fmt: skip
def read(spark, sf_dir):
    return tools.read(chunks(spark, sf_dir), ["Root", "tender_file.pdf", "no such path"], "descendants").select("ref", "status", "id")


@query("cor_14_assets", f"SELECT job_result_id, id, path FROM {CHUNKS} WHERE chunk_type = 'image' AND contains(lower(coalesce(text, '')), 'page') ORDER BY job_result_id, sort_order, id LIMIT 50")
def assets(spark, sf_dir):
    return tools.assets(chunks(spark, sf_dir), "image", "page")


@query("cor_17_query_table", "SELECT n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation WHERE n_regionkey::VARCHAR > '2' ORDER BY n_name LIMIT 50")
def grid_select(spark, sf_dir):
    grid = [["n_name", "n_regionkey"]] + [[r.n_name, str(r.n_regionkey)] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    html = "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in grid) + "</table>"
    return sheets.query_table(spark, html, "SELECT n_name, n_regionkey FROM t WHERE n_regionkey > '2' ORDER BY n_name")


@query("doc_20_navigation", f"""WITH c AS (SELECT job_result_id AS revision, {sql_path('path')} AS path, chunk_type FROM {CHUNKS} WHERE job_result_id IS NOT NULL), b AS (SELECT revision, bool_or(chunk_type IN ('text', 'page')) AS any_body FROM c GROUP BY ALL),
u AS (SELECT c.* FROM c JOIN b USING (revision) WHERE chunk_type IN ('text', 'page') OR NOT any_body), n AS (SELECT revision, path, unnest(list_transform(range(1, len(string_split(path, ' / ')) + 1), lambda i: array_to_string(string_split(path, ' / ')[1:i], ' / '))) AS node FROM u)
SELECT revision, node AS path, sum(CASE WHEN node = path THEN 1 ELSE 0 END)::BIGINT AS own_chunks, count(*) AS total_chunks, len(string_split(node, ' / ')) AS depth FROM n GROUP BY revision, node""")  # fmt: skip
def navigation(spark, sf_dir):
    c = _chunks(spark, sf_dir).select(F.col("job_result_id").alias("revision"), text.normal_path(F.col("path")).alias("path"), "chunk_type", F.lit(1).alias("n_pages"), F.lit("").alias("summary"), "sort_order")
    return sinks.navigation(c).drop("summary")


@query("snk_01_upsert", f"WITH old AS (SELECT DISTINCT job_id, min(updated_at) OVER (PARTITION BY job_id) AS seen_at FROM jobs), new AS (SELECT job_id, updated_at AS seen_at FROM {J.format(jobs='jobs')} j WHERE status = 'done') SELECT job_id, seen_at FROM new UNION ALL SELECT job_id, seen_at FROM old WHERE job_id NOT IN (SELECT job_id FROM new)")
def upsert(spark, sf_dir):
    j = table(spark, sf_dir, "jobs")
    old = j.groupBy("job_id").agg(F.min("updated_at").alias("seen_at"))
    new = latest(j, "job_id", "updated_at", "status", "credits_charged").where("status = 'done'").select("job_id", F.col("updated_at").alias("seen_at"))
    return sinks.upsert(old, new, ["job_id"])


@query("snk_03_package_statistics", f"SELECT job_result_id AS revision, count(*) AS total, count(*) FILTER (WHERE chunk_type NOT IN ('image', 'table', 'page') OR chunk_type IS NULL) AS text, count(*) FILTER (WHERE chunk_type = 'image') AS image, count(*) FILTER (WHERE chunk_type = 'table') AS \"table\", count(*) FILTER (WHERE chunk_type = 'page') AS page FROM {CHUNKS} GROUP BY 1")
def package_statistics(spark, sf_dir):
    return sinks.package_statistics(chunks(spark, sf_dir).withColumnRenamed("job_result_id", "revision"))


@query("cor_26_path_hydration", SCORED + " SELECT query_id, path, min(rank) AS first_seen, max(lex) AS confidence FROM top JOIN units USING (unit_id) GROUP BY ALL")
def path_hydration(spark, sf_dir):
    """First-seen order of paths, each with the best confidence of its places."""
    c = _chunks(spark, sf_dir)
    return lexical.discover(_index(spark, sf_dir), questions(spark, sf_dir)).join(_index(spark, sf_dir).units, "unit_id").groupBy("query_id", "path").agg(F.min("rank").alias("first_seen"), F.max("lex").alias("confidence"))


@query("stm_09_sliding_windows", "SELECT b AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - INTERVAL '12 hours']) AS b FROM events) GROUP BY ALL")
def sliding(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windows.windowed_counts(e, ["event_type"], "1 day", "12 hours")


@query("stm_sessions", """SELECT user_id, min(ts) AS started, max(ts) + INTERVAL '2 hours' AS ended, count(*) AS n FROM (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '2 hours' THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, s""")  # fmt: skip
def session_windows(spark, sf_dir):
    return windows.session_counts(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id")


@query("doc_21_media_windows")
def media_windows(spark, sf_dir):
    """Transcripts in processing windows of 5 minutes: a line 5 minutes or more after its window's first opens a new one (a fold)."""
    spoken = structure.transcript(_lines_of(spark, sf_dir), "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list("start_ms")).alias("starts"))
    return spoken.select("doc_id", F.posexplode(structure.processing_windows(F.col("starts"), 300_000)).alias("part", "w")).select("doc_id", "part", F.col("w.first_ms").alias("first_ms"), F.col("w.n").alias("n"))


@query("tab_05_regions")
def regions(spark, sf_dir):
    """Regions of every table chunk taken as a sheet."""
    t = chunks(spark, sf_dir).where("chunk_type = 'table' and text like '%<table%'").select(F.col("id").alias("sheet"), F.posexplode(sheets.html_grid(F.col("text"))).alias("row", "cells"))
    return sheets.sheet_regions(t.select("sheet", "row", F.posexplode("cells").alias("col", "value")))


@query("doc_18_keyword_cascade", f"WITH h AS (SELECT job_result_id, section_id, lower(coalesce(section_title, '')) AS t FROM {SECTIONS}) SELECT job_result_id, section_id FROM h WHERE contains(t, 'appendix') OR (contains(t, 'overview') AND job_result_id NOT IN (SELECT job_result_id FROM h WHERE contains(t, 'appendix')))")
def keyword_cascade(spark, sf_dir):
    """Hits of the first keyword; where a result has none, those of the second."""
    h = sections(spark, sf_dir).select("job_result_id", "section_id", F.lower(F.coalesce("section_title", F.lit(""))).alias("t"))
    first = h.where(F.contains("t", F.lit("appendix")))
    second = h.where(F.contains("t", F.lit("overview")) & ~F.contains("t", F.lit("appendix"))).join(first.select("job_result_id").distinct(), "job_result_id", "left_anti")
    return first.unionByName(second).select("job_result_id", "section_id")


@query("agg_08_keyword_sets", f"""SELECT job_result_id, list_sort(list_distinct(list(k))) AS keywords FROM (SELECT job_result_id, trim(lower(unnest(from_json(chunk_metadata->'$.keywords', '["VARCHAR"]')))) AS k FROM {CHUNKS} WHERE json_type(chunk_metadata, '$.keywords') = 'ARRAY') WHERE length(k) > 1 AND NOT regexp_matches(k, '^[0-9]+[.,%]*$') GROUP BY 1""")
def keyword_sets(spark, sf_dir):
    k = chunks(spark, sf_dir).select("job_result_id", F.explode(F.from_json(F.get_json_object("chunk_metadata", "$.keywords"), "array<string>")).alias("k")).withColumn("k", text.normal_keyword(F.col("k")))
    return k.where("k is not null").groupBy("job_result_id").agg(F.sort_array(F.collect_set("k")).alias("keywords"))


@query("win_01_channel_ranks", SCORED + " SELECT query_id, channel, unit_id, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, unit_id) AS r FROM scored WHERE score > 0) WHERE r <= 5")
def channel_ranks(spark, sf_dir):
    return lexical.channel_best(_index(spark, sf_dir), questions(spark, sf_dir), 5).select("query_id", "channel", "unit_id", F.col("rank").alias("r"))
