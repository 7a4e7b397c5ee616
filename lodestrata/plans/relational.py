"""Filters, joins, aggregates, windows, top-k and set operations over the service's tables."""

from __future__ import annotations

from lodestrata.plans.base import sql

#: Deduplicated inputs, valid in both dialects.
C = "(SELECT id, job_result_id, chunk_id, chunk_type, text, lang, path, chunk_metadata, sort_order, created_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, chunk_id DESC NULLS LAST) rn FROM {job_chunks}) x WHERE rn = 1)"
S = "(SELECT document_id, job_result_id, section_id, parent_section_id, section_path, section_title, section_level, sort_order, page_nums FROM (SELECT *, row_number() OVER (PARTITION BY section_id ORDER BY created_at DESC NULLS LAST) rn FROM {directory_sections}) x WHERE rn = 1)"
J = "(SELECT job_id, user_id, job_type, status, source_type, job_metadata, page_count, credits_charged, created_at, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, status DESC, credits_charged DESC) rn FROM {jobs}) x WHERE rn = 1)"
R = "(SELECT DISTINCT id, job_id, document_id, delivery_mode, result_size, created_at, updated_at FROM {job_results})"
D = "(SELECT DISTINCT document_id, demo_source_id, title, lang, category_id, namespace, status, source_file_name, created_at FROM {demo_documents})"
#: The current revision of each document: its latest result.
CURRENT = f"(SELECT document_id, id AS job_result_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, id) rn FROM {R} r WHERE document_id IS NOT NULL) x WHERE rn = 1)"

# filters
sql("fil_01_tenancy", "demo_documents", f"SELECT document_id, title, category_id FROM {D} d WHERE status = 'active' AND namespace IS NOT NULL")
sql("fil_02_current_revision", "job_chunks job_results", f"SELECT c.id, r.document_id FROM {C} c JOIN {CURRENT} r ON r.job_result_id = c.job_result_id")
sql("fil_03_document_scope", "documents", "SELECT doc_id, source FROM {documents} WHERE source IN ('crawl/ops-wiki', 'upload/manuals', 'sync/drive-a') AND lang IN ('en', 'de') AND doc_id NOT IN (SELECT doc_id FROM {documents} WHERE title IS NULL)")
sql("fil_04_asset_types", "job_chunks", f"SELECT job_result_id, path, max(CASE WHEN chunk_type = 'image' THEN 1 ELSE 0 END) AS has_image, max(CASE WHEN chunk_type = 'table' THEN 1 ELSE 0 END) AS has_table FROM {C} c GROUP BY job_result_id, path HAVING max(CASE WHEN chunk_type IN ('image', 'table') THEN 1 ELSE 0 END) = 1")
sql("fil_05_signal_paths", "job_chunks", f"SELECT id, path FROM {C} c WHERE (lower(coalesce(path, '')) LIKE '%pump%' OR lower(coalesce(path, '')) LIKE '%anhang%') AND NOT lower(coalesce(path, '')) LIKE '%overview%'")
sql("fil_06_subtree", "directory_sections", f"SELECT s.section_id, t.section_id AS target_id FROM {S} s JOIN {S} t ON s.job_result_id = t.job_result_id AND (s.section_path = t.section_path OR substr(s.section_path, 1, length(t.section_path) + 3) = t.section_path || ' / ') WHERE t.section_level = 1")
sql("fil_08_chunk_types", "job_chunks", f"SELECT chunk_type, CASE chunk_type WHEN 'text' THEN 1 WHEN 'image' THEN 2 WHEN 'table' THEN 3 WHEN 'page' THEN 4 ELSE 0 END AS data_type, count(*) AS n FROM {C} c WHERE chunk_type IN ('text', 'image', 'table', 'page') GROUP BY chunk_type")
sql("fil_10_substring", "job_chunks", f"SELECT id FROM {C} c WHERE lower(coalesce(text, '')) LIKE '%inspection report%' OR lower(coalesce(text, '')) LIKE '%检验报告%'")
sql("fil_11_entry_documents", "demo_documents directory_sections", f"""SELECT document_id, 'section' AS found_by FROM {S} s WHERE lower(section_title) LIKE '%appendix%' AND document_id IS NOT NULL GROUP BY document_id
UNION ALL SELECT document_id, 'title' FROM {D} d WHERE lower(title) LIKE '%appendix%' AND document_id NOT IN (SELECT document_id FROM {S} s2 WHERE lower(section_title) LIKE '%appendix%' AND document_id IS NOT NULL)""")  # fmt: skip
sql("fil_12_unknown_scope", "directory_sections", f"SELECT s.section_id, s.parent_section_id FROM {S} s LEFT JOIN {S} p ON p.section_id = s.parent_section_id WHERE s.parent_section_id IS NOT NULL AND trim(s.parent_section_id) <> '' AND p.section_id IS NULL")
sql("fil_13_parked_root_assets", "job_chunks", f"SELECT id FROM {C} c WHERE NOT (coalesce(path, 'Root') = 'Root' AND chunk_type IN ('image', 'table'))")
sql("fil_14_id_set", "job_chunks job_results", f"SELECT id FROM {C} c WHERE job_result_id IN (SELECT id FROM {R} r WHERE delivery_mode IS NOT NULL AND result_size IS NOT NULL)")
sql("fil_15_path_dedup", "job_chunks", f"SELECT id, path FROM (SELECT *, row_number() OVER (PARTITION BY job_result_id, path ORDER BY sort_order, id) rn2 FROM {C} c) x WHERE rn2 = 1 OR path IS NULL")
sql("fil_16_nul_scrub", "documents", "SELECT doc_id, length(replace(text, chr(0), '')) AS n FROM {documents}")

# joins
sql("joi_01_units_documents", "job_chunks job_results documents", f"SELECT DISTINCT c.job_result_id, c.path, d.doc_id FROM {C} c JOIN {R} r ON r.id = c.job_result_id JOIN {{documents}} d ON d.document_id = r.document_id")
sql("joi_03_chunk_provenance", "job_chunks job_results jobs", f"SELECT c.id, r.document_id, j.user_id, coalesce(get_json_object(j.job_metadata, '$.source_file_name'), c.path) AS file_name FROM {C} c LEFT JOIN {R} r ON r.id = c.job_result_id LEFT JOIN {J} j ON j.job_id = r.job_id",
    f"SELECT c.id, r.document_id, j.user_id, coalesce(j.job_metadata->>'$.source_file_name', c.path) AS file_name FROM {C} c LEFT JOIN {R} r ON r.id = c.job_result_id LEFT JOIN {J} j ON j.job_id = r.job_id")
sql("joi_04_page_numbers", "job_chunks", f"SELECT c.id, try_cast(p AS INT) AS page_num FROM {C} c LATERAL VIEW explode(from_json(get_json_object(c.chunk_metadata, '$.page_nums'), 'array<string>')) e AS p WHERE p RLIKE '^[0-9]+$'",
    f"SELECT id, CAST(p AS INT) AS page_num FROM (SELECT c.id, unnest(CAST(chunk_metadata->'$.page_nums' AS VARCHAR[])) AS p FROM {C} c WHERE json_type(chunk_metadata, '$.page_nums') = 'ARRAY') x WHERE regexp_matches(p, '^[0-9]+$')")
sql("joi_05_semi_pages", "job_chunks directory_sections", f"SELECT DISTINCT s.job_result_id, s.section_id FROM {S} s WHERE EXISTS (SELECT 1 FROM {C} c WHERE c.job_result_id = s.job_result_id AND c.sort_order = s.sort_order AND c.chunk_type = 'page')")
sql("joi_06_any_in_scope", "job_results job_chunks", f"SELECT r.id, CASE WHEN EXISTS (SELECT 1 FROM {C} c WHERE c.job_result_id = r.id AND c.chunk_type = 'image') THEN 1 ELSE 0 END AS has_image FROM {R} r")
sql("joi_08_values_pins", "documents", "SELECT d.doc_id, v.tier FROM {documents} d JOIN (VALUES ('en', 1), ('de', 2), ('zh', 3)) AS v(lang, tier) ON d.lang = v.lang")
sql("joi_12_graph_neighbours", "orders lineitem", "SELECT node, other, count(*) AS weight FROM (SELECT l_partkey AS node, l_suppkey AS other FROM {lineitem} UNION ALL SELECT l_suppkey + 1000000, l_partkey FROM {lineitem}) e GROUP BY node, other HAVING count(*) > 1")
sql("joi_13_documents_left_nodes", "documents job_results", f"SELECT d.doc_id, r.id AS node_id FROM {{documents}} d LEFT JOIN {R} r ON r.document_id = d.document_id")
sql("joi_16_log_tenant", "jobs job_results", f"SELECT r.id, j.user_id, j.status FROM {R} r JOIN {J} j ON j.job_id = r.job_id WHERE j.user_id IS NOT NULL")
sql("joi_17_content_duplicates", "documents", "SELECT a.doc_id, a.digest FROM (SELECT doc_id, sha2(text, 256) AS digest FROM {documents} WHERE text IS NOT NULL) a WHERE a.digest IN (SELECT sha2(text, 256) FROM {documents} WHERE text IS NOT NULL GROUP BY sha2(text, 256) HAVING count(*) > 1)",
    "SELECT a.doc_id, a.digest FROM (SELECT doc_id, sha256(text) AS digest FROM {documents} WHERE text IS NOT NULL) a WHERE a.digest IN (SELECT sha256(text) FROM {documents} WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1)")
sql("joi_18_merge_candidates", "events", "SELECT coalesce(a.user_id, b.user_id) AS user_id, greatest(coalesce(a.s, 0), coalesce(b.s, 0)) AS agent_score FROM (SELECT user_id, max(value) AS s FROM {events} WHERE event_type = 'click' GROUP BY user_id) a FULL OUTER JOIN (SELECT user_id, max(value) AS s FROM {events} WHERE event_type = 'purchase' GROUP BY user_id) b ON a.user_id = b.user_id")
sql("joi_22_unique_suffix", "directory_sections", f"SELECT job_result_id, section_title, max(section_path) AS section_path FROM {S} s WHERE section_path IS NOT NULL AND section_title IS NOT NULL AND section_title <> 'Root' AND section_path LIKE '% / %' AND right(section_path, length(section_title) + 3) = ' / ' || section_title GROUP BY job_result_id, section_title HAVING count(*) = 1")

# aggregates
sql("agg_09_types_breakdown", "job_chunks", f"SELECT job_result_id, count(*) AS total, count(*) FILTER (WHERE chunk_type = 'text') AS n_text, count(*) FILTER (WHERE chunk_type = 'page') AS n_page, count(*) FILTER (WHERE chunk_type = 'table') AS n_table, count(*) FILTER (WHERE chunk_type = 'image') AS n_image FROM {C} c GROUP BY job_result_id")
sql("agg_11_conditional_counts", "jobs", f"SELECT get_json_object(job_metadata, '$.parsing_params.model') AS model, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, sum(credits_charged) FILTER (WHERE status = 'done') AS credits FROM {J} j GROUP BY get_json_object(job_metadata, '$.parsing_params.model')",
    f"SELECT job_metadata->>'$.parsing_params.model' AS model, count(*) FILTER (WHERE status = 'done') AS done, count(*) FILTER (WHERE status = 'failed') AS failed, CAST(sum(credits_charged) FILTER (WHERE status = 'done') AS BIGINT) AS credits FROM {J} j GROUP BY 1")
sql("agg_12_percentile", "events", "SELECT event_type, round(percentile(value, 0.95), 6) AS p95, round(percentile(value, 0.5), 6) AS p50 FROM {events} GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS p50 FROM {events} GROUP BY event_type")
sql("agg_13_trailing_window", "events", "SELECT count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM {events} WHERE ts >= (SELECT max(ts) FROM {events}) - INTERVAL '24' HOUR")
sql("agg_14_success_rate", "jobs", f"SELECT user_id, round(coalesce(count(*) FILTER (WHERE status = 'done') / CAST(nullif(count(*) FILTER (WHERE status IN ('done', 'failed')), 0) AS DOUBLE), 0), 6) AS rate, CASE WHEN count(*) < 3 THEN 'few' WHEN count(*) < 20 THEN 'some' ELSE 'many' END AS bucket FROM {J} j GROUP BY user_id")
sql("agg_15_rollup_other", "jobs", f"SELECT CASE WHEN source_type IN ('file', 'url') THEN source_type ELSE 'other' END AS source_type, count(*) AS n, sum(page_count) AS pages FROM {J} j GROUP BY CASE WHEN source_type IN ('file', 'url') THEN source_type ELSE 'other' END",
    f"SELECT CASE WHEN source_type IN ('file', 'url') THEN source_type ELSE 'other' END AS source_type, count(*) AS n, CAST(sum(page_count) AS BIGINT) AS pages FROM {J} j GROUP BY 1")
sql("agg_16_usage_by_period", "jobs", f"SELECT date_trunc('month', created_at) AS period, CAST(sum(credits_charged) AS BIGINT) AS credits, count(*) FILTER (WHERE credits_charged > 0) AS charged FROM {J} j GROUP BY date_trunc('month', created_at)")
sql("agg_17_job_durations", "jobs", f"SELECT status, count(*) AS n, round(avg(unix_timestamp(updated_at) - unix_timestamp(created_at)), 3) AS seconds FROM {J} j GROUP BY status", f"SELECT status, count(*) AS n, round(avg(floor(epoch(updated_at)) - floor(epoch(created_at))), 3) AS seconds FROM {J} j GROUP BY status")
sql("agg_18_net_sum", "lineitem", "SELECT l_returnflag, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END), 2) AS net FROM {lineitem} GROUP BY l_returnflag")
sql("agg_19_hit_counters", "events", "SELECT user_id, event_type, count(*) AS hits, min(ts) AS first_hit, max(ts) AS last_hit FROM {events} GROUP BY user_id, event_type")
sql("agg_20_feature_summary", "job_chunks", f"SELECT chunk_type, round(avg(length(text)), 6) AS mean, round(percentile(length(text), 0.5), 6) AS p50, round(percentile(length(text), 0.9), 6) AS p90, min(length(text)) AS least, max(length(text)) AS most, min_by(id, struct(length(text), id)) AS least_id FROM {C} c WHERE text IS NOT NULL GROUP BY chunk_type",
    f"SELECT chunk_type, round(avg(length(text)), 6) AS mean, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.9), 6) AS p90, min(length(text)) AS least, max(length(text)) AS most, arg_min(id, (length(text), id)) AS least_id FROM {C} c WHERE text IS NOT NULL GROUP BY chunk_type")
sql("agg_21_kind_samples", "job_chunks", f"SELECT chunk_type, id, rank FROM (SELECT chunk_type, id, row_number() OVER (PARTITION BY chunk_type ORDER BY id) AS rank FROM {C} c) x WHERE rank <= 8")
sql("agg_26_child_titles", "directory_sections", f"SELECT parent_section_id, array_join(transform(array_sort(collect_list(struct(sort_order, section_id, coalesce(section_title, '')))), x -> x.col3), ', ') AS titles FROM {S} s WHERE parent_section_id IS NOT NULL GROUP BY parent_section_id",
    f"SELECT parent_section_id, string_agg(coalesce(section_title, ''), ', ' ORDER BY sort_order, section_id) AS titles FROM {S} s WHERE parent_section_id IS NOT NULL GROUP BY parent_section_id")
sql("agg_25_section_text", "job_chunks", f"SELECT job_result_id, path, length(array_join(transform(array_sort(collect_list(struct(sort_order, id, text))), x -> x.text), '\n')) AS n_chars FROM {C} c WHERE text IS NOT NULL AND chunk_type IN ('text', 'page') GROUP BY job_result_id, path",
    f"SELECT job_result_id, path, length(string_agg(text, chr(10) ORDER BY sort_order, id)) AS n_chars FROM {C} c WHERE text IS NOT NULL AND chunk_type IN ('text', 'page') GROUP BY job_result_id, path")
sql("agg_27_evidence_groups", "job_chunks", f"SELECT id, dense_rank() OVER (PARTITION BY job_result_id ORDER BY first_at, path) AS evidence, row_number() OVER (PARTITION BY job_result_id, path ORDER BY sort_order, id) AS member FROM (SELECT id, job_result_id, path, sort_order, min(sort_order) OVER (PARTITION BY job_result_id, path) AS first_at FROM {C} c) x")
sql("agg_29_package_statistics", "job_chunks", f"SELECT job_result_id, count(*) AS total, count(*) FILTER (WHERE chunk_type NOT IN ('image', 'table', 'page') OR chunk_type IS NULL) AS text_chunks, sum(coalesce(length(text), 0)) AS n_chars FROM {C} c GROUP BY job_result_id",
    f"SELECT job_result_id, count(*) AS total, count(*) FILTER (WHERE chunk_type NOT IN ('image', 'table', 'page') OR chunk_type IS NULL) AS text_chunks, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS n_chars FROM {C} c GROUP BY job_result_id")
sql("agg_30_benchmark_stats", "events", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95 FROM {events} GROUP BY event_type",
    "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM {events} GROUP BY event_type")
sql("agg_32_group_usage", "job_results", f"SELECT delivery_mode, count(*) AS n, min(created_at) AS oldest, sum(octet_length(id)) AS bytes FROM {R} r GROUP BY delivery_mode", f"SELECT delivery_mode, count(*) AS n, min(created_at) AS oldest, CAST(sum(strlen(id)) AS BIGINT) AS bytes FROM {R} r GROUP BY delivery_mode")
sql("agg_33_distinct", "job_chunks", f"SELECT DISTINCT job_result_id, path, chunk_type FROM {C} c")
sql("agg_34_scalar_counts", "jobs job_results", f"SELECT (SELECT count(DISTINCT user_id) FROM {J} j) AS users, (SELECT count(*) FROM {J} j) + (SELECT count(*) FROM {R} r) AS rows_total")
sql("agg_35_chunks_by_revision", "job_chunks job_results", f"SELECT r.document_id, c.job_result_id, count(*) AS n FROM {C} c JOIN {R} r ON r.id = c.job_result_id GROUP BY r.document_id, c.job_result_id")

# windows
sql("win_06_first_hit", "job_chunks", f"SELECT job_result_id, path, id FROM (SELECT *, row_number() OVER (PARTITION BY job_result_id, path ORDER BY sort_order, id) AS rn2 FROM {C} c WHERE lower(text) LIKE '%water permit%') x WHERE rn2 = 1")
sql("win_10_turns", "events", """SELECT user_id, turn, count(*) AS n, min(ts) AS started FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM (
SELECT user_id, ts, event_id, CASE WHEN lag(event_type) OVER w IS NULL OR lag(event_type) OVER w <> event_type OR ts >= lag(ts) OVER w + INTERVAL '2' HOUR THEN 1 ELSE 0 END AS fresh FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) a) b GROUP BY user_id, turn""")  # fmt: skip
sql("win_14_islands", "directory_sections", f"SELECT job_result_id, island, count(*) AS n, min(sort_order) AS first_at FROM (SELECT job_result_id, sort_order, sort_order - row_number() OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id) AS island FROM {S} s WHERE section_title IS NOT NULL) x GROUP BY job_result_id, island")
sql("win_15_demoted_runs", "directory_sections", f"""SELECT section_id, CASE WHEN count(*) OVER (PARTITION BY job_result_id, run) >= 2 THEN -1 ELSE section_level END AS level FROM (SELECT section_id, job_result_id, section_level, sum(changed) OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id ROWS UNBOUNDED PRECEDING) AS run FROM (
SELECT section_id, job_result_id, sort_order, section_level, CASE WHEN section_level = lag(section_level) OVER (PARTITION BY job_result_id ORDER BY sort_order, section_id) THEN 0 ELSE 1 END AS changed FROM {S} s) a) b""")  # fmt: skip
sql("win_17_page_owner", "directory_sections", f"SELECT job_result_id, page, section_id FROM (SELECT job_result_id, page, section_id, row_number() OVER (PARTITION BY job_result_id, page ORDER BY sort_order, section_id) AS rn2 FROM {S} s LATERAL VIEW explode(page_nums) e AS page) x WHERE rn2 = 1",
    f"SELECT job_result_id, page, section_id FROM (SELECT job_result_id, page, section_id, row_number() OVER (PARTITION BY job_result_id, page ORDER BY sort_order, section_id) AS rn2 FROM (SELECT *, unnest(page_nums) AS page FROM {S} s) y) x WHERE rn2 = 1")
sql("win_18_renumber", "job_chunks", f"SELECT id, row_number() OVER (PARTITION BY job_result_id ORDER BY path NULLS FIRST, sort_order, id) - 1 AS sort_order FROM {C} c")

# top-k and paging
sql("top_06_pages", "jobs", f"SELECT job_id, created_at FROM {J} j ORDER BY created_at DESC, job_id LIMIT 50 OFFSET 50")
sql("top_07_char_budget", "job_chunks", f"SELECT job_result_id, id FROM (SELECT job_result_id, id, sum(length(text)) OVER (PARTITION BY job_result_id ORDER BY sort_order, id ROWS UNBOUNDED PRECEDING) AS upto FROM {C} c WHERE text IS NOT NULL) x WHERE upto <= 15000")
# sets
sql("set_01_union_distinct", "directory_sections job_chunks", f"SELECT job_result_id, section_title AS name FROM {S} s WHERE section_title IS NOT NULL UNION SELECT job_result_id, path FROM {C} c WHERE path IS NOT NULL")
sql("set_02_union_all_claims", "documents jobs", f"SELECT document_id AS claim, 'document' AS kind FROM {{documents}} UNION ALL SELECT job_id, 'job' FROM {J} j")
sql("set_05_allowed_sections", "directory_sections job_chunks", f"SELECT section_id FROM {S} s WHERE job_result_id IN (SELECT job_result_id FROM {C} c WHERE chunk_type = 'table')")
sql("set_except_intersect", "job_chunks job_results", f"SELECT id AS result_id FROM {R} r EXCEPT SELECT job_result_id FROM {C} c INTERSECT SELECT id FROM {R} r2")

# dates and hashes
sql("dt_02_epoch_difference", "jobs", f"SELECT job_id, unix_timestamp(updated_at) - unix_timestamp(created_at) AS seconds FROM {J} j", f"SELECT job_id, CAST(floor(epoch(updated_at)) - floor(epoch(created_at)) AS BIGINT) AS seconds FROM {J} j")
sql("dt_04_expired_jobs", "jobs", f"SELECT job_id FROM {J} j WHERE status NOT IN ('done', 'failed') AND updated_at < (SELECT max(updated_at) FROM {{jobs}}) - INTERVAL '6' HOUR")
sql("dt_06_period_starts", "jobs", f"SELECT job_id, date_trunc('week', created_at) AS week, date_trunc('month', created_at) AS month FROM {J} j")
sql("ar_09_digests", "documents", "SELECT doc_id, sha2(coalesce(text, ''), 256) AS digest FROM {documents}", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM {documents}")
sql("ar_01_json_paths", "jobs", f"SELECT job_id, get_json_object(job_metadata, '$.namespace') AS namespace, get_json_object(job_metadata, '$.parsing_params.doc_type') AS doc_type FROM {J} j", f"SELECT job_id, job_metadata->>'$.namespace' AS namespace, job_metadata->>'$.parsing_params.doc_type' AS doc_type FROM {J} j")

# state and streams, as batches
sql("stm_05_state_order", "jobs", "SELECT job_id, status, previous, CASE WHEN previous IN ('done', 'failed') THEN 0 ELSE 1 END AS allowed FROM (SELECT job_id, status, lag(status) OVER (PARTITION BY job_id ORDER BY updated_at, status) AS previous FROM (SELECT DISTINCT job_id, status, updated_at FROM {jobs}) a) b")
sql("stm_06_stale_jobs", "jobs", f"SELECT job_id, updated_at FROM {J} j WHERE status NOT IN ('done', 'failed') ORDER BY updated_at, job_id LIMIT 200")
sql("stm_07_latest_claim", "job_chunks", "SELECT id, max(created_at) AS claimed_at, count(*) AS deliveries FROM {job_chunks} GROUP BY id HAVING count(*) > 1")
sql("stm_02_fixed_window_limit", "events", "SELECT user_id, day, n, CASE WHEN n > 5 THEN n - 5 ELSE 0 END AS rejected FROM (SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM {events} GROUP BY user_id, date_trunc('day', ts)) x")
sql("stm_02_sliding_window_limit", "events", "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM {events}) x WHERE n > 1")
