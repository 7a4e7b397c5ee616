"""Plans over trees and graphs, and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring, text
from lodestrata.operators import graphs, trees
from lodestrata.plans.base import CHUNKS, SECTIONS, chunks, chunks_in_place, query, sections, sql_path, sql_tokens, table

#: The three-level tree region / nation / customer.
TREE = "tree AS (SELECT r_name AS scope, r_name AS path, 0.0 AS score FROM region UNION ALL SELECT r_name, r_name || ' / ' || n_name, 0.0 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, r_name || ' / ' || n_name || ' / ' || c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def _tree(spark, sf_dir):
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    rn = n.join(r, n.n_regionkey == r.r_regionkey)
    top = r.select(F.col("r_name").alias("scope"), F.col("r_name").alias("path"), F.lit(0.0).alias("score"))
    mid = rn.select(F.col("r_name").alias("scope"), F.concat_ws(" / ", "r_name", "n_name").alias("path"), F.lit(0.0).alias("score"))
    low = c.join(rn, c.c_nationkey == n.n_nationkey).select(F.col("r_name").alias("scope"), F.concat_ws(" / ", "r_name", "n_name", "c_name").alias("path"), F.col("c_acctbal").alias("score"))
    return top.union(mid).union(low)


@query("joi_09_prefix_join", f"WITH {TREE} SELECT n.path, t.path AS target FROM tree n JOIN tree t ON n.scope = t.scope AND (n.path = t.path OR starts_with(n.path, t.path || ' / '))")
def prefix_join(spark, sf_dir):
    t = _tree(spark, sf_dir)
    return trees.subtree(t, t.select("scope", F.col("path").alias("target")), "scope").select("path", "target")


@query("agg_23_24_pooled_scores", f"WITH {TREE} SELECT t.path AS ancestor, round(max(n.score), 4) AS score FROM tree n JOIN tree t ON n.scope = t.scope AND (n.path = t.path OR starts_with(n.path, t.path || ' / ')) GROUP BY ALL")
def pooled(spark, sf_dir):
    return trees.pool_max(_tree(spark, sf_dir), "scope").select("ancestor", F.round("score", 4).alias("score"))


@query("agg_22_interval_union", f"WITH {TREE} SELECT t.path AS ancestor, min(n.score) AS first, max(n.score) AS last FROM tree n JOIN tree t ON n.scope = t.scope AND (n.path = t.path OR starts_with(n.path, t.path || ' / ')) GROUP BY ALL")
def intervals(spark, sf_dir):
    t = _tree(spark, sf_dir).select("scope", "path", F.col("score").alias("first"), F.col("score").alias("last"))
    return trees.interval_union(t, "scope", "first", "last").select("ancestor", "first", "last")


@query("cor_10_outline", f"WITH {TREE} SELECT n.path, len(string_split(n.path, ' / ')) - 1 AS level FROM tree n WHERE n.scope IN ('ASIA', 'EUROPE') AND len(string_split(n.path, ' / ')) <= 2")
def outline(spark, sf_dir):
    t = _tree(spark, sf_dir)
    targets = t.where("path in ('ASIA', 'EUROPE')").select("scope", F.col("path").alias("target"))
    return trees.outline(t, targets, "scope", 1).select("path", "level")


@query("cor_11_node_filter", f"""WITH {TREE}, m AS (SELECT *, score > 9000 AS hit FROM tree) SELECT path, CASE min(r) WHEN 0 THEN 'hit' WHEN 1 THEN 'ancestor' ELSE 'descendant' END AS role FROM (
SELECT n.path, CASE WHEN n.hit THEN 0 ELSE 2 END AS r FROM m n JOIN m t ON t.hit AND n.scope = t.scope AND (n.path = t.path OR starts_with(n.path, t.path || ' / ')) UNION ALL
SELECT n.path, 1 FROM m n JOIN m t ON t.hit AND n.scope = t.scope AND (n.path = t.path OR starts_with(t.path, n.path || ' / '))) GROUP BY path""")  # fmt: skip
def node_filter(spark, sf_dir):
    return trees.node_filter(_tree(spark, sf_dir), "scope", F.col("score") > 9000).select("path", "role")


@query("fil_09_node_predicates", f"SELECT id FROM {CHUNKS} WHERE (contains(lower(path), 'valve') OR contains(lower(path), 'pump')) AND regexp_matches(coalesce(text, ''), '(?i)section [0-9]+')")
def node_predicates(spark, sf_dir):
    any_of = F.exists(F.array(F.lit("valve"), F.lit("pump")), lambda t: F.contains(F.lower("path"), t))
    return chunks(spark, sf_dir).where(any_of & F.coalesce(F.col("text"), F.lit("")).rlike("(?i)section [0-9]+")).select("id")


@query("joi_19_containing_section", f"""WITH s AS (SELECT job_result_id, section_id, list_min(page_nums) AS s_start, list_max(page_nums) AS s_end, coalesce(section_level, 0) AS s_level FROM {SECTIONS} WHERE len(page_nums) > 0)
SELECT span_id, section_id FROM (SELECT a.section_id AS span_id, b.section_id, row_number() OVER (PARTITION BY a.section_id ORDER BY b.s_start DESC, b.s_level DESC, b.section_id DESC) AS r FROM s a JOIN s b ON a.job_result_id = b.job_result_id AND b.s_start <= a.s_start AND b.s_end >= a.s_end AND a.section_id <> b.section_id) WHERE r = 1""")  # fmt: skip
def containing(spark, sf_dir):
    s = sections(spark, sf_dir).where("size(page_nums) > 0").select("job_result_id", "section_id", F.array_min("page_nums").alias("s_start"), F.array_max("page_nums").alias("s_end"), F.coalesce("section_level", F.lit(0)).alias("s_level"))
    spans = s.select("job_result_id", F.col("section_id").alias("span_id"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    inside = spans.join(s, "job_result_id").where("s_start <= start and s_end >= end and span_id <> section_id")
    return inside.groupBy("span_id").agg(F.max(F.struct("s_start", "s_level", "section_id")).alias("b")).select("span_id", "b.section_id")


@query("win_12_sibling_ranges", f"""WITH n AS (SELECT job_result_id AS "group", section_id AS node_id, sort_order AS ord, list_min(page_nums) AS page FROM {SECTIONS}),
s AS (SELECT *, coalesce(max(page) OVER (PARTITION BY "group" ORDER BY ord, node_id ROWS UNBOUNDED PRECEDING), 1) AS "start", first_value(page IGNORE NULLS) OVER (PARTITION BY "group" ORDER BY ord, node_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM n)
SELECT node_id, "start", greatest("start", coalesce(nxt, 9999)) AS "end" FROM s""")  # fmt: skip
def sibling_ranges(spark, sf_dir):
    n = sections(spark, sf_dir).select(F.col("job_result_id").alias("group"), F.col("section_id").alias("node_id"), F.col("sort_order").alias("ord"), F.array_min("page_nums").alias("page"), F.lit(9999).alias("last"))
    return trees.sibling_ranges(n, "last").select("node_id", "start", "end")


@query("doc_03_heading_parents", f"""WITH s AS (SELECT job_result_id, section_id, sort_order, greatest(1, least(6, coalesce(section_level, 0) + 1)) AS lvl FROM {SECTIONS}), d AS (SELECT job_result_id, sort_order, min(lvl) AS lvl FROM s GROUP BY ALL)
SELECT a.job_result_id, a.sort_order, max(b.sort_order) AS parent_order FROM d a LEFT JOIN d b ON a.job_result_id = b.job_result_id AND b.sort_order < a.sort_order AND b.lvl < a.lvl GROUP BY a.job_result_id, a.sort_order""")  # fmt: skip
def heading_parents(spark, sf_dir):
    s = sections(spark, sf_dir).groupBy("job_result_id", "sort_order").agg(F.min(F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("section_level", F.lit(0)) + 1))).alias("lvl"))
    return trees.level_parents(s, "job_result_id", "sort_order", "lvl").select("job_result_id", "sort_order", "parent_order")


@query("agg_07_keywords", f"""WITH t AS (SELECT row_number() OVER () AS t, source, text FROM documents WHERE source IS NOT NULL), w AS (SELECT t, source, unnest({sql_tokens('text')}) AS keyword FROM t), c AS (SELECT source, t, keyword, count(*) AS n FROM w WHERE NOT regexp_matches(keyword, '^[0-9]+$') GROUP BY ALL),
s AS (SELECT source, keyword, round(tf * (ln((SELECT count(*) FROM t)::DOUBLE / df) + 1), 6) AS score FROM (SELECT source, keyword, sum(n) AS tf FROM c GROUP BY ALL) JOIN (SELECT keyword, count(*) AS df FROM c GROUP BY ALL) USING (keyword))
SELECT source, keyword, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, keyword) AS rank FROM s) WHERE rank <= 10""")  # fmt: skip
def keywords(spark, sf_dir):
    return graphs.keywords(table(spark, sf_dir, "documents").where("source is not null").select("source", "text"), "source", "text").select("source", "keyword", "rank")


@query("set_04_cor_19_document_graph", f"""WITH s AS (SELECT DISTINCT job_result_id AS k, keyword AS i FROM (SELECT job_result_id, unnest(from_json(chunk_metadata->'$.keywords', '["VARCHAR"]')) AS keyword FROM {CHUNKS} WHERE json_type(chunk_metadata, '$.keywords') = 'ARRAY')), z AS (SELECT k, sum(length(i)) AS len FROM s GROUP BY k)
SELECT a, b, shared, round(len / least(la, lb), 6) AS score FROM (SELECT x.k AS a, y.k AS b, count(*) AS shared, sum(length(x.i)) AS len FROM s x JOIN s y ON x.i = y.i AND x.k < y.k GROUP BY ALL) JOIN (SELECT k AS a, len AS la FROM z) USING (a) JOIN (SELECT k AS b, len AS lb FROM z) USING (b) WHERE shared >= 2 AND round(len / least(la, lb), 6) >= 0.8""")  # fmt: skip
def document_graph(spark, sf_dir):
    s = chunks_in_place(spark, sf_dir).select("job_result_id", F.explode(F.from_json(F.get_json_object("chunk_metadata", "$.keywords"), "array<string>")).alias("keyword"))
    return graphs.overlaps(s, "job_result_id", "keyword", 0.8, 2)


@query("tab_08_components", """WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b FROM lineitem WHERE l_quantity > 49), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, c) AS (SELECT a, a FROM both_ways UNION SELECT b.b, r.c FROM r JOIN both_ways b ON b.a = r.node WHERE r.c < b.b) SELECT node, min(c) AS component FROM r GROUP BY node""")  # fmt: skip
def components(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"))
    return graphs.components(e)


@query("tab_08_all_components")
def all_components(spark, sf_dir):
    """Over every edge of lineitem; without SQL, as the recursive statement above is affordable on few edges only."""
    return graphs.components(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")))


@query("set_03_set_operations", "SELECT a.o_custkey, list_sort(list_intersect(a.p, b.p)) AS shared, list_sort(list_distinct(list_concat(a.p, b.p))) AS either FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)")
def set_operations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias(s))
    return side("F").join(side("O"), "o_custkey").select("o_custkey", F.sort_array(F.array_intersect("F", "O")).alias("shared"), F.sort_array(F.array_union("F", "O")).alias("either"))


# scalar functions over whole tables
@query("str_01_tokens", f"SELECT doc_id, len({sql_tokens('text')}) AS n, len(list_distinct({sql_tokens('text')})) AS n_distinct FROM documents")
def str_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n"), F.size(text.distinct_tokens(F.col("text"))).alias("n_distinct"))


@query("str_03_unit_count", "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[一-鿿]|[A-Za-z]+|[0-9]+')) AS n FROM documents")
def str_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.unit_count(F.col("text")).alias("n"))


@query("str_07_paths", f"SELECT id, {sql_path('path')} AS path, len(string_split({sql_path('path')}, ' / ')) AS depth FROM {CHUNKS}")
def str_paths(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", text.normal_path(F.col("path")).alias("path")).withColumn("depth", F.size(F.split("path", " / ")))


@query("str_08_slash_escape", f"SELECT section_id, replace(replace(section_title, '∕', '∕∕'), '/', '∕') AS segment, section_title AS title FROM {SECTIONS}")
def str_escape(spark, sf_dir):
    s = sections(spark, sf_dir).select("section_id", text.escape_segment(F.col("section_title")).alias("segment"))
    return s.withColumn("title", text.unescape_segment(F.col("segment")))


@query("str_14_keyword_form", "SELECT DISTINCT CASE WHEN length(k) > 1 AND NOT regexp_matches(k, '^[0-9]+[.,%]*$') THEN k END AS keyword FROM (SELECT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS k FROM part)")
def str_keyword(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.normal_keyword(F.col("p_name")).alias("keyword")).distinct()


@query("str_21_main_script", "SELECT doc_id, CASE WHEN z = 0 AND e = 0 THEN 'other' WHEN z >= e THEN 'zh' ELSE 'en' END AS script FROM (SELECT doc_id, length(regexp_replace(text, '[^一-鿿]', '', 'g')) AS z, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS e FROM documents WHERE text IS NOT NULL)")
def str_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.main_script(F.col("text")).alias("script"))


@query("str_23_masked_key", "SELECT DISTINCT CASE WHEN length(user_id) > 8 THEN left(user_id, 4) || '...' || right(user_id, 4) ELSE '***' END AS masked FROM jobs")
def str_mask(spark, sf_dir):
    return table(spark, sf_dir, "jobs").select(text.mask_key(F.col("user_id")).alias("masked")).distinct()


@query("str_27_document_type", f"SELECT job_id, CASE WHEN e IN ('pdf', 'docx', 'pptx') THEN e WHEN e IN ('md', 'txt', 'html') THEN 'text' WHEN e IN ('xlsx', 'csv') THEN 'sheet' ELSE 'other' END AS kind FROM (SELECT DISTINCT job_id, lower(regexp_extract(coalesce(job_metadata->>'$.source_file_name', ''), '\\.([A-Za-z0-9]+)$', 1)) AS e FROM jobs)")
def str_type(spark, sf_dir):
    e = F.lower(F.regexp_extract(F.coalesce(F.get_json_object("job_metadata", "$.source_file_name"), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(e.isin("pdf", "docx", "pptx"), e).when(e.isin("md", "txt", "html"), "text").when(e.isin("xlsx", "csv"), "sheet").otherwise("other")
    return table(spark, sf_dir, "jobs").select("job_id", kind.alias("kind")).distinct()


@query("str_02_meaningful", "SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) >= 2 AND regexp_matches(x, '[a-z0-9]')) AS words FROM part")
def str_meaningful(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.filter(F.split(F.lower("p_name"), " "), lambda x: (F.length(x) >= 2) & x.rlike("[a-z0-9]")).alias("words"))


@query("ma_05_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS y FROM customer")
def ma_sigmoid(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(scoring.sigmoid(F.col("c_acctbal") / 1000), 6).alias("y"))


@query("dt_01_decay", "SELECT event_id, round(exp(-0.693 * (epoch(TIMESTAMP '2024-02-01') - epoch(ts)) / 86400 / 30), 6) AS weight FROM events")
def dt_decay(spark, sf_dir):
    days = (F.unix_timestamp(F.lit("2024-02-01 00:00:00")).cast("double") - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) / 86400
    return table(spark, sf_dir, "events").select("event_id", F.round(scoring.decay(days), 6).alias("weight"))


@query("ar_05_zip_arrays", f"SELECT section_id, unnest(page_nums) AS page, unnest(range(1, len(page_nums) + 1)) AS pos FROM {SECTIONS} WHERE len(page_nums) > 0")
def ar_zip(spark, sf_dir):
    s = sections(spark, sf_dir).where("size(page_nums) > 0")
    z = F.explode(F.arrays_zip(F.col("page_nums").alias("page"), F.sequence(F.lit(1), F.size("page_nums")).alias("pos")))
    return s.select("section_id", z.alias("z")).select("section_id", F.col("z.page").alias("page"), F.col("z.pos").cast("bigint").alias("pos"))


@query("top_02_four_keys", "SELECT event_id, r FROM (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, user_id, ts, event_id) AS r FROM events) WHERE r <= 100")
def four_keys(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "user_id", "ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("r")).where("r <= 100")
