"""Plans over pages, headings, tables and paths of parsed documents; each SQL is written on its own, by other means than the operator."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import pages, sheets, structure, tools, trees, vector
from lodestrata.plans.base import CHUNKS, SECTIONS, chunks, query, sections, sql_path, table
from lodestrata.plans.structures import LINES, _lines

N = f"n AS (SELECT DISTINCT job_result_id AS scope, {sql_path('section_path')} AS path, section_title AS title, sort_order AS ord, page_nums AS pages, list_min(page_nums) AS printed FROM {SECTIONS} WHERE section_path IS NOT NULL AND job_result_id IS NOT NULL)"
LEAF = "leaf AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.scope = n.scope AND starts_with(c.path, n.path || ' / ')))"
COUNTS = "counts AS (SELECT r.id AS scope, max(page_count) AS page_count FROM job_results r JOIN jobs j USING (job_id) GROUP BY ALL)"
OFFSET = 3


def _nodes(spark, sf_dir):
    s = sections(spark, sf_dir).where("section_path is not null and job_result_id is not null")
    return s.select(F.col("job_result_id").alias("scope"), text.normal_path(F.col("section_path")).alias("path"), F.col("section_title").alias("title"), F.col("sort_order").alias("ord"), F.col("page_nums").alias("pages"), F.array_min("page_nums").alias("printed")).distinct()


def _counts(spark, sf_dir):
    return table(spark, sf_dir, "job_results").join(table(spark, sf_dir, "jobs").select("job_id", "page_count"), "job_id").groupBy(F.col("id").alias("scope")).agg(F.max("page_count").alias("page_count"))


@query("doc_06_anchored_pages", f"WITH {N}, {LEAF}, {COUNTS} SELECT DISTINCT scope, path, printed + {OFFSET} AS page FROM leaf LEFT JOIN counts USING (scope) WHERE printed + {OFFSET} >= 1 AND (page_count IS NULL OR printed + {OFFSET} <= page_count)")
def anchored(spark, sf_dir):
    return pages.anchored(_nodes(spark, sf_dir), OFFSET, _counts(spark, sf_dir)).distinct()


@query("doc_08_pruned_nodes", f"""WITH {N}, {LEAF}, {COUNTS}, stay AS (SELECT scope, path FROM leaf LEFT JOIN counts USING (scope) WHERE printed IS NULL OR printed + {OFFSET} >= 1 AND (page_count IS NULL OR printed + {OFFSET} <= page_count))
SELECT DISTINCT scope, path FROM n WHERE EXISTS (SELECT 1 FROM stay s WHERE s.scope = n.scope AND (s.path = n.path OR starts_with(s.path, n.path || ' / ')))""")  # fmt: skip
def pruned(spark, sf_dir):
    return pages.pruned(_nodes(spark, sf_dir), OFFSET, _counts(spark, sf_dir))


@query("doc_09_own_spans", f"""WITH {N}, {LEAF}, s AS (SELECT scope, path, min(printed) AS start FROM n GROUP BY ALL HAVING min(printed) IS NOT NULL)
SELECT s.scope, s.path, s.start, min(l.printed) AS "end" FROM s JOIN leaf l ON l.scope = s.scope AND starts_with(l.path, s.path || ' / ') AND l.printed IS NOT NULL GROUP BY ALL HAVING s.start < min(l.printed)""")  # fmt: skip
def own_spans(spark, sf_dir):
    """The pages of a section before its first leaf."""
    return pages.own_spans(_nodes(spark, sf_dir).withColumnRenamed("printed", "start"))


@query("doc_10_joi_19_open_sections", f"""WITH {N}, cover AS (SELECT n.scope, n.path, min(d.printed) AS a, max(list_max(d.pages)) AS b FROM n JOIN n d ON d.scope = n.scope AND (d.path = n.path OR starts_with(d.path, n.path || ' / ')) WHERE len(d.pages) > 0 GROUP BY ALL),
p AS (SELECT id, job_result_id AS scope, min(p::INT) AS a, max(p::INT) AS b FROM (SELECT id, job_result_id, unnest(CAST(chunk_metadata->'$.page_nums' AS VARCHAR[])) AS p FROM {CHUNKS} WHERE chunk_type = 'page' AND json_type(chunk_metadata, '$.page_nums') = 'ARRAY') WHERE regexp_matches(p, '^[0-9]+$') GROUP BY ALL)
SELECT id, path FROM (SELECT p.id, c.path, row_number() OVER (PARTITION BY p.id ORDER BY c.a DESC, len(string_split(c.path, ' / ')) DESC, c.path DESC) AS r FROM p JOIN cover c ON c.scope = p.scope AND c.a <= p.a AND p.b <= c.b) WHERE r = 1""")  # fmt: skip
def open_sections(spark, sf_dir):
    """The innermost section open on each page chunk's pages; a section covers what those below it do."""
    n = _nodes(spark, sf_dir).where(F.size("pages") > 0).select("scope", "path", F.col("printed").alias("a"), F.array_max("pages").alias("b"))
    cover = trees.interval_union(n, "scope", "a", "b").select("scope", F.col("ancestor").alias("section_id"), F.col("a").alias("s_start"), F.col("b").alias("s_end"), F.size(F.split("ancestor", text.SEPARATOR)).alias("s_level"))
    known = _nodes(spark, sf_dir).select("scope", F.col("path").alias("section_id")).distinct()
    return pages.containing(_chunk_pages(spark, sf_dir), cover.join(known, ["scope", "section_id"], "left_semi")).select(F.col("span_id").alias("id"), F.col("section_id").alias("path"))


def _page_numbers():
    """Page numbers of a chunk's metadata, what is no number left out, each once."""
    raw = F.from_json(F.get_json_object("chunk_metadata", "$.page_nums"), "array<string>")
    return F.array_distinct(F.filter(F.transform(raw, lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("int"))), lambda x: x.isNotNull()))


def _chunk_pages(spark, sf_dir):
    c = chunks(spark, sf_dir).where("chunk_type = 'page' and job_result_id is not null").withColumn("p", _page_numbers()).where(F.size("p") > 0)
    return c.select(F.col("job_result_id").alias("scope"), F.col("id").alias("span_id"), F.array_min("p").alias("start"), F.array_max("p").alias("end"))


@query("doc_13_page_bodies", f"""WITH {N}, pg AS (SELECT DISTINCT scope, path, unnest(pages) AS page FROM n), o AS (SELECT scope, path, min(ord) AS ord FROM n GROUP BY ALL), body AS (SELECT * FROM pg a WHERE NOT EXISTS (SELECT 1 FROM pg b WHERE b.scope = a.scope AND b.page = a.page AND starts_with(b.path, a.path || ' / '))),
f AS (SELECT *, min(page) OVER (PARTITION BY scope, path) AS first FROM body JOIN o USING (scope, path)), w AS (SELECT scope, path, page, first_value(path) OVER (PARTITION BY scope, page ORDER BY first, ord NULLS FIRST, path) AS owner FROM f)
SELECT scope, path, page, CASE WHEN owner = path THEN 'own' ELSE '[SAME-AS ' || owner || ' p' || page || ']' END AS body FROM w""")  # fmt: skip
def page_bodies(spark, sf_dir):
    b = pages.page_bodies(_nodes(spark, sf_dir))
    return b.select("scope", "path", "page", F.when(F.col("owner") == F.col("path"), "own").otherwise(F.concat(F.lit("[SAME-AS "), "owner", F.lit(" p"), "page", F.lit("]"))).alias("body"))


@query("doc_23_page_plan", f"""WITH {COUNTS}, e AS (SELECT scope, unnest(range(1, page_count + 1)) AS page FROM counts WHERE page_count >= 1), b AS (SELECT DISTINCT job_result_id AS scope, unnest(CAST(chunk_metadata->'$.page_nums' AS VARCHAR[])) AS page FROM {CHUNKS}
 WHERE chunk_type = 'page' AND json_type(chunk_metadata, '$.page_nums') = 'ARRAY' AND NOT coalesce(regexp_matches(text, '[\\p{{L}}\\p{{N}}]'), false))
SELECT scope, page, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.scope = e.scope AND b.page = e.page::VARCHAR) THEN 'skip_tagging' ELSE 'vlm_lite' END AS plan FROM e""")  # fmt: skip
def page_plan(spark, sf_dir):
    """Pages whose text has neither letters nor digits are blank."""
    c = chunks(spark, sf_dir).where("chunk_type = 'page' and job_result_id is not null").where(~F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False)))
    return pages.page_plan(_counts(spark, sf_dir), c.select(F.col("job_result_id").alias("scope"), F.explode(_page_numbers()).alias("page")))


@query("win_16_without_running_lines", f"""WITH h AS (SELECT DISTINCT job_result_id AS scope, section_title AS mark, unnest(page_nums) AS page FROM {SECTIONS} WHERE job_result_id IS NOT NULL AND section_title IS NOT NULL), s AS (SELECT scope, page, string_agg(mark, chr(1) ORDER BY mark) AS m FROM h GROUP BY ALL)
SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.scope = b.scope AND a.m = b.m AND abs(a.page - b.page) = 1 WHERE a.scope = h.scope AND a.page = h.page)""")  # fmt: skip
def without_running_lines(spark, sf_dir):
    s = sections(spark, sf_dir).where("job_result_id is not null and section_title is not null")
    return pages.without_running_lines(s.select(F.col("job_result_id").alias("scope"), F.col("section_title").alias("mark"), F.explode("page_nums").alias("page")).distinct())


@query("doc_16_box_clusters", f"""WITH RECURSIVE b AS (SELECT section_id AS id, job_result_id AS scope, list_min(page_nums) * 10 AS x0, list_max(page_nums) * 10 AS x1, sort_order * 10 AS y0, sort_order * 10 + coalesce(section_level, 1) AS y1 FROM {SECTIONS} WHERE len(page_nums) > 0 AND sort_order IS NOT NULL AND section_id IS NOT NULL AND job_result_id IS NOT NULL AND coalesce(section_level, 1) BETWEEN 0 AND 50),
e AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON p.scope = q.scope AND p.id <> q.id AND p.x0 - 6 <= q.x1 AND q.x0 - 6 <= p.x1 AND p.y0 - 6 <= q.y1 AND q.y0 - 6 <= p.y1), r(node, other) AS (SELECT id, id FROM b UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node, min(other) AS component FROM r GROUP BY node""")  # fmt: skip
def box_clusters(spark, sf_dir):
    """Sections as boxes of pages and places."""
    s = sections(spark, sf_dir).where("size(page_nums) > 0 and sort_order is not null and section_id is not null and job_result_id is not null and coalesce(section_level, 1) between 0 and 50")
    y = F.col("sort_order") * 10
    return pages.cluster_boxes(s.select(F.col("section_id").alias("id"), F.col("job_result_id").alias("scope"), (F.array_min("page_nums") * 10).alias("x0"), (F.array_max("page_nums") * 10).alias("x1"), y.alias("y0"), (y + F.coalesce("section_level", F.lit(1))).alias("y1")), 6)


@query("win_08_unique_paths", f"""WITH c AS (SELECT job_result_id AS scope, row_number() OVER (PARTITION BY job_result_id ORDER BY sort_order NULLS FIRST, id) AS ord, path, id FROM {CHUNKS} WHERE path IS NOT NULL AND job_result_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY scope, path ORDER BY ord) AS k, count(*) OVER (PARTITION BY scope, path) AS n, min(ord) OVER (PARTITION BY scope, path) AS born FROM c), z AS (SELECT *, path || CASE WHEN k > 1 THEN '_' || k ELSE '' END AS own FROM o),
m AS (SELECT a.id, u.own || substr(a.own, length(u.path) + 1) AS moved, row_number() OVER (PARTITION BY a.id ORDER BY u.born, u.path, u.ord DESC) AS r FROM z a JOIN z u ON u.scope = a.scope AND u.n > 1 AND u.ord < a.ord AND starts_with(a.path, u.path || '/'))
SELECT z.id, coalesce(moved, own) AS unique_path FROM z LEFT JOIN m ON m.id = z.id AND m.r = 1""")  # fmt: skip
def unique_paths(spark, sf_dir):
    c = chunks(spark, sf_dir).where("path is not null and job_result_id is not null").withColumn("ord", F.row_number().over(Window.partitionBy("job_result_id").orderBy("sort_order", "id")))
    rows = c.select(F.col("job_result_id").alias("scope"), "ord", "path")
    return pages.unique_paths(rows).join(c.select(F.col("job_result_id").alias("scope"), "ord", "id"), ["scope", "ord"]).select("id", "unique_path")


GREP = ["tender file", "spare rotor", "soil survey", "annual shutdown"]


def _hits(spark, sf_dir):
    first = tools.grep(chunks(spark, sf_dir), GREP)
    place = F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(GREP) for x in (t, k)]), F.col("term"))
    return first.select("term", place.alias("place"), F.col("job_result_id").alias("doc"), F.col("id").alias("ord"))


GREP_SQL = f"""WITH t AS (SELECT unnest({GREP}) AS term, unnest(range({len(GREP)})) AS place), h AS (SELECT term, place, job_result_id AS doc, arg_min(id, (coalesce(sort_order, -1), id)) AS ord FROM {CHUNKS} JOIN t ON contains(lower(text), term) GROUP BY ALL),
a AS (SELECT *, row_number() OVER (ORDER BY n, place, doc NULLS FIRST, ord) AS pos, row_number() OVER (PARTITION BY term ORDER BY doc NULLS FIRST, ord) AS r FROM (SELECT *, count(*) OVER (PARTITION BY term) AS n FROM h))"""


@query("win_07_cor_09_allocated_hits", GREP_SQL + " SELECT term, doc, ord, r FROM a WHERE pos <= 30")
def allocated_hits(spark, sf_dir):
    """Thirty rows over four terms, the rarest term first."""
    return pages.allocated(_hits(spark, sf_dir), 30)[0]


@query("win_07_folded_hits", GREP_SQL + " SELECT term, doc, count(*) AS folded FROM a WHERE pos > 30 GROUP BY ALL")
def folded_hits(spark, sf_dir):
    return pages.allocated(_hits(spark, sf_dir), 30)[1]


@query("doc_01_heading_candidates", f"""SELECT doc_id, line_no FROM {LINES} WHERE length(trim(line)) BETWEEN 1 AND 60 AND NOT regexp_matches(trim(line), '[.!?;。！？；]$|^[^\\p{{L}}\\p{{N}}]*$|^https?://|^\\||^\\d+$|\\t\\S+\\t')
AND regexp_matches(trim(line), '{"|".join(p for p in structure.HEADING_SIGNS)}')""")  # fmt: skip
def heading_candidates(spark, sf_dir):
    """Every line with any sign of a heading and nothing against it."""
    return _lines(spark, sf_dir).where(structure.heading_score(F.col("line")) > 0).select("doc_id", "line_no")


TABLES = f"(SELECT id, job_result_id, path, sort_order, string_split(text, '<tr')[2:] AS r FROM {CHUNKS} WHERE chunk_type = 'table' AND text LIKE '%<table%')"
AREA = "list_sum(list_transform(regexp_extract_all(x, '<t[dh][^>]*>'), lambda t: coalesce(try_cast(regexp_extract(t, 'rowspan=\"(\\d+)\"', 1) AS INT), 1) * coalesce(try_cast(regexp_extract(t, 'colspan=\"(\\d+)\"', 1) AS INT), 1)))"


def _tables(spark, sf_dir):
    return chunks(spark, sf_dir).where("chunk_type = 'table' and text like '%<table%'")


@query("tab_01_grid_size", f"SELECT id, len(r) AS n_rows FROM {TABLES}")
def grid_size(spark, sf_dir):
    return _tables(spark, sf_dir).select("id", F.size(sheets.html_grid(F.col("text"))).cast("bigint").alias("n_rows"))


@query("tab_02_grid_cells", f"SELECT id, (len(r) * list_max(list_transform(r, lambda x: {AREA})))::BIGINT AS n_cells FROM {TABLES}")
def grid_cells(spark, sf_dir):
    """Cells of the whole rectangle: spans count with all they cover, short rows are filled up."""
    cells = _tables(spark, sf_dir).select("id", F.explode(sheets.html_grid(F.col("text"))).alias("row"))
    return cells.groupBy("id").agg(F.sum(F.size("row")).alias("n_cells"))


@query("tab_03_rendered_grids", f"SELECT id, (len(r) * list_max(list_transform(r, lambda x: {AREA})))::BIGINT AS n_cells FROM {TABLES}")
def rendered_grids(spark, sf_dir):
    """Grids rendered again have the cells of the rectangles they were read from."""
    html = sheets.grid_html(F.col("grid"))
    return _tables(spark, sf_dir).withColumn("grid", sheets.html_grid(F.col("text"))).select("id", F.size(F.regexp_extract_all(html, F.lit("(<t[dh]>)"), F.lit(1))).cast("bigint").alias("n_cells"))


@query("tab_10_flat_headers", f"SELECT id, list_transform(regexp_extract_all(r[1], '<t[dh][^>]*>([^<]*)<', 1), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS names FROM {TABLES} WHERE NOT regexp_matches(r[1], '&[a-z]+;|<br')")
def flat_headers(spark, sf_dir):
    t = _tables(spark, sf_dir).withColumn("head", F.element_at(F.split("text", "<tr"), 2)).where(~F.col("head").rlike("&[a-z]+;|<br"))
    return t.select("id", sheets.html_grid(F.col("text")).alias("grid")).select("id", sheets.flat_headers(F.col("grid"), 1).alias("names"))


@query("doc_15_merged_tables", f"""WITH t AS (SELECT job_result_id AS scope, path, sort_order AS ord, id, len(regexp_extract_all(r[1], '<t[dh]')) AS width FROM {TABLES} WHERE path IS NOT NULL AND sort_order IS NOT NULL AND job_result_id IS NOT NULL),
s AS (SELECT *, CASE WHEN ord = lag(ord) OVER w + 1 AND width = lag(width) OVER w THEN NULL ELSE id END AS opens FROM t WINDOW w AS (PARTITION BY scope, path ORDER BY ord, id))
SELECT id, last_value(opens IGNORE NULLS) OVER (PARTITION BY scope, path ORDER BY ord, id ROWS UNBOUNDED PRECEDING) AS table_id FROM s""")  # fmt: skip
def merged_tables(spark, sf_dir):
    """Tables that go on in the next chunk; the judge is the width of the first row."""
    width = F.size(F.regexp_extract_all(F.element_at(F.split("text", "<tr"), 2), F.lit("(<t[dh])"), F.lit(1)))
    t = _tables(spark, sf_dir).where("path is not null and sort_order is not null and job_result_id is not null")
    return pages.merged_tables(t.select(F.col("job_result_id").alias("scope"), "path", F.col("sort_order").alias("ord"), "id", width.alias("width")))


@query("doc_22_monotone_pages", f"""WITH {N}, l AS (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY ord NULLS FIRST, path, title NULLS FIRST) AS ord, printed FROM n)
SELECT a.scope, a.ord, greatest(coalesce(max(b.printed), 1), 1) AS page FROM l a JOIN l b ON a.scope = b.scope AND b.ord <= a.ord GROUP BY ALL""")  # fmt: skip
def monotone_pages(spark, sf_dir):
    n = _nodes(spark, sf_dir).withColumn("ord", F.row_number().over(Window.partitionBy("scope").orderBy("ord", "path", "title", "pages")))
    return pages.monotone(n.select("scope", "ord", F.col("printed").alias("page")))


@query("doc_19_str_19_section_summaries", f"""WITH {N}, x AS (SELECT scope, path, string_agg(title, ', ' ORDER BY ord NULLS FIRST, own, title NULLS FIRST) AS titles FROM (SELECT DISTINCT scope, array_to_string(string_split(path, ' / ')[:-2], ' / ') AS path, ord, path AS own, title FROM n WHERE contains(path, ' / ')) GROUP BY ALL),
b AS (SELECT job_result_id AS scope, {sql_path('path')} AS path, string_agg(text, ' ' ORDER BY sort_order NULLS FIRST, id) AS own FROM {CHUNKS} WHERE chunk_type = 'image' AND text IS NOT NULL GROUP BY ALL),
y AS (SELECT DISTINCT n.scope, n.path, trim(CASE WHEN contains(n.path, ' / ') THEN 'This section covers: ' ELSE 'This document includes: ' END || concat_ws(' ', nullif(trim(b.own), ''), nullif(x.titles, ''))) AS s FROM n LEFT JOIN x USING (scope, path) LEFT JOIN b USING (scope, path)),
z AS (SELECT *, string_split(trim(regexp_replace(s, '\\s+', ' ', 'g')), ' ') AS w FROM y)
SELECT scope, path, CASE WHEN len(w) <= 200 THEN array_to_string(w, ' ') ELSE array_to_string(w[:100], ' ') || ' … ' || array_to_string(w[-100:], ' ') END AS summary FROM z""")  # fmt: skip
def section_summaries(spark, sf_dir):
    """Captions of the images right in a section stand for its own text."""
    c = chunks(spark, sf_dir).where("chunk_type = 'image' and text is not null and job_result_id is not null")
    own = c.select(F.col("job_result_id").alias("scope"), text.normal_path(F.col("path")).alias("path"), F.struct("sort_order", "id", "text").alias("x")).groupBy("scope", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), " ").alias("self_text"))
    return pages.summaries(_nodes(spark, sf_dir), own)


@query("top_03_joi_07_top_08_pages", """WITH s AS (SELECT q.label, p.vec_id, round(coalesce(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 0), 9) AS similarity, q.vec_id AS query_id FROM embeddings q CROSS JOIN embeddings p WHERE q.vec_id % 50 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 3) SELECT label, vec_id AS page_id, max(similarity) AS similarity FROM t GROUP BY ALL""")  # fmt: skip
def keyword_pages(spark, sf_dir):
    """The three nearest pages of each query vector, put together by the queries' label."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    best = vector.top_pages(asked, e.select(F.col("vec_id").alias("page_id"), F.col("embedding").alias("vector")), 3)
    return best.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id").groupBy("label", "page_id").agg(F.max("similarity").alias("similarity"))


@query("agg_28_token_costs", """SELECT l_returnflag AS model, l_linestatus AS task, round(sum(l_quantity::BIGINT) / 1e6 * rate_in + sum(l_linenumber) / 1e6 * rate_out, 9) AS cost FROM lineitem JOIN (VALUES ('A', 1.5::DOUBLE, 6::DOUBLE), ('N', 2.5, 10)) AS v(m, rate_in, rate_out) ON l_returnflag = m GROUP BY l_returnflag, l_linestatus, rate_in, rate_out""")
def token_costs(spark, sf_dir):
    """Costs by model and task; the third flag has no price and is left out."""
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"), F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").cast("bigint").alias("output_tokens"), F.lit(0).alias("audio_seconds"))
    prices = spark.createDataFrame([("A", 1.5, 6.0, 0.0), ("N", 2.5, 10.0, 0.0)], "model string, input_rate double, output_rate double, audio_rate double")
    return tools.token_costs(usage, prices)[0]


@query("fil_07_exclude_sections", f"SELECT section_id FROM {SECTIONS} s WHERE section_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {SECTIONS} t WHERE t.section_level = 2 AND t.section_path IS NOT NULL AND t.job_result_id = s.job_result_id AND (replace({sql_path('s.section_path')}, chr(0), '') = {sql_path('t.section_path')} OR starts_with({sql_path('s.section_path')}, {sql_path('t.section_path')} || ' / ')))")
def exclude_sections(spark, sf_dir):
    """Without the sections of the second level and all below them."""
    s = sections(spark, sf_dir).where("section_path is not null").select("section_id", F.col("job_result_id").alias("scope"), text.normal_path(F.col("section_path")).alias("path"), "section_level")
    out = trees.subtree(s, s.where("section_level = 2").select("scope", F.col("path").alias("target")), "scope").select("section_id").distinct()
    return s.join(out, "section_id", "left_anti").select("section_id")


@query("agg_10_bounded_count", f"SELECT least(count(*), 11) AS bounded, count(*) <= 10 AS small FROM {CHUNKS} WHERE chunk_type = 'table'")
def bounded_count(spark, sf_dir):
    """One scope's rows, counted no further than eleven."""
    first = chunks(spark, sf_dir).where("chunk_type = 'table'").limit(11)
    return first.agg(F.count(F.lit(1)).alias("bounded")).withColumn("small", F.col("bounded") <= 10)
