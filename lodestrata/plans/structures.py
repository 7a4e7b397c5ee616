"""Plans over text structure, tables and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text
from lodestrata.operators import sheets, structure
from lodestrata.plans.base import CHUNKS, chunks, query, table
from lodestrata.sources import formats

LINES = r"(SELECT doc_id, unnest(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) AS line, unnest(range(0, len(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END))) AS line_no FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS p FROM documents WHERE text IS NOT NULL))"


def _lines(spark, sf_dir):
    return formats.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("src_01_formats", "SELECT DISTINCT document_id, CASE WHEN e IN ('pdf', 'pptx') THEN 'PAGES' WHEN e = 'docx' THEN 'DOCX' WHEN e IN ('xlsx', 'xls', 'csv', 'tsv') THEN 'SPREADSHEET' WHEN e IN ('md', 'markdown') THEN 'MARKDOWN' WHEN e IN ('html', 'htm') THEN 'HTML' WHEN e IN ('txt', 'json', 'log') THEN 'TEXT' END AS format FROM (SELECT document_id, lower(regexp_extract(source_file_name, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM demo_documents)")
def src_formats(spark, sf_dir):
    return table(spark, sf_dir, "demo_documents").select("document_id", formats.format_of(F.col("source_file_name")).alias("format")).distinct()


@query("src_02_text_lines", f"SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS n_chars FROM {LINES} GROUP BY doc_id")
def src_lines(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("n_chars"))


@query("src_03_win_09_markdown_paths", f"""WITH l AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*#{{1,6}}\\s+\\S') THEN length(regexp_extract(line, '^\\s*(#+)', 1)) END AS level, trim(regexp_extract(line, '^\\s*#+\\s+(.*)$', 1)) AS title FROM {LINES}),
h AS (SELECT doc_id, line_no, level, title, coalesce(lead(line_no) OVER (PARTITION BY doc_id, level ORDER BY line_no), 1000000000) AS again FROM l WHERE level IS NOT NULL),
e AS (SELECT h.*, coalesce((SELECT min(x.line_no) FROM h x WHERE x.doc_id = h.doc_id AND x.line_no > h.line_no AND x.level <= h.level), 1000000000) AS until FROM h)
SELECT l.doc_id, l.line_no, l.level, coalesce(string_agg(e.title, ' / ' ORDER BY e.level), '') AS path FROM l LEFT JOIN e ON e.doc_id = l.doc_id AND e.line_no <= l.line_no AND l.line_no < e.until GROUP BY l.doc_id, l.line_no, l.level""")  # fmt: skip
def markdown_paths(spark, sf_dir):
    return formats.markdown_lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "line_no", "level", "path")


@query("win_10_stm_transcript_turns", f"""WITH t AS (SELECT doc_id, line_no, (regexp_extract(line, '^\\[(\\d+):', 1)::BIGINT * 60 + regexp_extract(line, '^\\[\\d+:(\\d\\d)\\]', 1)::BIGINT) * 1000 AS start_ms, regexp_extract(line, '^\\[\\d+:\\d\\d\\] (\\w+): ', 1) AS speaker FROM {LINES} WHERE regexp_matches(line, '^\\[(\\d+):(\\d\\d)\\] (\\w+): (.*)$')),
f AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND start_ms - lag(start_ms) OVER w < 2000 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY start_ms, line_no))
SELECT doc_id, turn, count(*) AS n, min(start_ms) AS start_ms, max(start_ms) AS end_ms FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY start_ms, line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS turn FROM f) GROUP BY doc_id, turn""")  # fmt: skip
def transcript_turns(spark, sf_dir):
    spoken = structure.transcript(_lines(spark, sf_dir), "doc_id")
    return structure.turns(spoken, "doc_id").select("doc_id", "turn", "n", "start_ms", "end_ms")


@query("dt_05_time_ranges", f"SELECT doc_id, '[' || printf('%02d:%02d:%02d', a // 3600, a % 3600 // 60, a % 60) || '–' || printf('%02d:%02d:%02d', b // 3600, b % 3600 // 60, b % 60) || ']' AS span FROM (SELECT doc_id, min(s) AS a, max(s) AS b FROM (SELECT doc_id, regexp_extract(line, '^\\[(\\d+):', 1)::BIGINT * 60 + regexp_extract(line, '^\\[\\d+:(\\d\\d)\\]', 1)::BIGINT AS s FROM {LINES} WHERE regexp_matches(line, '^\\[(\\d+):(\\d\\d)\\] (\\w+): (.*)$')) GROUP BY doc_id)")
def time_ranges(spark, sf_dir):
    spoken = structure.transcript(_lines(spark, sf_dir), "doc_id")
    return spoken.groupBy("doc_id").agg(F.min("start_ms").alias("a"), F.max("start_ms").alias("b")).select("doc_id", structure.time_range(F.col("a"), F.col("b")).alias("span"))


@query("win_11_packed_lines")
def packed(spark, sf_dir):
    """Texts packed into groups of lines (a fold; tested against a loop)."""
    d = table(spark, sf_dir, "documents").where("text is not null and text <> ''")
    return d.select("doc_id", F.posexplode(structure.pack_lines(F.split("text", "\n"))).alias("part", "body")).select("doc_id", "part", F.length("body").alias("n_chars"))


@query("doc_17_page_grep", f"SELECT id, n FROM (SELECT id, len(regexp_extract_all(lower(coalesce(text, '')), 'annual (shutdown|report)')) AS n FROM {CHUNKS}) WHERE n > 0")
def page_grep(spark, sf_dir):
    n = F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(annual (?:shutdown|report))"), F.lit(1)))
    return chunks(spark, sf_dir).select("id", n.alias("n")).where("n > 0")


@query("cor_09_grep", f"""WITH hits AS (SELECT term, job_result_id, id, sort_order, text FROM {CHUNKS} JOIN (VALUES ('soil survey'), ('tender file')) AS v(term) ON contains(lower(text), term)),
f AS (SELECT *, row_number() OVER (PARTITION BY term, job_result_id ORDER BY sort_order, id) AS r FROM hits) SELECT term, job_result_id, id, strpos(lower(text), term) AS at FROM f WHERE r = 1""")  # fmt: skip
def grep(spark, sf_dir):
    from lodestrata.operators import tools

    return tools.grep(chunks(spark, sf_dir), ["soil survey", "tender file"]).select("term", "job_result_id", "id", "at")


@query("tab_13_search_text")
def search_text(spark, sf_dir):
    """Distinct cell texts of every table in reading order."""
    t = chunks(spark, sf_dir).where("chunk_type = 'table' and text like '%<table%'")
    return t.select("id", sheets.coarse_text(sheets.html_grid(F.col("text"))).alias("search_text"))


@query("str_13_snippets", f"""SELECT id, CASE WHEN n <= 260 THEN text ELSE left(text, 60) || coalesce('...' || CASE WHEN b > 61 AND a < n - 39 THEN substr(text, greatest(a, 61), greatest(least(b, n - 39) - greatest(a, 61), 0)) END, '') || '...' || substr(text, n - 39, 40) END AS snippet
FROM (SELECT id, text, length(text) AS n, greatest(strpos(lower(text), 'soil survey') - 80, 1) AS a, least(strpos(lower(text), 'soil survey') + 11 + 80, length(text) + 1) AS b FROM {CHUNKS} WHERE contains(lower(text), 'soil survey'))""")  # fmt: skip
def snippets(spark, sf_dir):
    c = chunks(spark, sf_dir).where("contains(lower(text), 'soil survey')")
    return c.select("id", text.snippet(F.col("text"), F.lit("soil survey")).alias("snippet"))


TOC = r"^\s*(\d+(?:\.\d+)*)\.?\s+(.*?)\s*\.{3,}\s*(\d+)\s*$"


@query("doc_05_contents_rows", f"SELECT doc_id, line_no, regexp_extract(line, '{TOC}', 1) AS number, len(string_split(regexp_extract(line, '{TOC}', 1), '.')) AS level, regexp_extract(line, '{TOC}', 2) AS title, regexp_extract(line, '{TOC}', 3)::INT AS page FROM {LINES} WHERE regexp_matches(line, '{TOC}')")
def contents_rows(spark, sf_dir):
    return structure.contents_rows(_lines(spark, sf_dir), "doc_id")


@query("doc_04_contents_areas", f"""WITH l AS (SELECT *, regexp_matches(line, '{TOC}') AS hit FROM {LINES} WHERE trim(line) <> ''), s AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER (PARTITION BY doc_id ORDER BY line_no), false) THEN 1 ELSE 0 END AS st FROM l),
r AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM s), k AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) - 1) // 100 AS k FROM r WHERE hit)
SELECT doc_id, run || '.' || k AS area, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n FROM k GROUP BY doc_id, run, k""")  # fmt: skip
def contents_areas(spark, sf_dir):
    return structure.contents_areas(_lines(spark, sf_dir), "doc_id")
