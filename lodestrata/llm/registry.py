"""The queries on training texts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, langid, leak, neardup, ocr, spam, splitting
from lodestrata.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.found(table(spark, sf_dir, "job_chunks"), table(spark, sf_dir, "demo_documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.found(table(spark, sf_dir, "job_chunks"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(table(spark, sf_dir, "job_chunks"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's class of equal texts and its number of near classes, by five-word sequences and 0.8."""
    return neardup.classes(table(spark, sf_dir, "job_chunks"), "id", "text")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.found(table(spark, sf_dir, "job_chunks"), table(spark, sf_dir, "split_limits"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_ids(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.found(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_classes": p5_classes, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found}


#: Ends are marked behind their mark, then the text is split at them; a stretch counts without white space around it.
P6_SQL = r"""WITH long AS (SELECT DISTINCT c.id, c.text, l.max_chars FROM job_chunks c JOIN split_limits l USING (chunk_type) WHERE c.id IS NOT NULL AND length(c.text) > l.max_chars),
marked AS (SELECT id, max_chars, string_split(regexp_replace(regexp_replace(text, '([.!?])(\s)', '\1' || chr(1) || '\2', 'g'), '(\n|\r|</tr>|[。！？])', '\1' || chr(1), 'g'), chr(1)) AS parts FROM long)
SELECT id, CASE WHEN max(list_max(list_transform(parts, lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))) - max_chars) > 0 THEN 'forced' ELSE 'natural' END AS cut_kind FROM marked GROUP BY id"""

#: All runs of twelve words of items and documents, joined on equality.
P8_SQL = r"""WITH w AS (SELECT doc_id AS k, 0 AS side, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents UNION ALL SELECT item_id, 1, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items),
runs AS (SELECT k, side, array_to_string(ws[i:i + 11], ' ') AS run FROM (SELECT k, side, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12))
SELECT DISTINCT d.k AS doc_id, e.k AS item_id FROM runs d JOIN runs e ON d.run = e.run WHERE d.side = 0 AND e.side = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p8_found": P8_SQL}
