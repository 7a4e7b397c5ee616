"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import hierarchy, nested
from lodestrata.plans import documents, more, relational, retrieval, routes, structures, trees  # noqa: F401
from lodestrata.plans.base import ORACLES, QUERIES, Query, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.found(table(spark, sf_dir, "result_packages"), table(spark, sf_dir, "demo_catalog"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.found(table(spark, sf_dir, "directory_sections"))


#: The same by the transitive closure of the links.
P2_SQL = """WITH RECURSIVE s AS (SELECT DISTINCT section_id AS id, CASE WHEN trim(parent_section_id) <> '' THEN parent_section_id END AS p FROM directory_sections WHERE section_id IS NOT NULL),
link AS (SELECT a.id, a.p FROM s a JOIN s b ON b.id = a.p), up(id, anc) AS (SELECT id, p FROM link UNION SELECT up.id, link.p FROM up JOIN link ON link.id = up.anc),
ring AS (SELECT id FROM up WHERE id = anc), bad AS (SELECT up.id, min(up.anc) AS ring_id FROM up JOIN ring ON ring.id = up.anc GROUP BY up.id),
top AS (SELECT up.id, up.anc AS root FROM up WHERE up.anc NOT IN (SELECT id FROM link)), depth AS (SELECT id, count(*) AS d FROM up GROUP BY id), below AS (SELECT anc AS id, count(*) AS n FROM up GROUP BY anc)
SELECT s.id AS section_id, coalesce(bad.ring_id, top.root, s.id) AS root_section_id, CASE WHEN bad.id IS NOT NULL THEN -1 ELSE coalesce(d, 0) END AS tree_depth, CASE WHEN bad.id IS NOT NULL THEN -1 ELSE coalesce(n, 0) END AS n_descendants
FROM s LEFT JOIN bad USING (id) LEFT JOIN top USING (id) LEFT JOIN depth USING (id) LEFT JOIN below USING (id)"""


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found} | QUERIES


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL} | ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical discovery of every evaluation question."""
    return retrieval.discovery(spark, sf_dir)
