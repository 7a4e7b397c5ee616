"""Corpus tools over chunks, and a registry that checks their arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text

#: Most rows a tool returns (fixed value).
MAX_ITEMS = 50
SAME_AS = r"\[SAME-AS ([^\]]+?)(?: p(\d+))?\]"


@dataclass
class Tool:
    name: str
    run: Callable[..., DataFrame]
    types: dict[str, type] = field(default_factory=dict)
    required: tuple[str, ...] = ()


class Registry:
    """Tools by name; arguments are checked before a tool runs."""

    def __init__(self):
        self.tools: dict[str, Tool] = {}

    def tool(self, name: str, required: tuple[str, ...] = (), **types: type):
        def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.tools[name] = Tool(name, f, types, required)
            return f

        return add

    def dispatch(self, name: str, chunks: DataFrame, **arguments) -> DataFrame:
        if name not in self.tools:
            raise ValueError(f"unknown tool {name}")
        t = self.tools[name]
        if missing := [a for a in t.required if a not in arguments]:
            raise ValueError(f"missing: {', '.join(missing)}")
        for a, v in arguments.items():
            if a not in t.types:
                raise ValueError(f"unknown argument {a}")
            if not isinstance(v, t.types[a]):
                raise ValueError(f"{a} must be {t.types[a].__name__}")
        return t.run(chunks, **arguments)


REGISTRY = Registry()


@REGISTRY.tool("corpus.grep", ("terms",), terms=list)
def grep(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(term, job_result_id, id, at, snippet): the first chunk of each revision that holds a term, literally and whatever its case."""
    listed = F.explode(F.array(*[F.lit(t.lower()) for t in terms])).alias("term")
    hits = chunks.where(F.col("text").isNotNull()).select("*", listed).where(F.contains(F.lower("text"), F.col("term")))
    w = Window.partitionBy("term", "job_result_id").orderBy("sort_order", "id")
    first = hits.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return first.select("term", "job_result_id", "id", F.instr(F.lower("text"), F.col("term")).alias("at"), text.snippet(F.col("text"), F.col("term")).alias("snippet"))


@REGISTRY.tool("corpus.assets", (), kind=str, query=str)
def assets(chunks: DataFrame, kind: str = "image", query: str = "") -> DataFrame:
    """(job_result_id, id, path) of the first assets of a kind whose text holds the query, in document order."""
    found = chunks.where((F.col("chunk_type") == kind) & F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(query.lower())))
    return found.orderBy("job_result_id", "sort_order", "id").limit(MAX_ITEMS).select("job_result_id", "id", "path")


@REGISTRY.tool("corpus.read", ("refs",), refs=list, mode=str)
def read(chunks: DataFrame, refs: list[str], mode: str = "self") -> DataFrame:
    """(ref, status, id, text): body chunks of each chunk id or path, with ``descendants`` those below too; refs without any are 'failed'."""
    if mode not in ("self", "descendants"):
        raise ValueError("mode is self or descendants")
    spark = chunks.sparkSession
    asked = spark.createDataFrame([(r,) for r in dict.fromkeys(refs)], "ref string")
    body = chunks.where(F.col("chunk_type").isin("text", "page")).select("id", "text", text.normal_path(F.col("path")).alias("path"))
    named = body.withColumn("ref", F.explode(F.array("id", "path") if mode == "self" else F.array_union(F.array("id"), text.path_prefixes(F.col("path")))))
    found = F.broadcast(asked).join(named, "ref").dropDuplicates(["ref", "id"]).select("ref", F.lit("ok").alias("status"), "id", "text")
    failed = asked.join(found, "ref", "left_anti").select("ref", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("text"))
    return found.unionByName(failed)


def resolve_same_as(pages: DataFrame) -> DataFrame:
    """Pages (revision, path, text) with each [SAME-AS path] replaced by the text of that page of the revision; one level, else a note."""
    refs = pages.withColumn("_n", F.monotonically_increasing_id()).withColumn("_owner", F.nullif(F.regexp_extract("text", SAME_AS, 1), F.lit("")))
    owners = pages.groupBy("revision", F.col("path").alias("_owner")).agg(F.first("text").alias("_body"))
    body = F.coalesce(F.regexp_replace("_body", SAME_AS, ""), F.concat(F.lit("(not found: "), F.col("_owner"), F.lit(")")))
    marker = F.regexp_extract("text", SAME_AS, 0)
    return refs.join(owners, ["revision", "_owner"], "left").withColumn("text", F.when(F.col("_owner").isNotNull(), F.replace(F.col("text"), marker, body)).otherwise(F.col("text"))).select("revision", "path", "text")


def without_embedded(rows: DataFrame) -> DataFrame:
    """Result rows (query_id, id, targets array) without those another row of the query embeds."""
    inside = rows.select("query_id", F.explode("targets").alias("id")).distinct()
    return rows.join(inside, ["query_id", "id"], "left_anti")


def token_costs(usage: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(costs by model and task, models without a price): tokens / 1e6 x rate + audio seconds x rate; unpriced ones aren't in the costs.

    usage (model, task, input_tokens, output_tokens, audio_seconds), prices (model, input_rate, output_rate, audio_rate).
    """
    sums = usage.groupBy("model", "task").agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("input_tokens", "output_tokens", "audio_seconds")])
    rate = lambda c: F.coalesce(c, F.lit(0.0))
    cost = F.col("input_tokens") / 1e6 * rate("input_rate") + F.col("output_tokens") / 1e6 * rate("output_rate") + F.col("audio_seconds") * rate("audio_rate")
    return sums.join(prices, "model").select("model", "task", F.round(cost, 9).alias("cost")), sums.join(prices, "model", "left_anti").select("model").distinct()
