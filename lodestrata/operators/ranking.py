"""Ranking of candidates by usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import scoring


def usage_heat(hits: DataFrame, key: str, at: str, now: Column) -> DataFrame:
    """(key, hits, last_hit, created, heat) of hit rows, as of ``now``."""
    days = lambda c: (now.cast("double") - F.col(c).cast("timestamp").cast("double")) / 86400
    sums = hits.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.max(at).alias("last_hit"), F.min(at).alias("created"))
    return sums.withColumn("heat", scoring.heat(F.col("hits"), days("last_hit"), days("created")))


#: Ranges the values are cut into to find those at given places.
RANGES = 1_000


def values_at(df: DataFrame, column: str, places: list[int]) -> dict[int, float]:
    """The values at some places (from 0) of the sorted column, nulls left out, exactly.

    Values are counted by about ``RANGES`` ranges of equal frequency, and only the ranges that hold a place are sorted.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    edges = sorted(set(values.agg(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).first()[0] or []))
    within = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < F.col("v"))) if edges else F.lit(0)
    counts = dict(values.groupBy(within.alias("r")).count().collect())  # RANGES rows at most
    wanted, first = {}, 0
    for r in sorted(counts):
        wanted.setdefault(r, []).extend((p, p - first) for p in places if first <= p < first + counts[r])
        first += counts[r]
    out = {}
    for r, inside in wanted.items():
        if inside:
            own = values.where(within == r).groupBy("v").count()
            w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            upto = own.withColumn("upto", F.sum("count").over(w)).withColumn("r", F.lit(r))
            out |= {p: upto.where(F.col("upto") > k).agg(F.min("v")).first()[0] for p, k in inside}
    return out


def importance(df: DataFrame, heat: str) -> DataFrame:
    """Rows with ``importance`` in (0.1, 2): heat scaled by quartiles picked by index, through a sigmoid.

    The quartiles are those at positions n/2, n/4 and 3n/4 of the sorted heats
    (below four rows least and greatest); 1 where the quartiles coincide. The
    positions are found by counts of ranges, only three values are joined back.
    """
    n = df.where(F.col(heat).isNotNull()).count()
    places = {"m": n // 2, "q1": n // 4 if n >= 4 else 0, "q3": 3 * n // 4 if n >= 4 else n - 1}
    found = values_at(df, heat, sorted(set(places.values()))) if n else {}
    picked = df.sparkSession.createDataFrame([tuple(found.get(p) for p in places.values())], "m double, q1 double, q3 double")
    spread = F.col("q3") - F.col("q1")
    return df.join(F.broadcast(picked)).withColumn("importance", F.when(spread <= 1e-9, 1.0).otherwise(0.1 + 1.9 * scoring.sigmoid((F.col(heat) - F.col("m")) / spread))).drop("m", "q1", "q3")


def _spread(values: Column, raw: Column, low: float = 0.1, high: float = 2.0) -> Column:
    """The multiplier of ``raw`` among sorted ``values``: its distance to the median in quartile ranges, through a sigmoid, four places."""
    n = F.size(values)
    at = lambda i: values[i.cast("int")]
    median = F.when(n % 2 == 1, at(F.floor(n / 2))).otherwise((at(F.greatest(F.floor(n / 2) - 1, F.lit(0))) + at(F.floor(n / 2))) / 2)
    q1, q3 = F.when(n >= 4, at(F.floor(n / 4))).otherwise(values[0]), F.when(n >= 4, at(F.floor(3 * n / 4))).otherwise(at(n - 1))
    return F.when(q3 - q1 <= 1e-9, 1.0).otherwise(F.round(low + (high - low) * scoring.sigmoid((raw - median) / (q3 - q1)), 4))


def rank_candidates(discovered: DataFrame, routed: DataFrame, heat: DataFrame, k: int) -> DataFrame:
    """(query_id, key, agent_score, discovery_score, score, rank) of the k best candidates of each query.

    ``discovered`` (query_id, key, discovery_score, place) and ``routed`` (query_id, key, agent_score, place) are put together by key,
    the best agent score holding; places tell their order, discovered ones first. Scores are multiplied by the usage heat
    (key, heat) of the key among all candidates of the query. Where a query has routed rows, those with an agent score come first
    and the others fill up; ranks go by agent score, discovery score and order. Candidates are few per query, whatever the corpus.
    """
    a = discovered.groupBy("query_id", "key").agg(F.max("discovery_score").alias("d"), F.min("place").alias("at"))
    b = routed.groupBy("query_id", "key").agg(F.max("agent_score").alias("a"), F.min("place").alias("b_at"))
    both = a.join(b, ["query_id", "key"], "full").join(heat.select("key", "heat"), "key", "left").withColumn("heat", F.coalesce("heat", F.lit(0.0)))
    w = Window.partitionBy("query_id")
    m = both.withColumn("m", _spread(F.sort_array(F.collect_list("heat").over(w)), F.col("heat"))).withColumn("routed", F.count("b_at").over(w) > 0)
    scored = m.select("query_id", "key", "routed", "at", "b_at", F.round(F.coalesce("a", F.lit(0.0)) * F.col("m"), 6).alias("agent_score"), F.round(F.coalesce("d", F.lit(0.0)) * F.col("m"), 6).alias("discovery_score"))
    fallback = F.col("routed") & (F.col("agent_score") <= 0)
    order = Window.partitionBy("query_id").orderBy(fallback, F.desc("agent_score"), F.desc("discovery_score"), F.col("at").isNull(), F.coalesce("at", "b_at"), "key")
    score = F.when(F.col("routed"), F.col("agent_score")).otherwise(F.greatest("agent_score", "discovery_score"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "key", "agent_score", "discovery_score", score.alias("score"), "rank")
