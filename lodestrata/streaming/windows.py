"""Streams: counters, windows and de-duplication with watermarks, and a per-key limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hit_counters(hits: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Counters by key (update or complete mode): hits, first and last time."""
    return hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.min(at).alias("first_hit"), F.max(at).alias("last_hit"))


def windowed_counts(hits: DataFrame, keys: list[str], size: str = "1 day", slide: str | None = None, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return hits.withWatermark(at, late).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def session_counts(hits: DataFrame, key: str, gap: str = "2 hours", late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Sessions of a key: rows without a gap between them."""
    return hits.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def deduplicated(claims: DataFrame, keys: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Each key once within the watermark."""
    return claims.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def limited(hits: DataFrame, key: str, per_minute: int, at: str = "ts") -> DataFrame:
    """(key, ts, allowed, retry_after_s): a sliding window of a minute per key, one decision per hit; -1 is no limit.

    State per key is the times allowed within the last minute, at most ``per_minute`` of them.
    """
    kind = hits.schema[key].dataType.simpleString()

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        rows = []
        for t in sorted(x for b in batches for x in b[at]):
            now = t.value / 1e9 if hasattr(t, "value") else t.timestamp()
            recent = [x for x in recent if x > now - 60]
            ok = per_minute < 0 or len(recent) < per_minute
            rows.append((k[0], t, ok, 0.0 if ok else recent[0] + 60 - now))
            if ok and per_minute >= 0:
                recent.append(now)
        state.update((recent,))
        yield pd.DataFrame(rows, columns=["key", "ts", "allowed", "retry_after_s"])

    return hits.select(key, at).groupBy(key).applyInPandasWithState(decide, f"key {kind}, ts timestamp, allowed boolean, retry_after_s double", "recent array<double>", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Work off what is there now and return the result table (for batch replays and tests)."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return df.sparkSession.table(name)
