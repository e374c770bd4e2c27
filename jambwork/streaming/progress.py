"""Field events as streams: latest state by key, stale writes, replays, windows. Each works on batches as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_event_time(events: DataFrame, at: str = "acted_at") -> DataFrame:
    """Watermarks need zoned timestamps."""
    return events.withColumn(at, F.col(at).cast("timestamp"))


def once(events: DataFrame, key: str = "event_id", at: str = "acted_at", late: str = "1 day") -> DataFrame:
    """Replayed events once, on a stream within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest(events: DataFrame, key: list[str], values: list[str], at: str = "acted_at", tie: str = "event_id") -> DataFrame:
    """The state after all events: the newest values by key, equal times to the larger id. Incremental on a stream."""
    order = F.struct(at, tie)
    return events.groupBy(*key).agg(*(F.max_by(v, order).alias(v) for v in values), F.max(at).alias(at), F.count("*").alias("n"))


def fold(state: DataFrame, batch: DataFrame, key: list[str], values: list[str], at: str = "acted_at", tie: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(new state, rejected events) after a micro-batch: events older than the state are stale; equal times are accepted."""
    old = state.select(*key, F.col(at).alias("_at"))
    met = batch.join(old, key, "left").withColumn("_stale", F.coalesce(F.col(at) < F.col("_at"), F.lit(False)))
    order = F.struct(at, tie)
    fresh = met.where("not _stale").groupBy(*key).agg(*(F.max_by(v, order).alias(v) for v in values), F.max(at).alias(at))
    kept = state.join(fresh.select(*key), key, "left_anti")
    return kept.select(*key, *values, at).unionByName(fresh.select(*key, *values, at)), met.where("_stale").drop("_stale", "_at")


def daily(events: DataFrame, at: str = "acted_at", late: str = "1 day") -> DataFrame:
    """Events by UTC day and action."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 day").alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "action", "n")


def overdue(rows: DataFrame, status: str, at: str, as_of: str, limits: dict[str, int]) -> DataFrame:
    """Rows that have been in a status for longer than its seconds: they failed."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    out = F.lit(False)
    for name, seconds in limits.items():
        out |= (F.col(status) == name) & (age > seconds * 1_000_000)
    return rows.where(out)


def stale(rows: DataFrame, changed: Column, summed: Column) -> DataFrame:
    """rows with whether something changed after it was summed up; null never did."""
    return rows.withColumn("stale", F.coalesce(changed > summed, F.lit(False)))
