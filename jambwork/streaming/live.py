"""Streams that act: changes that become refreshes after a pause, state that is kept in versions, queues that are replayed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from jambwork.sources import versions
from jambwork.streaming import progress

#: Fixed value: a queued event that has failed so often is given up.
MAX_RETRIES = 5


def stamped(events: DataFrame, column: str = "server_updated_at") -> DataFrame:
    """Events with the time of ingestion, whatever time they bring themselves; on a stream that of their batch."""
    return events.withColumn(column, F.current_timestamp())


def refreshes(changes: DataFrame, key: list[str], gap: str = "5 seconds", at: str = "acted_at", late: str = "1 minute") -> DataFrame:
    """One refresh of a key for each run of changes without a pause of `gap`: its first change, when it is due, and how many changes it shows.

    A change just `gap` after the last one still belongs to its run. On a stream a run is given out when the watermark has passed
    it, and a change that comes later than `late` is dropped; on a batch nothing is late. Changes without a time are in no run.
    Null keys are a key. State is a row for each open run.
    """
    rows = changes.withWatermark(at, late) if changes.isStreaming else changes
    runs = rows.groupBy(F.session_window(at, gap).alias("run"), *key).agg(F.count("*").alias("n"))
    return runs.select(*key, F.col("run.start").alias("began"), F.col("run.end").alias("due"), "n")


def folded(batch: DataFrame, path: str, version: int, key: list[str], values: list[str], at: str = "acted_at", tie: str = "event_id", buckets: int = versions.BUCKETS) -> bool:
    """Folds a micro-batch into the state at path, and keeps the events that came too late; a batch that is known counts once (False).

    An event older than its key's state is rejected; equal times are accepted, the larger id of a batch wins. Repeats of an
    event in a batch count once. Null keys and events without a time are rejected too. Only buckets of keys in the batch are read and written.
    """
    spark = batch.sparkSession
    before = versions.last(spark, path)
    if before is not None and version <= before:
        return False
    schema = StructType([batch.schema[c] for c in (*key, *values, at)])
    rows = versions.with_bucket(batch.dropDuplicates([tie]).select(*key, *values, at, tie), key, buckets).persist()
    try:
        whole = F.col(at).isNotNull()
        for k in key:
            whole &= F.col(k).isNotNull()
        touched = rows.select("bucket").distinct()
        old = versions.current(spark, path, "state", schema).join(F.broadcast(touched), "bucket", "left_semi")
        new, rejected = progress.fold(old.drop("bucket"), rows.where(whole).drop("bucket"), key, values, at, tie)
        rejected = rejected.select(*key, *values, at, tie).unionByName(rows.where(~whole).drop("bucket"))
        tables = {"state": versions.with_bucket(new, key, buckets), "rejected": versions.with_bucket(rejected, key, buckets)}
        return versions.publish(spark, path, version, tables, touched)
    finally:
        rows.unpersist()


def keep_state(events: DataFrame, path: str, checkpoint: str, key: list[str], values: list[str], at: str = "acted_at", tie: str = "event_id", buckets: int = versions.BUCKETS, **trigger) -> StreamingQuery:
    """Runs a stream of events into the state at path. After a crash a batch may come again: it has its number, and counts once."""
    sink = lambda batch, number: folded(batch, path, number, key, values, at, tie, buckets)
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def replayed(queue: DataFrame, status: Column, order: list[str], queue_key: list[str], retries: str = "retry_count") -> DataFrame:
    """A pass over queues of pending events: what becomes of each (`outcome`) and its tries (`retries`).

    2xx is synced, and 409 too (`conflict`: the server has newer values); the first 401 stops its queue, and what stands behind it
    is left as it is (`waiting`, as is that event). Events that have failed MAX_RETRIES times are `given_up` and not
    sent; others have failed once more, also where there is no answer (null). A queue is in one task; queues are those of devices.
    """
    from pyspark.sql import Window

    spent = F.coalesce(F.col(retries), F.lit(0)) >= MAX_RETRIES
    so_far = Window.partitionBy(*queue_key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.max(F.coalesce(~spent & (status == 401), F.lit(False))).over(so_far)
    sent = F.when(status.between(200, 299), "synced").when(status == 409, "conflict").otherwise("failed")
    rows = queue.withColumn("outcome", F.when(stopped, "waiting").when(spent, "given_up").otherwise(sent))
    return rows.withColumn(retries, F.coalesce(F.col(retries), F.lit(0)) + F.when(F.col("outcome") == "failed", 1).otherwise(0))


def replay_counts(rows: DataFrame) -> DataFrame:
    """How many of a pass are synced (conflicts included), failed (given up included) and conflicts."""
    count = lambda *x: F.count(F.when(F.col("outcome").isin(*x), 1))
    return rows.agg(count("synced", "conflict").alias("synced"), count("failed", "given_up").alias("failed"), count("conflict").alias("conflicts"))
