"""De-duplication, set operations, ordering and window-like passes over explicit positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import text as T


def first_per_group(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group: an aggregation, so that a large group is reduced before it is moved.

    order: columns whose struct is compared; use `last` for descending or null-last keys.
    """
    rest = [c for c in rows.columns if c not in by]
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*by, *(F.col("_r")[c].alias(c) for c in rest))


def nulls_last(column: Column) -> tuple[Column, Column]:
    return column.isNull(), column


def union_by_priority(frames: list[DataFrame], by: list[str], position: str) -> DataFrame:
    """Rows of several strategies: an earlier one's row wins, within one the first."""
    rows = frames[0].withColumn("strategy", F.lit(0))
    for k, more in enumerate(frames[1:], 1):
        rows = rows.unionByName(more.withColumn("strategy", F.lit(k)))
    return first_per_group(rows, by, F.col("strategy"), F.col(position))


def most_complete(rows: DataFrame, key: Column, fields: list[str], position: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Of rows with one key (within `by`) the one with most filled fields, ties to the first; `first` is where the key first occurs."""
    filled = sum((F.when(T.blank_to_null(F.col(f).cast("string")).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    rows = rows.withColumn("key", key).withColumn("score", filled)
    rest = [c for c in rows.columns if c not in ("key", *by)]
    out = rows.groupBy(*by, "key").agg(F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col(position))).alias("_r"), F.min(position).alias("first"))
    return out.select(*by, "key", "first", *(F.col("_r")[c].alias(c) for c in rest))


def merge_chunks(sets: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets of several chunks by id, with the longest heading (ties to the first); their items once each."""
    merged = sets.groupBy("set_id").agg(F.max_by("heading", F.struct(F.length("heading"), -F.col("pos"))).alias("heading"), F.min("pos").alias("pos"), F.count("*").alias("chunks"))
    once = most_complete(items, F.concat_ws("\u0001", "set_id", F.coalesce(T.blank_to_null(T.model_key(F.col("model"))), T.item_name(F.col("name")))), ["name", "model", "manufacturer", "finish"], "pos")
    return merged, once.drop("key")


def two_sources(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The union of two arrays as sorted text, what only one has, and how far they agree."""
    x, y = (F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))) for c in (a, b))
    same = F.array_sort(x) == F.array_sort(y)
    how = F.when(same & (F.size(x) > 0), "full").when((F.size(x) == 0) | (F.size(y) == 0), "single_source").otherwise("conflict")
    text = lambda v: F.array_join(F.array_sort(v), ", ")
    return rows.withColumn("value", text(F.array_union(x, y))).withColumn("only_a", text(F.array_except(x, y))).withColumn("only_b", text(F.array_except(y, x))).withColumn("confidence", how)


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page of rows; the last column of the order has to be unique. The size is held between 1 and 100."""
    size = min(max(size, 1), 100)
    return rows.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def gap_outliers(rows: DataFrame, by: list[str], position: str, most: int = 2) -> DataFrame:
    """Positions further than `most` from both neighbours; none in groups of one."""
    w = Window.partitionBy(*by).orderBy(position)
    before, after = F.col(position) - F.lag(position).over(w), F.lead(position).over(w) - F.col(position)
    far = lambda gap: F.coalesce(gap > most, F.lit(True))
    out = rows.withColumn("_b", before).withColumn("_a", after)
    return out.where((F.col("_b").isNotNull() | F.col("_a").isNotNull()) & far(F.col("_b")) & far(F.col("_a"))).drop("_a", "_b")


def segments(rows: DataFrame, by: list[str], order: list[str], begins: Column) -> DataFrame:
    """Rows numbered by the running count of beginnings; a group's first row begins a segment."""
    w = Window.partitionBy(*by).orderBy(*order)
    mark = rows.withColumn("_begin", F.when(F.row_number().over(w) == 1, 1).otherwise(begins.cast("int")))
    return mark.withColumn("segment", F.sum(F.coalesce("_begin", F.lit(0))).over(w)).drop("_begin")


def sessions(events: DataFrame, actor: str, at: str, minutes: int) -> DataFrame:
    """A row for each stretch of an actor's events whose gaps are at most so many minutes (extension)."""
    w = Window.partitionBy(actor).orderBy(at, "event_id")
    gap = F.col(at) > F.lag(at).over(w) + F.make_interval(mins=F.lit(minutes))
    rows = segments(events.withColumn("_gap", F.coalesce(gap, F.lit(False))), [actor], [at, "event_id"], F.col("_gap"))
    return rows.groupBy(actor, "segment").agg(F.count("*").alias("n"), F.min(at).alias("started"), F.max(at).alias("ended"))


def merge_fragments(rows: DataFrame, by: list[str], position: str, fragment: Column, text: str) -> DataFrame:
    """Fragments are appended to the last whole row before them; leading fragments stay one row."""
    own = segments(rows, by, [position], ~fragment)
    return own.groupBy(*by, "segment").agg(F.min(position).alias(position), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda x: x[text]), " ").alias(text))


def retyped_after(rows: DataFrame, by: str, position: str, ends: Column, which: Column, to: str) -> DataFrame:
    """rows whose `type` becomes another for those after a group's last end."""
    last = rows.groupBy(by).agg(F.max(F.when(ends, F.col(position))).alias("_last"))
    return rows.join(last, by).withColumn("type", F.when((F.col(position) > F.col("_last")) & which, to).otherwise(F.col("type"))).drop("_last")


def per_distinct(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """rows with columns that depend on some keys only, worked out once for each distinct value of these."""
    each = rows.select(*keys).distinct().withColumns(columns).select(*(F.col(k).alias(f"_{k}") for k in keys), *columns)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return rows.join(each, same).drop(*(f"_{k}" for k in keys))
