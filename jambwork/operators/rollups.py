"""Aggregations over openings, their items and activity.

Items are summed by opening before any join, so that a parent's rows don't
multiply and what is moved has a row for each opening.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import text as T

STAGES = ("ordered", "received", "pre_install", "installed", "qa_qc")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def stage_counts(items: DataFrame) -> DataFrame:
    """A row for each known stage, zero if no item has it; null counts as ordered, other stages don't count."""
    spark = items.sparkSession
    known = spark.range(len(STAGES)).select(F.element_at(F.array(*map(F.lit, STAGES)), (F.col("id") + 1).cast("int")).alias("stage"))
    counts = items.groupBy(F.coalesce("stage", F.lit("ordered")).alias("stage")).agg(F.count("*").alias("n"))
    return known.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def opening_progress(items: DataFrame) -> DataFrame:
    """Items, checked ones and completed ones (QA or installed) of each opening that has any."""
    return items.groupBy("opening_id").agg(F.count("*").alias("items"), count_if(F.col("checked")).alias("checked"), count_if(F.col("qa_qc") | F.col("installed")).alias("completed"))


def with_progress(openings: DataFrame, items: DataFrame) -> DataFrame:
    """Openings with their progress, zero for those without items."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    own = [c for c in openings.columns if c != "opening_id"]
    return openings.join(opening_progress(items), "opening_id", "left").select("opening_id", *own, *map(zero, ("items", "checked", "completed")))


def group_rollup(openings: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """Total, completed, remaining and percentage by a column of openings; groups without items are kept."""
    rows = with_progress(openings, items).groupBy(F.coalesce(F.col(by).cast("string"), F.lit("Unassigned")).alias(by))
    out = rows.agg(F.sum("items").alias("total"), F.sum("completed").alias("completed"))
    return out.select(by, "total", "completed", (F.col("total") - F.col("completed")).alias("remaining"), T.percent(F.col("completed"), F.col("total")).alias("pct"))


def timeline(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Events of each of the last UTC days, none left out, and their running total."""
    calendar = events.sparkSession.range(days).select(F.date_sub(F.lit(as_of).cast("date"), (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))
    since = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    counts = events.where((F.to_date("acted_at") >= since) & (F.to_date("acted_at") <= F.lit(as_of).cast("date"))).groupBy(F.to_date("acted_at").alias("day")).agg(F.count("*").alias("n"))
    rows = calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return rows.withColumn("cumulative", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))  # a row for each day


def portfolio(projects: DataFrame, openings: DataFrame, items: DataFrame) -> DataFrame:
    """Openings, complete and incomplete ones, items and checked items of each project, those without openings too."""
    own = with_progress(openings.where("is_active"), items)
    complete = (F.col("items") > 0) & (F.col("checked") >= F.col("items"))
    sums = own.groupBy("project_id").agg(F.count("*").alias("openings"), count_if(complete).alias("complete"), F.sum("items").alias("items"), F.sum("checked").alias("checked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = projects.select("project_id", "project").join(sums, "project_id", "left").select("project_id", "project", *(zero(c).alias(c) for c in ("openings", "complete", "items", "checked")))
    return rows.withColumn("incomplete", F.col("openings") - F.col("complete")).withColumn("pct", T.percent(F.col("checked"), F.col("items")))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("projects"), *(F.sum(c).alias(c) for c in ("openings", "complete", "items", "checked")))


def project_summary(openings: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of workflow flags, and of openings with at least one item on each leaf side, by project."""
    side = lambda x: F.max(F.when(F.col("leaf_side") == x, 1).otherwise(0)).alias(x)
    own = items.groupBy("opening_id").agg(*(count_if(F.col(c)).alias(c) for c in ("checked", "installed", "qa_qc")), side("active"), side("inactive"), side("shared"))
    rows = openings.select("opening_id", "project_id").join(own, "opening_id")
    return rows.groupBy("project_id").agg(*(F.sum(c).cast("long").alias(c) for c in ("checked", "installed", "qa_qc", "active", "inactive", "shared")))


def set_counts(openings: DataFrame) -> DataFrame:
    """Doors and leaves of each set, by its upper-case id."""
    return openings.groupBy(F.upper("hw_set").alias("hw_set")).agg(F.count("*").alias("doors"), F.sum(F.coalesce("leaf_count", F.lit(1))).cast("long").alias("leaves"))


def tag_counts(rows: DataFrame, tags: str, fixed: list[str]) -> DataFrame:
    """Rows that hold each of some fixed tags."""
    return rows.agg(*(count_if(F.array_contains(tags, t)).alias(t) for t in fixed))


def families(products: DataFrame) -> DataFrame:
    """Product families by maker and series, with their variants and most frequent one, ties to the first."""
    series = F.lower(T.base_series(F.col("model"), F.col("manufacturer")))
    variants = products.groupBy(F.lower("manufacturer").alias("manufacturer"), series.alias("series"), T.model_key(F.col("model")).alias("variant")).agg(F.count("*").alias("n"), F.min("item_id").alias("first"))
    return variants.groupBy("manufacturer", "series").agg(F.sum("n").alias("total"), F.count("*").alias("variants"), F.max_by("variant", F.struct(F.col("n"), -F.col("first"))).alias("canonical"))


def most_common(rows: DataFrame, by: list[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group; ties go to the one seen first."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct(F.col("n"), -F.col("first"))).alias(value), F.max("n").alias("n"))


def signatures(items: DataFrame, names: DataFrame) -> DataFrame:
    """name:qty of an opening's items, in order, as one text."""
    rows = items.select("opening_id", "item_id", "qty").join(names.select("item_id", "name"), "item_id")
    sign = F.concat_ws(":", F.coalesce("name", F.lit("")), F.coalesce(F.col("qty").cast("string"), F.lit("1")))
    return rows.groupBy("opening_id").agg(F.array_join(F.array_sort(F.collect_list(sign)), "|").alias("signature"), F.count("*").alias("items"))


def shape_consensus(openings: DataFrame, least: float = 0.15, fewest: int = 3, sample: int = 5) -> DataFrame:
    """Whether each door number's shape is a dominant one; all are confirmed if there are few doors or no dominant shape."""
    rows = openings.withColumn("shape", T.door_shape(F.col("door_number")))
    counts = rows.groupBy("shape").agg(F.count("*").alias("n"))
    every = counts.agg(F.sum("n").alias("all"))
    counts = counts.crossJoin(every).withColumn("dominant", (F.col("n") >= fewest) & (F.col("n") >= least * F.col("all")))  # one row on the right
    any_ = counts.agg(F.bool_or("dominant").alias("some"), F.max("all").alias("all"))
    of_shape = counts.select("shape", "dominant").crossJoin(any_).select("shape", (F.col("dominant") | ~F.col("some") | (F.col("all") < sample)).alias("confirmed"))
    return rows.join(of_shape, "shape").select("opening_id", "door_number", "shape", "confirmed")


def rate_limit(events: DataFrame, as_of: str, most: int, minutes: int = 60) -> DataFrame:
    """Whether each actor may act again, and in how many seconds if not."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = events.where((F.col("acted_at") > end - F.make_interval(mins=F.lit(minutes))) & (F.col("acted_at") <= end))
    out = recent.groupBy("actor_id").agg(F.count("*").alias("n"), F.min("acted_at").alias("oldest"))
    left = F.unix_micros((F.col("oldest") + F.make_interval(mins=F.lit(minutes))).cast("timestamp")) - F.unix_micros(end.cast("timestamp"))
    return out.select("actor_id", "n", (F.col("n") < most).alias("allowed"), F.when(F.col("n") < most, 0).otherwise(F.greatest(F.ceil(left / 1_000_000), F.lit(0))).cast("long").alias("retry_after"))


def worst(levels: Column, order: list[str], empty: str) -> Column:
    """The lowest of some levels in an aggregation, by their order from worst to best."""
    rank = F.array_position(F.array(*map(F.lit, order)), levels)
    return F.coalesce(F.min_by(levels, F.when(rank > 0, rank)), F.lit(empty))


def compared(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, old, new and state of two runs' counts: fewer is a REGRESSION, more is CHANGED."""
    a, b = old.select(key, F.col("count").alias("old")), new.select(key, F.col("count").alias("new"))
    rows = a.join(b, key, "full_outer").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("old", "new")))
    return rows.withColumn("state", F.when(F.col("new") < F.col("old"), "REGRESSION").when(F.col("new") > F.col("old"), "CHANGED").otherwise("OK"))
