"""Promotion of staged rows, revision differences, reconciliation of two sources, and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jambwork.functions import text as T


def promote(production: DataFrame, staged: DataFrame, current: DataFrame, incoming: DataFrame) -> DataFrame:
    """What becomes of each door number: added, updated, unchanged or removed, and the opening as it is then.

    production and staged have (door_number, location, is_active); current and
    incoming have (door_number, signature) of their items. Only the ordered
    signature of names and quantities decides whether items are replaced. Doors
    that are not staged are deactivated, but only if anything is staged at all.
    """
    old = production.join(current, "door_number", "left").select("door_number", F.col("location").alias("old_location"), "is_active", F.col("signature").alias("old_signature"), F.lit(True).alias("there"))
    new = staged.join(incoming, "door_number", "left").select("door_number", F.col("location").alias("new_location"), F.col("signature").alias("new_signature"), F.lit(True).alias("comes"))
    rows = old.join(new, "door_number", "full_outer")
    same = F.col("old_signature").eqNullSafe(F.col("new_signature"))
    action = F.when(F.col("there").isNull(), "added").when(F.col("comes").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    out = rows.withColumn("action", action)
    if staged.isEmpty():
        out = out.withColumn("action", F.lit("unchanged"))
    location = F.when(F.col("comes"), F.col("new_location")).otherwise(F.col("old_location"))
    active = F.when(F.col("action") == "removed", False).when(F.col("comes"), True).otherwise(F.col("is_active"))
    keep = F.when(F.col("action").isin("added", "updated"), F.col("new_signature")).otherwise(F.col("old_signature"))
    return out.select("door_number", "action", location.alias("location"), active.alias("is_active"), keep.alias("signature"))


def promote_counts(promoted: DataFrame) -> DataFrame:
    return promoted.groupBy("action").agg(F.count("*").alias("n"))


def changes(old: DataFrame, new: DataFrame, key: Column, fields: list[str]) -> DataFrame:
    """Rows of both revisions by key: matched, changed (and which fields), added or removed.

    Values are compared trimmed and in lower case; a new value that is empty, -,
    n/a, null or undefined changes nothing.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    a = old.select(key.alias("key"), *(plain(f).alias(f"a_{f}") for f in fields), F.lit(True).alias("in_a"))
    b = new.select(key.alias("key"), *(plain(f).alias(f"b_{f}") for f in fields), F.lit(True).alias("in_b"))
    rows = a.join(b, "key", "full_outer")
    differ = [F.when((F.col(f"a_{f}") != F.col(f"b_{f}")) & ~F.col(f"b_{f}").isin("", "-", "n/a", "null", "undefined"), F.lit(f)) for f in fields]
    rows = rows.withColumn("fields", F.array_join(F.filter(F.array(*differ), lambda x: x.isNotNull()), ","))
    state = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(F.col("fields") == "", "matched").otherwise("changed")
    return rows.select("key", state.alias("state"), F.when(state == "changed", F.col("fields")).otherwise("").alias("fields"))


#: What a cast takes for a number.
NUMBER = r"(?i)^[\s\p{Cntrl}]*[+-]?(nan|inf(inity)?|0x[0-9a-f]*\.?[0-9a-f]*p[+-]?\d+[df]?|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?[df]?)[\s\p{Cntrl}]*$"


def _number(x: Column) -> Column:
    """A text's number or null; only what looks like one is cast, as each failing cast raises and catches an exception."""
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def reconciled(a: Column, b: Column, prefer_b: bool) -> Column:
    """(value, confidence, chosen_from) of a field that two sources have."""
    x, y = F.coalesce(F.trim(a.cast("string")), F.lit("")), F.coalesce(F.trim(b.cast("string")), F.lit(""))
    numbers = F.coalesce(_number(x) == _number(y), F.lit(False))
    row = lambda v, c, s: F.struct(v.alias("value"), F.lit(c).alias("confidence"), F.lit(s).alias("chosen_from"))
    clash = row(y, "conflict", "b") if prefer_b else row(x, "conflict", "a")
    return F.when((x == "") & (y == ""), row(F.lit(""), "conflict", "none")).when(y == "", row(x, "single_source", "a")).when(x == "", row(y, "single_source", "b")).when((F.lower(x) == F.lower(y)) | numbers, row(x, "full", "a")).otherwise(clash)


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """Both sources' rows by key, each field reconciled; fields says for which the second source is preferred."""
    rows = left.select(key, *(F.col(f).alias(f"a_{f}") for f in fields)).join(right.select(key, *(F.col(f).alias(f"b_{f}") for f in fields)), key, "full_outer")
    return rows.select(key, *(reconciled(F.col(f"a_{f}"), F.col(f"b_{f}"), b).alias(f) for f, b in fields.items()))


#: What a field counts for in the score of a reconciliation.
SCORES = {"full": 100, "single_source": 50, "conflict": 25}


def reconciliation_summary(rows: DataFrame, fields: list[str]) -> DataFrame:
    long = rows.select(F.explode(F.array(*(F.col(f"{f}.confidence") for f in fields))).alias("c"))
    score = reduce(lambda w, x: w.when(F.col("c") == x[0], x[1]), SCORES.items(), F.when(F.lit(False), 0))
    count = lambda x: F.count(F.when(F.col("c") == x, 1))
    return long.agg(F.count("*").alias("fields"), count("full").alias("full"), count("single_source").alias("single"), count("conflict").alias("conflicts"), T.rounded(F.avg(score)).alias("score"))


def upsert(target: DataFrame, source: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """target with the source's rows: only the given columns are overwritten; new keys are appended."""
    new = source.select(*key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_new"))
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    return target.join(new, key, "full_outer").select(*key, *(pick(c) for c in target.columns if c not in key))


def insert_missing(target: DataFrame, source: DataFrame, key: list[str], position: str) -> DataFrame:
    """target and the first row of each key of the source that it lacks."""
    from jambwork.operators.sets import first_per_group

    fresh = first_per_group(source, key, F.col(position)).join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))
