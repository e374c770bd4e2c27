"""Promotion of staged runs into production: guards, openings and items together, counts of what was done.

Any number of runs of different projects are promoted in one job. Frames: requests (run_id, user_id), runs (run_id,
project_id, status), members (project_id, user_id, role); production's openings (project_id, door_number, FIELDS,
is_active) and items (project_id, door_number, name, qty and more); staged ones have run_id for project_id.

A run that is refused changes nothing. Rows without a run, project or door number are in no run or match no door:
staged ones are left out, production's stay as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jambwork.sources import versions
from jambwork.sources.sinks import stored

#: What an opening takes over from a staged one, states of runs that can be promoted, and why others are refused.
FIELDS = ["hw_set", "hw_heading", "location", "door_type", "frame_type", "fire_rating", "hand", "pdf_page", "leaf_count"]
READY = ["reviewing", "completed_with_issues"]
NOT_FOUND, NO_ADMIN = "Extraction run not found", "User must be a project admin to promote extraction"
KEY = ["project_id", "door_number"]


def decided(requests: DataFrame, runs: DataFrame, members: DataFrame, staged: DataFrame, staged_items: DataFrame) -> DataFrame:
    """requests, once each, with project_id, the first reason against the run (error, else null) and its doors without items.

    The run has to exist, be ready, be asked for by an admin of its project, and have items for each of its doors; a
    project has one run at a time.
    """
    asked = requests.dropDuplicates(["run_id", "user_id"]).select("run_id", "user_id")
    admins = members.where("role = 'admin'").select("project_id", "user_id", F.lit(True).alias("_admin")).distinct()
    bare = staged.join(staged_items.select("run_id", "door_number"), ["run_id", "door_number"], "left_anti").groupBy("run_id").agg(F.array_sort(F.collect_list("door_number")).alias("orphan_doors"), F.count("*").alias("_bare"))
    rows = asked.join(runs.select("run_id", "project_id", "status"), "run_id", "left").join(admins, ["project_id", "user_id"], "left").join(bare, "run_id", "left")
    ready = F.when(F.col("status").isin(READY), True).otherwise(False)
    rows = rows.withColumn("_fit", F.col("project_id").isNotNull() & ready & F.coalesce("_admin", F.lit(False)) & F.col("_bare").isNull())
    rows = rows.join(rows.where("_fit").groupBy("project_id").agg(F.count("*").alias("_n")), "project_id", "left")
    why = F.when(F.col("project_id").isNull(), NOT_FOUND)
    why = why.when(~ready, F.concat(F.lit('Cannot promote extraction in status "'), F.coalesce("status", F.lit("")), F.lit('". Must be "reviewing" or "completed_with_issues".')))
    why = why.when(F.col("_admin").isNull(), NO_ADMIN)
    why = why.when(F.col("_bare") > 0, F.concat(F.lit("Cannot promote: "), F.col("_bare"), F.lit(" door(s) have no hardware items: "), F.array_join("orphan_doors", ", "), F.lit(". Exclude them or add hardware before promoting.")))
    why = why.when(F.col("_n") > 1, "More than one run of the project")
    return rows.select("run_id", "user_id", "project_id", why.alias("error"), F.when(F.col("_admin") & ready, F.col("orphan_doors")).alias("orphan_doors"))


def _sign(items: str, qty) -> Column:
    """What decides whether a door's items differ: their sorted names and quantities; those without either don't count."""
    said = F.transform(items, lambda x: F.concat(x["name"], F.lit(":"), qty(x["qty"]).cast("string")))
    return F.array_join(F.array_sort(F.filter(said, lambda x: x.isNotNull())), "|")


def _by_door(**frames: DataFrame) -> DataFrame:
    """A row for each door with an array of each frame's rows, all frames moved together, once; rows without a key have one each."""
    structs = {n: F.struct(*(c for c in d.columns if c not in KEY)) for n, d in frames.items()}
    types = {n: d.select(structs[n].alias("r")).schema["r"].dataType for n, d in frames.items()}
    own = [d.select(*KEY, *((structs[n] if m == n else F.lit(None).cast(types[m])).alias(m) for m in frames)) for n, d in frames.items()]
    rows = reduce(DataFrame.unionByName, own)
    loose = F.when(reduce(lambda x, y: x | y, (F.col(k).isNull() for k in KEY)), F.monotonically_increasing_id())
    return rows.withColumn("_loose", loose).groupBy(*KEY, "_loose").agg(*(F.collect_list(n).alias(n) for n in frames)).drop("_loose")


def merged(openings: DataFrame, items: DataFrame, accepted: DataFrame, staged: DataFrame, staged_items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(openings with their action, items, counts by run) after the promotion of accepted runs (run_id, project_id).

    Doors are added, updated (other items: replaced), unchanged (only the opening's fields are taken over) or removed: doors of a
    project that aren't staged become inactive, if anything is staged at all, but keep their items. Doors that come
    back are active again. Doors that nothing happens to, those of other projects among them, have no action.

    Old and new openings and items meet by door once; the result is stored, and all three are read from it.
    """
    runs = accepted.select("run_id", "project_id")
    own = staged.join(runs, "run_id").select(*KEY, *FIELDS)
    parts = staged_items.join(runs, "run_id").select(*items.columns)
    any_ = runs.join(staged.select("run_id"), "run_id", "left_semi").select("project_id", F.lit(True).alias("_any")).distinct()
    doors = _by_door(old=openings.join(any_, "project_id", "left"), new=own, kept=items, parts=parts)
    comes, there = F.size("new") > 0, F.size("old") > 0
    same = _sign("parts", lambda q: F.coalesce(q, F.lit(1))) == _sign("kept", lambda q: q)
    doors = stored(doors.withColumn("action", F.when(comes & ~there, "added").when(comes & same, "unchanged").when(comes, "updated")))
    rows = doors.where(comes | there).select(*KEY, "action", F.explode_outer("old").alias("old"), "new").withColumn("new", F.explode_outer("new"))
    rows = rows.withColumn("action", F.coalesce("action", F.when(F.col("old._any") & F.col("old.is_active"), "removed")))
    new = F.col("new").isNotNull()
    taken = lambda f: F.coalesce(F.col(f"new.{f}"), F.lit(1)) if f == "leaf_count" else F.col(f"new.{f}")
    after = {c: F.col(c) if c in KEY else F.col(f"old.{c}") for c in openings.columns}
    after |= {f: F.when(new, taken(f)).otherwise(F.col(f"old.{f}")) for f in FIELDS}
    after["is_active"] = F.when(new, True).when(F.col("action") == "removed", False).otherwise(F.col("old.is_active"))
    of = lambda d, n: d.select(*KEY, F.explode(n).alias("r")).select(*(F.col(c) if c in KEY else F.col(f"r.{c}") for c in items.columns))
    written = doors.where("action IN ('added', 'updated')")
    left = doors.where("action IS NULL OR action <> 'updated'")
    count = lambda x: F.coalesce(F.sum((F.col("action") == x).cast("long")), F.lit(0)).alias("deactivated" if x == "removed" else x)
    counts = rows.where("action IS NOT NULL").groupBy("project_id").agg(*map(count, ("added", "updated", "unchanged", "removed")))
    counts = runs.join(counts, "project_id", "left").join(written.groupBy("project_id").agg(F.sum(F.size("parts")).alias("items_promoted")), "project_id", "left")
    return rows.select(*(x.alias(c) for c, x in after.items()), "action"), of(left, "kept").unionByName(of(written, "parts")), counts.fillna(0, ["added", "updated", "unchanged", "deactivated", "items_promoted"])


def _repeated(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["openings"].groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def _homeless(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["items"].join(tables["openings"].select(*KEY), KEY, "left_anti")


#: Rows that no version may have.
CHECKS = {"doors that a project has twice": _repeated, "items without an opening": _homeless}


def promote(spark: SparkSession, path: str, version: int, requests: DataFrame, runs: DataFrame, members: DataFrame, staged: DataFrame, staged_items: DataFrame, openings_schema, items_schema, buckets: int = versions.BUCKETS) -> bool:
    """Promotes runs into the versioned tables openings, items and promotions at path: all of them show at once, or none.

    Only buckets of the runs' projects are read and written. A version that breaks a check (a door twice in a run, say)
    raises versions.Refused and shows nothing; one that is out already is passed over (False).
    """
    outcome = decided(requests, runs, members, staged, staged_items).persist()
    try:
        touched = versions.with_bucket(outcome, ["project_id"], buckets).select("bucket").distinct().persist()
        old = [versions.current(spark, path, name, schema).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket") for name, schema in (("openings", openings_schema), ("items", items_schema))]
        accepted = outcome.where("error IS NULL")
        openings, items, counts = merged(*old, accepted, staged, staged_items)
        told = outcome.join(counts.drop("project_id"), "run_id", "left").withColumn("success", F.col("error").isNull())
        tables = {"openings": openings.drop("action"), "items": items, "promotions": told}
        return versions.publish(spark, path, version, {n: versions.with_bucket(t, ["project_id"], buckets) for n, t in tables.items()}, touched, CHECKS)
    finally:
        outcome.unpersist()
