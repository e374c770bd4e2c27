"""Rules on openings and their items. Each gives (rule, severity, opening_id) of what breaks it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.operators import sets as S
from jambwork.operators.rollups import count_if

RATING = r"(?i)^[0-9]+\s*(min|hr|hour|minute)|^NR$|^UL$"
DOOR, FRAME = r"^Door(\s|$|\()", "^Frame$"


def violations(openings: DataFrame, items: DataFrame) -> DataFrame:
    """The rules on an opening's rows: openings (opening_id, leaf_count, location, hand), items (opening_id, name, model, leaf_side, qty).

    Items are summed by opening before the one join; a rule that several items of an opening break is one row.
    """
    is_ = lambda p: F.col("name").rlike(p)
    item_hand = T.hand(F.concat_ws(" ", "name", "model"))
    of = items.groupBy("opening_id").agg(
        count_if(is_(DOOR)).alias("doors"), count_if(is_(FRAME)).alias("frames"), count_if(F.col("name") == "Door").alias("plain"),
        count_if(F.col("name") == "Door (Active Leaf)").alias("active"), count_if(F.col("name") == "Door (Inactive Leaf)").alias("other"),
        count_if(F.col("leaf_side") == "inactive").alias("inactive"), F.bool_or(item_hand == "RH").alias("right"), F.bool_or(item_hand == "LH").alias("left"),
    )
    rows = openings.select("opening_id", "leaf_count", "location", T.hand(F.col("hand")).alias("own_hand")).join(of, "opening_id", "left")
    one, pair = F.col("leaf_count") == 1, F.col("leaf_count") == 2
    n = lambda c: F.coalesce(c, F.lit(0))
    leaves = (n("doors") != 2) | (n("active") != 1) | (n("other") != 1)
    rules: list[tuple[str, str, Column]] = [
        ("too_many_doors", "blocker", n("doors") > 2),
        ("conflicting_door_variants", "blocker", (n("plain") > 0) & (n("active") + n("other") > 0)),
        ("too_many_frames", "blocker", n("frames") > 1),
        ("single_leaf_door_count_mismatch", "blocker", one & (n("doors") > 1)),
        ("pair_leaf_door_count_mismatch", "blocker", pair & (n("doors") > 0) & leaves),
        ("location_matches_fire_rating", "warning", F.trim("location").rlike(RATING)),
        ("leaf_count_consistency", "blocker", (F.col("leaf_count") < 2) & (n("inactive") > 0)),
        ("handing_consistency", "blocker", one & (((F.col("own_hand") == "RH") & F.col("left")) | ((F.col("own_hand") == "LH") & F.col("right")))),
    ]
    broken = F.array(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"))) for r, s, c in rules))
    return rows.select("opening_id", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("v")).select("v.rule", "v.severity", "opening_id")


def leaf_violations(openings: DataFrame, items: DataFrame) -> DataFrame:
    """The rules on items of pairs by name: sums of both leaves' quantities outside of their band, and hinges twice on a leaf; a row for each name."""
    pairs = openings.where("leaf_count = 2").select("opening_id")
    own = items.where(~F.coalesce(F.col("name").rlike(DOOR) | F.col("name").rlike(FRAME) | (F.col("name") == ""), F.lit(True))).join(pairs, "opening_id", "left_semi")
    own = S.per_distinct(own, ["name", "model"], scope=C.scope(F.col("name"), F.col("model")), kind=C.category(F.col("name"), F.col("model")))
    # kinds are judged after the grouping, so that they are worked out for distinct names only
    qty = F.coalesce("qty", F.lit(0))
    by_leaf = own.where("scope = 'per_leaf'").groupBy("opening_id", "name").agg(F.bool_or(F.col("leaf_side") == "active").alias("a"), F.bool_or(F.col("leaf_side") == "inactive").alias("i"), F.max(qty).alias("most"), F.sum(qty).alias("sum"))
    band = (F.col("sum") < F.col("most")) | (F.col("sum") > 2 * F.col("most"))
    sums = by_leaf.where(F.col("a") & F.col("i") & band).select(F.lit("per_leaf_qty_sum_mismatch").alias("rule"), "opening_id", "name")
    key = [F.lower(F.trim("name")).alias("name"), F.lower(F.trim(F.coalesce("model", F.lit("")))).alias("model"), F.coalesce("leaf_side", F.lit("unknown")).alias("side")]
    hinges = own.groupBy("opening_id", *key).agg(F.count("*").alias("n"), F.max("kind").alias("kind")).where((F.col("n") > 1) & (F.col("kind") == "hinges")).select(F.lit("pair_leaf_hinge_duplication").alias("rule"), "opening_id", "name")
    return sums.unionByName(hinges).withColumn("severity", F.lit("warning"))


def heading_mismatches(openings: DataFrame, sets: DataFrame) -> DataFrame:
    """Openings that have the generic set although their door is listed under a specific one: sets (set_id, generic_id, heading_doors); of doors with one key the last opening counts."""
    doors = sets.where((F.col("generic_id") != F.col("set_id")) & (F.col("generic_id") != "")).select("set_id", "generic_id", F.explode("heading_doors").alias("d"))
    of = openings.groupBy(T.door_key(F.col("door_number")).alias("k")).agg(F.max_by(F.struct("opening_id", "hw_set"), "opening_id").alias("o"))
    met = doors.withColumn("k", T.door_key(F.col("d"))).join(of, "k").where(F.col("o.hw_set") == F.col("generic_id"))
    return met.select(F.lit("heading_door_set_mismatch").alias("rule"), F.lit("blocker").alias("severity"), "o.opening_id", "set_id")


def hand_filtered(items: DataFrame, openings: DataFrame) -> DataFrame:
    """items with `fate`: dropped if the hand of name and model contradicts that of their single opening; kept as unknown_hand, pair, no_opening, any_hand or same_hand."""
    own, item = T.hand(F.col("_hand")), T.hand(F.concat_ws(" ", "name", "model"))
    rows = items.join(openings.select("opening_id", F.col("hand").alias("_hand"), F.coalesce("leaf_count", F.lit(1)).alias("_leaves")), "opening_id", "left")
    fate = F.when(F.col("_leaves").isNull(), "no_opening").when(F.col("_leaves") >= 2, "pair").when(own.isNull(), "unknown_hand").when(item.isNull(), "any_hand").when(item == own, "same_hand").otherwise("dropped")
    return rows.withColumn("fate", fate).drop("_hand", "_leaves")


def consolidated(items: DataFrame, openings: DataFrame) -> DataFrame:
    """items of pairs without the smaller of two standard hinge rows of one name and model whose quantities differ by the opening's electric hinges; of equal rows none goes."""
    rows = S.per_distinct(items, ["name", "model"], _kind=C.category(F.col("name"), F.col("model")))
    electric = rows.groupBy("opening_id").agg(F.sum(F.when((F.col("_kind") == "electric_hinge") & F.col("leaf_side").isNull(), F.col("qty"))).alias("_e")).where("_e > 0").join(openings.where("leaf_count > 1").select("opening_id"), "opening_id", "left_semi")
    q = F.coalesce("qty", F.lit(0))
    key = ["opening_id", F.lower(F.trim("name")).alias("_n"), F.lower(F.trim(F.coalesce("model", F.lit("")))).alias("_m")]
    twice = rows.groupBy(*key).agg(F.count("*").alias("c"), F.max("_kind").alias("k"), F.max(q).alias("hi"), F.min(F.struct(q.alias("q"), F.col("pos"))).alias("lo")).where("c = 2 AND k = 'hinges'")
    gone = twice.join(electric, "opening_id").where(F.col("hi") - F.col("lo.q") == F.col("_e")).select("opening_id", F.col("lo.pos").alias("pos"))
    return rows.drop("_kind").join(gone, ["opening_id", "pos"], "left_anti")


def grouped(found: DataFrame, samples: int = 10) -> DataFrame:
    """Violations by rule, blockers first by `rank`, with the first openings as samples: Spark limits each rule's rows before it moves them."""
    counts = found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.min("opening_id").alias("first"))
    place = F.row_number().over(Window.partitionBy("rule").orderBy("opening_id"))
    some = found.select("rule", "opening_id").withColumn("_p", place).where(F.col("_p") <= samples).groupBy("rule").agg(F.array_sort(F.collect_list("opening_id")).alias("ids"))
    rank = F.when(F.col("severity") == "blocker", 0).otherwise(1)
    return counts.join(some, "rule").select("rule", "severity", rank.alias("rank"), "n", "first", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("samples"))


def check(rows: DataFrame, name: str, ok: Column) -> DataFrame:
    """rows, or an error that names the first broken precondition when they are read."""
    return rows.withColumn("_ok", F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"precondition failed: {name}")))).where("_ok").drop("_ok")


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
