"""What the quantities of sets are divided by, and where that number comes from.

A cascade: doors and leaves that a set's heading says; else those of the openings that
name its id as their heading; else those that name its generic id as their set; else
those whose heading or set begins with its id but for case, spaces and hyphens. What
the openings say is counted by name first; sets meet the names of all tiers in one
equi-join, the first tier that has any counts, and `origin` says which one it was.
Items keep their quantity: qty_source says what is to be done with it.

Sets, items and openings belong to a project (`by`). Sets without an id, doors or
openings have no divisor; null quantities are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.operators import linkage
from jambwork.sources.sinks import stored

HANDED = r"(?i)\b(RHR|LHR|RH|LH)\b"
#: Origins but for headings and none, the first first.
ORIGINS = ("opening", "generic", "crossed")


def _id(value: Column) -> Column:
    return F.upper(T.blank_to_null(F.trim(value)))


def divisors(sets: DataFrame, openings: DataFrame, by: str, *more: str) -> DataFrame:
    """by, set_id, doors, leaves, origin (heading, opening, generic, crossed, none) and more columns of each set.

    sets: by, set_id (distinct in it), generic_id, heading_doors, heading_leaves; openings: by, hw_heading, hw_set, leaf_count.
    """
    own = stored(sets.where("set_id is not null").select(by, "set_id", "generic_id", "heading_doors", "heading_leaves", *more))
    openings = stored(openings.select(by, "hw_heading", "hw_set", "leaf_count"))
    said = F.coalesce(F.col("heading_doors") > 0, F.lit(False))
    generic = F.coalesce(T.blank_to_null(F.trim("generic_id")), F.col("set_id"))
    left = own.where(~said).select(by, "set_id", _id(F.col("set_id")).alias("_opening"), _id(generic).alias("_generic"), T.set_key(F.col("set_id")).alias("_crossed"))
    bare = lambda c: F.regexp_replace(c, linkage.SUFFIX, "")
    ids, generics, plain = linkage.lengths(left, bare("_opening"), bare("_generic"), F.nullif("_crossed", F.lit("")))
    headings, named = linkage.lengths(openings, _id(F.col("hw_heading")), _id(F.col("hw_set")))

    name = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    crossed = F.array_distinct(F.concat(*(linkage.begins(T.set_key(F.coalesce(c, F.lit(""))), plain) for c in ("hw_heading", "hw_set"))))
    names = F.concat(F.array(name(0, _id(F.col("hw_heading"))), name(1, _id(F.col("hw_set")))), F.transform(crossed, lambda x: name(2, x)))
    known = openings.select(by, "leaf_count", F.inline(names)).where("name is not null").groupBy(by, "kind", "name").agg(F.count("*").alias("doors"), F.sum("leaf_count").cast("long").alias("leaves"))
    at = F.when(F.col("kind") == 0, linkage.offered(F.col("name"), ids, 0)).when(F.col("kind") == 1, linkage.offered(F.col("name"), generics, 1)).otherwise(linkage.offered(F.col("name"), [], 2))
    asks = F.concat(linkage.asked(F.col("_opening"), headings, 0), linkage.asked(F.col("_generic"), named, 1), linkage.asked(F.col("_crossed"), plain, 2))
    asks = F.filter(asks, lambda x: (x["side"] < 4) | (x["tier"] == 1))  # crossed names are beginnings already
    met = left.select(by, "set_id", F.inline(asks)).join(known.select(by, "kind", "name", "doors", "leaves", F.inline(at)), [by, "side", "meet"])
    best = met.groupBy(by, "set_id").agg(F.min(F.struct("kind", "tier", -F.length("name"), "name", "doors", "leaves")).alias("_m"))
    m, none = F.col("_m"), F.lit(0).cast("long")
    return own.join(best, [by, "set_id"], "left").select(
        by, "set_id", F.when(said, F.col("heading_doors").cast("long")).otherwise(F.coalesce(m["doors"], none)).alias("doors"),
        F.when(said, F.col("heading_leaves").cast("long")).when(m.isNotNull(), m["leaves"]).otherwise(F.coalesce(F.col("heading_leaves").cast("long"), none)).alias("leaves"),
        F.when(said, "heading").otherwise(F.coalesce(F.get(F.array(*map(F.lit, ORIGINS)), m["kind"]), F.lit("none"))).alias("origin"), *more,
    )


def annotated(items: DataFrame, sets: DataFrame, openings: DataFrame, by: str) -> DataFrame:
    """items with origin, category, qty_source, qty_total and divisor. items: by, set_id, pos, name, model, qty; sets: as for divisors, and convention.

    parsed: an opening's already, by the set's convention or because it is less than the divisor. needs_cap: of a set
    with one door and one leaf at most, more than its category ever has. needs_division: by leaves where the category is
    on leaves and they are known, else by doors. Of these, hands that come both ways are rhr_lhr_pair, and closers
    beside an automatic operator needs_review.
    """
    bare = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), HANDED, "")))
    hand = F.upper(F.substring(F.regexp_extract(F.concat_ws(" ", "name", "model"), HANDED, 1), 1, 2))
    alike, own = Window.partitionBy(by, "set_id", bare(F.col("name")), bare(F.col("model"))), Window.partitionBy(by, "set_id")
    # before the join, where rows are short, and the finer window first: its order is that of the other and of the join
    rows = items.withColumn("category", C.set_category(F.col("name"))).withColumn("_both", F.size(F.collect_set(F.when(hand != "", hand)).over(alike)) >= 2)
    rows = rows.withColumn("_operator", F.max(F.coalesce(F.col("category") == "auto_operator", F.lit(False))).over(own))
    rows = rows.join(divisors(sets, openings, by, "convention"), [by, "set_id"])
    rows = rows.withColumns({"_most": C.most_of(F.col("category")), "_pref": C.preference(F.col("category"))})
    q, doors, leaves = F.col("qty"), F.col("doors"), F.col("leaves")
    divisor = F.when((F.col("_pref") == "leaf") & (leaves > 1), leaves).when(doors > 1, doors)
    each, single = (F.col("convention") == "per_opening") & (doors > 1), (doors <= 1) & (leaves <= 1)
    capped, divides = single & (q > F.col("_most")), ~each & ~single & (divisor > 1) & (q >= divisor)
    few = q < F.coalesce(divisor, F.lit(2))
    none = F.lit(None).cast("long")
    rows = rows.withColumns({
        "qty_source": F.when(F.coalesce(capped & ~each, F.lit(False)), "needs_cap").when(F.coalesce(divides, F.lit(False)), "needs_division").otherwise("parsed"),
        "qty_total": F.when(single & ~each & ~F.coalesce(capped, F.lit(False)), none).otherwise(q.cast("long")),
        "divisor": F.when(each, doors).when(single, none).when(F.coalesce(divides, F.lit(False)), divisor).when(F.coalesce(few, F.lit(False)), F.coalesce(divisor, F.nullif(doors, F.lit(0)))).otherwise(none),
    })
    asked = F.col("qty_source") == "needs_division"
    source = F.when(asked & F.col("_both"), "rhr_lhr_pair").when(asked & F.col("_operator") & (F.col("category") == "closer"), "needs_review").otherwise(F.col("qty_source"))
    return rows.withColumn("qty_source", source).drop("_most", "_pref", "_both", "_operator", "convention")
