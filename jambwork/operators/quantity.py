"""Quantities of sets brought down to an opening or a leaf, and the rows of openings that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jambwork.functions import text as T

#: Sources of a quantity that are final.
TERMINAL = ("divided", "flagged", "capped", "propagated", "auto_corrected")


def normalise(rows: DataFrame) -> DataFrame:
    """rows (qty, qty_source, divisor, most, is_hinge) with the quantity of one opening.

    A final quantity stays. One that needs division and divides is divided; a
    hinge's is rounded up; another is rounded and flagged. One that needs a cap
    is cut to `most`. Of hands that come both ways each is 1, and what needs a
    review is flagged as it is. What it was is kept as qty_total where it changes.
    """
    q, d = F.col("qty"), F.col("divisor")
    terminal = F.col("qty_source").isin(*TERMINAL)
    divides = ~terminal & (F.col("qty_source") == "needs_division") & (d > 1) & (q >= d)
    even, hinge = divides & (F.pmod(q, F.greatest(d, F.lit(1))) == 0), divides & F.col("is_hinge")
    cap = ~terminal & (F.col("qty_source") == "needs_cap") & (q > F.col("most"))
    hands, review = F.col("qty_source") == "rhr_lhr_pair", F.col("qty_source") == "needs_review"
    share = q / F.greatest(d, F.lit(1))
    new = F.when(hands, 1).when(even, share).when(hinge, F.ceil(share)).when(divides, F.floor(share + 0.5)).when(cap, F.col("most")).otherwise(q)
    source = F.when(even | hinge | hands, "divided").when(divides | review, "flagged").when(cap, "capped").otherwise(F.col("qty_source"))
    return rows.withColumns({"qty_total": F.when(divides | cap | hands, q), "qty_source": source, "qty": new.cast("long")})


def leaf_rows(items: DataFrame) -> DataFrame:
    """items (opening_id, leaf_count, kind, qty, electric) a row for each leaf that an item is on.

    On a pair, an electric hinge is on the active leaf; standard hinges are on
    both, less the electric ones on the active leaf; leaf items are on both;
    what belongs to the opening is shared. A quantity of 0 or null counts as 1.
    """
    qty = F.when(F.coalesce("qty", F.lit(0)) == 0, F.lit(1).cast("long")).otherwise(F.col("qty").cast("long"))
    row = lambda side, n: F.struct(F.lit(side).alias("leaf_side"), n.cast("long").alias("leaf_qty"))
    pair, electric = F.col("leaf_count") > 1, F.coalesce("electric", F.lit(0))
    spread = F.when(pair & (F.col("kind") == "electric_hinge"), F.array(row("active", qty))).when(pair & (F.col("kind") == "hinge"), F.array(row("active", qty - electric), row("inactive", qty))).when(pair & (F.col("kind") == "leaf"), F.array(row("active", qty), row("inactive", qty))).otherwise(F.array(row("shared", qty)))
    out = items.withColumn("_leaf", F.explode(spread))
    return out.select(*items.columns, "_leaf.leaf_side", "_leaf.leaf_qty")


def structural_rows(openings: DataFrame) -> DataFrame:
    """The rows of an opening's doors and frame, from its door type, frame type and leaves."""
    row = lambda name, side: F.struct(F.lit(name).alias("name"), F.lit(side).alias("leaf_side"))
    door = T.blank_to_null(F.col("door_type")).isNotNull()
    doors = F.when(door & (F.col("leaf_count") > 1), F.array(row("Door (Active Leaf)", "active"), row("Door (Inactive Leaf)", "inactive"))).when(door, F.array(row("Door", "shared")))
    frame = F.when(T.blank_to_null(F.col("frame_type")).isNotNull(), F.array(row("Frame", "shared")))
    none = F.array().cast("array<struct<name:string,leaf_side:string>>")
    out = openings.select("opening_id", F.posexplode(F.concat(F.coalesce(doors, none), F.coalesce(frame, none))).alias("sort_order", "r"))
    return out.select("opening_id", F.col("sort_order").cast("long"), "r.name", "r.leaf_side")


def propagate(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """A decided quantity for the same category in other sets, but where it is final; the old one is kept as qty_total."""
    rows = items.join(decisions.select("category", F.col("qty").alias("_q")), "category", "left")
    hit = F.col("_q").isNotNull() & ~F.col("qty_source").isin("divided", "auto_corrected") & (F.col("qty") != F.col("_q"))
    return rows.withColumns({"qty_total": F.when(hit, F.col("qty")), "qty_source": F.when(hit, "propagated").otherwise(F.col("qty_source")), "qty": F.when(hit, F.col("_q")).otherwise(F.col("qty"))}).drop("_q")


#: Phrases that say that quantities are those of one opening, and how a total and an opening's quantity are written.
PREAMBLES = r"(?i)each\s+opening\s+to\s+have\s*:|each\s+to\s+receive\s*:|each\s+to\s+have\s*:|each\s+door\s+leaf\s+shall\s+have\s*:|each\s+door\s+to\s+have\s*:|per\s+opening\s*:"
DUAL = r"(?i)\(([0-9]+)\)\s*([0-9]+)\s*EA\b"


def convention(text: Column, door_count: Column) -> Column:
    """per_opening by a phrase or by quantities written twice; aggregate if there are more doors than one, and of two quantities or more at lines' begins over 0.6 exceed 6; else unknown."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*[0-9]{1,3}\s+\S") & ~x.rlike(r"(?i)^\s*[0-9]{1,3}\s+(SGL|PRA/PRI|PR|Pair)\s+(Door|Opening)"))
    numbers = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*([0-9]{1,3})", 1).cast("int"))
    many = (F.size(numbers) >= 2) & (5 * F.size(F.filter(numbers, lambda n: n > 6)) > 3 * F.size(numbers))
    return F.when(text.rlike(PREAMBLES) | text.rlike(DUAL), "per_opening").when((door_count > 1) & many, "aggregate").otherwise("unknown")


def dual_quantities(text: Column) -> Column:
    """(total, each) of every pair that is written as such."""
    one, two = (F.regexp_extract_all(text, F.lit(DUAL), F.lit(k)) for k in (1, 2))
    return F.zip_with(one, two, lambda a, b: F.struct(a.cast("int").alias("total"), b.cast("int").alias("each")))


def heading_totals(sets: DataFrame, doors: DataFrame) -> DataFrame:
    """By generic id the doors and leaves that its sets' headings (set_id, generic_id, heading_doors, heading_leaves) say; where they say none, those of the openings (hw_set, leaf_count)."""
    said = sets.groupBy(F.upper(F.coalesce("generic_id", "set_id")).alias("id")).agg(F.sum("heading_doors").alias("d"), F.sum("heading_leaves").alias("l"))
    own = doors.groupBy(F.upper("hw_set").alias("id")).agg(F.count("*").alias("od"), F.sum(F.coalesce("leaf_count", F.lit(1))).alias("ol"))
    rows = said.join(own, "id", "left")
    pick = lambda a, b: F.when(F.col(a) > 0, F.col(a)).otherwise(F.coalesce(b, F.lit(0))).cast("long")
    return rows.select("id", pick("d", "od").alias("doors"), pick("l", "ol").alias("leaves"))


def leaves_of_types(doors: DataFrame, by: str) -> DataFrame:
    """By a column of doors (door_type): doors, and leaves by their type: two of a pair."""
    pair = F.col("door_type").rlike(r"(?i)\b(pair|pr)\b")
    return doors.groupBy(F.upper(F.trim(by)).alias(by)).agg(F.count("*").alias("doors"), F.sum(F.when(pair, 2).otherwise(1)).alias("leaves"))


def counted_across(sets: DataFrame, doors: DataFrame) -> DataFrame:
    """For each set how many doors name it by their heading or set, or begin with its id: a door's prefixes are listed, and meet by equality."""
    def prefixes(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.upper(F.substr(c, F.lit(1), i)))

    keys = F.array_distinct(F.concat(prefixes(F.col("hw_heading")), prefixes(F.col("hw_set"))))
    met = doors.select(F.explode(keys).alias("k")).groupBy("k").count()
    return sets.join(met, F.upper("set_id") == F.col("k"), "left").select("set_id", F.coalesce("count", F.lit(0)).alias("doors"))


def rendered(items: DataFrame) -> DataFrame:
    """items (leaf_count, leaf_side, place) a row for each group of the view that shows them: shared, leaf1 or leaf2.

    A stored side wins, but on a single door what is of an inactive leaf is not shown; else the place of the item's category decides.
    """
    one = F.col("leaf_count") <= 1
    side = F.when(F.col("leaf_side").isin("active", "inactive", "shared"), F.col("leaf_side"))
    groups = F.when(one & (side == "inactive"), F.array().cast("array<string>")).when(one & (side == "shared"), F.array(F.lit("shared"))).when(one, F.array(F.lit("leaf1")))
    groups = groups.when(side == "active", F.array(F.lit("leaf1"))).when(side == "inactive", F.array(F.lit("leaf2"))).when(side == "shared", F.array(F.lit("shared")))
    groups = groups.when(F.col("place") == "active", F.array(F.lit("leaf1"))).when(F.col("place") == "inactive", F.array(F.lit("leaf2"))).when(F.col("place") == "shared", F.array(F.lit("shared"))).otherwise(F.array(F.lit("leaf1"), F.lit("leaf2")))
    return items.withColumn("group", F.explode(groups))
