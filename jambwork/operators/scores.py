"""Scores of extracted openings and sets: fields, review levels, issues, health, confidence, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators.rollups import count_if

#: What a field's text has to look like, and the fields that are scored.
PATTERNS = {
    "door_number": r"^\d{2,4}[A-Za-z]?(-\d{1,3}[A-Za-z]?)?$", "hw_set": r"(?i)^(DH|HW|HS|SET)\s?\d{1,4}[A-Za-z]?$", "fire_rating": r"(?i)^(20|45|60|90|180)\s*MIN(UTE)?S?$|^N/?R$|^(1|1\.5|2|3)\s*H(?:OU)?RS?$",
    "hand": r"(?i)^(LH|RH|LHR|RHR|LHRA|RHRA|N/A)$", "door_type": r"(?i)^(WD|HM|AL|GL|FRP|PR|PAIR|SGL|DBL)$", "frame_type": r"(?i)^(WD|HM|AL|KD|WELD|DRYWALL)$",
}
SCORED = ["door_number", "hw_set", "location", "door_type", "frame_type", "fire_rating", "hand"]
PRESENT, FITS, KNOWN, COMPLETE = 0.40, 0.25, 0.10, 0.25


def filled(c: str) -> Column:
    return T.blank_to_null(F.col(c).cast("string")).isNotNull()


def field_scores(doors: DataFrame, known_format: bool = False) -> DataFrame:
    """doors with `<field>_score` of each scored field: present, fitting its pattern, of a known format, and of a complete door."""
    complete = reduce(lambda a, b: a + b, (filled(c).cast("int") for c in SCORED)) / len(SCORED)

    def score(c: str) -> Column:
        fits = F.when(~filled(c), 0.0).when(F.trim(c).rlike(PATTERNS[c]), 1.0).otherwise(0.3) if c in PATTERNS else F.lit(0.5)
        return PRESENT * filled(c).cast("int") + FITS * fits + KNOWN * float(known_format) + COMPLETE * complete

    return doors.withColumns({f"{c}_score": F.round(score(c), 6) for c in SCORED})


def average_score(scored: DataFrame) -> DataFrame:
    return scored.agg(F.round(F.sum(reduce(lambda a, b: a + b, (F.col(f"{c}_score") for c in SCORED))) / (F.count("*") * len(SCORED)), 6).alias("average"), F.count("*").alias("doors"))


#: The issues of missing fields, with their severity.
MISSING = {"door_number": "high", "hw_set": "high", "location": "soft", "fire_rating": "med", "hand": "med", "door_type": "soft", "frame_type": "soft"}


def door_issues(doors: DataFrame) -> DataFrame:
    """doors with `issues` (of missing fields, then of fields whose confidence is below 0.6) and the review `level`."""
    blank = lambda c: ~filled(c) | (F.trim("hw_set") == "N/A") if c == "hw_set" else ~filled(c)
    missing = F.array_compact(F.array(*(F.when(blank(c), F.lit(f"missing_{c}")) for c in MISSING)))
    low = F.map_keys(F.map_filter("field_confidence", lambda k, v: v < 0.6))
    low = F.array_sort(F.coalesce(F.transform(low, lambda k: F.concat(F.lit("low_confidence_"), k)), F.array().cast("array<string>")))
    optional = F.size(F.filter(missing, lambda x: ~x.isin("missing_door_number", "missing_hw_set")))
    level = F.when(blank("hw_set") | blank("door_number"), "low").when((F.size(low) > 0) | (optional >= 3), "medium").otherwise("high")
    return doors.withColumn("issues", F.concat(missing, low)).withColumn("level", level)


def issue_groups(doors: DataFrame) -> DataFrame:
    """(issue, severity, place, doors, sets): groups of doors with an issue, the severest first, then the largest, then by name."""
    rows = doors.select("hw_set", F.explode("issues").alias("issue"))
    severity = reduce(lambda c, x: c.when(F.col("issue") == f"missing_{x[0]}", x[1]), MISSING.items(), F.when(F.lit(False), "")).otherwise("med")
    groups = rows.groupBy("issue").agg(F.count("*").alias("doors"), F.count_distinct(T.blank_to_null(F.col("hw_set"))).alias("sets")).withColumn("severity", severity)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "med", 1).otherwise(2)
    return groups.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("doors"), "issue")).cast("long"))  # a row for each kind of issue


def health(doors: DataFrame, sets: DataFrame) -> DataFrame:
    """By job: items, empty and filled sets, assigned doors, sets that doors name but nobody extracted, the grade, and the set with most items (the first on a tie).

    doors (job, hw_set), sets (job, set_id, generic_id, items, pos).
    """
    of = sets.groupBy("job").agg(F.sum("items").alias("items"), count_if(F.col("items") == 0).alias("empty_sets"), count_if(F.col("items") > 0).alias("filled_sets"), F.max_by(F.when(F.col("items") > 0, F.col("set_id")), F.struct("items", -F.col("pos"))).alias("best"))
    named = doors.where(F.coalesce(F.col("hw_set"), F.lit("")) != "").select("job", F.upper("hw_set").alias("id")).distinct()
    missing = named.join(sets.select("job", F.upper(F.coalesce("generic_id", "set_id")).alias("id")), ["job", "id"], "left_anti").groupBy("job").agg(F.count("*").alias("missing_sets"))
    own = doors.groupBy("job").agg(F.count("*").alias("doors"), count_if(filled("hw_set")).alias("assigned"))
    rows = own.join(of, "job", "full_outer").join(missing, "job", "left").na.fill(0)
    grade = F.when((F.col("items") == 0) | (F.col("filled_sets") == 0), "critical").when((F.col("empty_sets") > 0) | (F.col("missing_sets") > 0), "warning").otherwise("good")
    return rows.withColumn("grade", grade)


def confidence(rows: DataFrame) -> DataFrame:
    """rows (items, empty_fields, corrections, fuzzy, sets, statistical, empty_sets, doors, unmatched) with `score` of 100 and `overall`.

    Less for empty fields, corrections, fuzzy ones, guessed quantities, unmatched doors and empty sets; more for no correction.
    More than half of the corrections fuzzy, or a fifth of the items corrected, is low whatever the score.
    """
    share = lambda a, b, most: F.when(F.col(b) > 0, F.floor(F.col(a) / F.greatest(F.col(b), F.lit(1)) * most + 0.5)).otherwise(0)
    score = 100 - share("empty_fields", "items", 30) - F.least(F.lit(20), share("corrections", "items", 20)) - F.least(F.lit(10), share("fuzzy", "corrections", 10)) - share("statistical", "sets", 10) - share("unmatched", "doors", 15) - share("empty_sets", "sets", 15)
    score = F.when(F.col("corrections") == 0, F.least(F.lit(100), score + 5)).otherwise(score)
    deep = ((F.col("corrections") > 0) & (2 * F.col("fuzzy") > F.col("corrections"))) | ((F.col("items") > 0) & (5 * F.col("corrections") > F.col("items")))
    out = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("long"))
    return out.withColumn("overall", F.when(deep, "low").when(F.col("score") >= 80, "high").when(F.col("score") >= 50, "medium").otherwise("low"))


def sample(doors: DataFrame, most: int = 15) -> DataFrame:
    """At most so many doors of each job, by `turn`: the best of each set (pairs, then most items, then first), then other pairs, then by items.

    doors (job, hw_set, leaf_count, items, pos). Each job's doors are ranked twice within windows over it.
    """
    pair = F.coalesce(F.col("leaf_count"), F.lit(1)) > 1
    best = F.row_number().over(Window.partitionBy("job", "hw_set").orderBy(F.desc(pair), F.desc("items"), "pos"))
    seen = F.min("pos").over(Window.partitionBy("job", "hw_set"))
    rows = doors.withColumn("_best", best).withColumn("_seen", seen)
    phase = F.when(F.col("_best") == 1, 0).when(pair, 1).otherwise(2)
    order = Window.partitionBy("job").orderBy(phase, F.when(phase == 0, F.col("_seen")), F.when(phase == 2, -F.col("items")), "pos")
    return rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most).drop("_best", "_seen")


def audit(doors: DataFrame, sets: DataFrame) -> DataFrame:
    """By set (set_id, generic_id, door_count): doors emitted under its own id, else under its generic one, else 0, and the difference to what its heading says."""
    count = doors.groupBy(F.upper(F.trim("hw_set")).alias("k")).count()
    one, two = (count.select(F.col("k").alias(f"k{i}"), F.col("count").alias(f"n{i}")) for i in (1, 2))
    rows = sets.join(one, F.upper("set_id") == F.col("k1"), "left").join(two, F.upper("generic_id") == F.col("k2"), "left")
    return rows.select("set_id", "generic_id", "door_count", F.coalesce("n1", "n2", F.lit(0)).cast("long").alias("emitted")).withColumn("missing", F.greatest(F.col("door_count") - F.col("emitted"), F.lit(0)).cast("long"))
