"""List views: filters that are optional, searches, counts with totals, facets, buckets and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators.rollups import STAGES, count_if

#: Statuses that an issue can go to from each status.
TRANSITIONS = {
    "created": ["acknowledged", "duplicate", "closed"],
    "acknowledged": ["awaiting_action", "blocked", "resolved", "duplicate", "closed"],
    "awaiting_action": ["blocked", "resolved", "duplicate", "closed"],
    "blocked": ["awaiting_action", "resolved", "closed"],
    "resolved": ["closed"], "duplicate": [], "closed": [],
}


def filtered(rows: DataFrame, equal: dict[str, str | None], any_of: dict[str, tuple[str | None, list[str]]]) -> DataFrame:
    """Rows that meet every filter that is given; a list's values outside its vocabulary are passed over, and a list without any filters nothing."""
    tests: list[Column] = [F.col(c) == v for c, v in equal.items() if v]
    for c, (values, known) in any_of.items():
        wanted = [x for x in (v.strip() for v in (values or "").split(",")) if x in known]
        tests += [F.col(c).isin(wanted)] if wanted else []
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


def found(rows: DataFrame, wanted: str, columns: list[str]) -> DataFrame:
    """Rows of which some column holds the wanted text, case aside."""
    return rows.where(reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).contains(wanted.lower()), F.lit(False)) for c in columns)))


def flagged(rows: DataFrame, tags: str, resolved: str) -> DataFrame:
    """Rows with some tag that aren't resolved."""
    return rows.where((F.size(tags) > 0) & F.col(resolved).isNull())


def listed(openings: DataFrame, items: DataFrame) -> DataFrame:
    """Every opening, active or not, with its items, checked ones, and items at each known stage."""
    own = items.groupBy("opening_id").agg(
        F.count("*").alias("total_items"), count_if(F.col("checked")).alias("checked_items"), count_if(F.col("checked").isNotNull()).alias("total_checklist"),
        *(count_if(F.col("stage") == s).alias(s) for s in STAGES[1:]),
    )
    zero = [c for c in own.columns if c != "opening_id"]
    return openings.join(own, "opening_id", "left").select(*openings.columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero))


def with_counts(rows: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """Rows with the number of each kind of children, and the number of all rows."""
    total = rows.groupBy().agg(F.count("*").alias("total"))
    for name, df in children.items():
        rows = rows.join(df.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return rows.join(F.broadcast(total))  # one row


def nested_twice(parents: DataFrame, children: DataFrame, grandchildren: DataFrame, key: str, child: str) -> DataFrame:
    """Parents with their children, each with its own children, as ordered arrays, empty where there are none."""
    own = [c for c in grandchildren.columns if c not in (key, child)]
    inner = grandchildren.groupBy(key, child).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("own"))
    both = children.join(inner, [key, child], "left").withColumn("own", F.coalesce("own", F.array().cast(inner.schema["own"].dataType)))
    outer = both.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(child, "own"))).alias("children"))
    return parents.join(outer, key, "left").withColumn("children", F.coalesce("children", F.array().cast(outer.schema["children"].dataType)))


def filled_from(rows: DataFrame, donors: DataFrame, key: str, column: str) -> DataFrame:
    """Rows whose column is null take the donor's value."""
    return rows.join(donors.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value) of the distinct filled values of some columns, in one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))
    return rows.select(F.explode(pairs).alias("p")).where(T.blank_to_null(F.col("p.value")).isNotNull()).select("p.facet", "p.value").distinct()


def numeric_last(column: Column, sentinel: str = "Unassigned") -> tuple[Column, Column]:
    """Sorts numbers by value, and a sentinel after them."""
    return column == sentinel, F.when(column != sentinel, column.cast("double"))


def natural_key(column: Column) -> Column:
    """An array that sorts like its column with runs of digits as numbers, of any length: for each run (whether it is no number, how many digits, the run in lower case)."""
    runs = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("([0-9]+|[^0-9]+)"))

    def run(x: Column) -> Column:
        digits = x.rlike("^[0-9]")
        plain = F.when(digits, F.regexp_replace(x, "^0+(?=.)", "")).otherwise(F.lower(x))
        return F.struct((~digits).alias("word"), F.when(digits, F.length(plain)).otherwise(0).alias("size"), plain.alias("run"))

    return F.transform(runs, run)


def legal(before: Column, after: Column) -> Column:
    """Whether an issue may go from one status to another; from an unknown one it may not."""
    known = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return F.coalesce(F.array_contains(known[before], after), F.lit(False))


def overdue(due: Column, status: Column, as_of: str) -> Column:
    return F.coalesce((due < F.lit(as_of).cast("timestamp_ntz")) & ~status.isin("resolved", "closed", "duplicate"), F.lit(False))


def buckets(rows: DataFrame, column: str, fixed: list[str], *order: str) -> DataFrame:
    """(column, ids): the ordered rows of each fixed value, empty ones too; other values are left out."""
    spark = rows.sparkSession
    known = spark.range(len(fixed)).select(F.element_at(F.array(*map(F.lit, fixed)), (F.col("id") + 1).cast("int")).alias(column))
    counts = rows.where(F.col(column).isin(fixed)).groupBy(column).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last"))
    return known.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def labelled(rows: DataFrame, *labels: tuple[str, DataFrame, str]) -> DataFrame:
    """Rows with the label of each (key column, labels (key, label), name): null where there is none."""
    for key, df, name in labels:
        rows = rows.join(df.select(F.col("key").alias(key), F.col("label").alias(name)), key, "left")
    return rows


def first_page(sets: DataFrame, pages: DataFrame) -> DataFrame:
    """For each set (set_id, generic_id) the first page whose ids hold its generic id, else its own id, case aside."""
    each = pages.select("page", F.explode("ids").alias("id")).groupBy(F.upper("id").alias("id")).agg(F.min("page").alias("page"))
    one = each.select(F.col("id").alias("_g"), F.col("page").alias("_p1"))
    two = each.select(F.col("id").alias("_s"), F.col("page").alias("_p2"))
    out = sets.join(one, F.upper("generic_id") == F.col("_g"), "left").join(two, F.upper("set_id") == F.col("_s"), "left")
    return out.select("set_id", "generic_id", F.coalesce("_p1", "_p2").alias("page"))


def undefined_sets(doors: DataFrame, sets: DataFrame) -> DataFrame:
    """Doors whose set isn't defined: not blank, not by others."""
    own = doors.where(T.blank_to_null(F.col("hw_set")).isNotNull() & ~F.coalesce("by_others", F.lit(False)))
    return own.withColumn("_k", F.upper(F.trim("hw_set"))).join(sets.select(F.upper(F.trim("set_id")).alias("_k")), "_k", "left_anti").drop("_k")


def triaged(doors: DataFrame, classes: DataFrame) -> DataFrame:
    """Doors that aren't classified, or as a door by their first classification (door_key, class, pos)."""
    first = classes.groupBy("door_key").agg(F.min_by("class", "pos").alias("_class"))
    return doors.join(first, "door_key", "left").where(F.coalesce(F.col("_class") == "door", F.lit(True))).drop("_class")


def hand_variants(items: DataFrame) -> DataFrame:
    """Items of a set that come in both hands: (set_id, base, items) where name and model but for hand tokens are alike and two hands and more occur."""
    text = F.concat_ws(" ", "name", "model")
    token = r"(?i)\b(RHRA|LHRA|RHR|LHR|RH|LH)\b"
    base = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), token, " "), r"\s+", " "))
    rows = items.select("set_id", base.alias("base"), F.upper(F.regexp_extract(text, token, 1)).alias("hand"))
    by = rows.groupBy("set_id", "base").agg(F.count("*").alias("items"), F.collect_set(F.when(F.col("hand") != "", F.col("hand"))).alias("hands"))
    return by.where(F.size("hands") >= 2).select("set_id", "base", "items", F.array_join(F.array_sort("hands"), ",").alias("hands"))


def ranked_by(rows: DataFrame, by: list[str], most: int, *order: Column) -> DataFrame:
    """The first rows of each group, with their place; Spark limits groups before it moves them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
