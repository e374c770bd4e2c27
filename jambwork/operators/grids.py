"""Tables found by what their cells hold.

A grid is rows (table_id, row, col, cell), with rows and columns from 0. Validators
look at a bounded number of rows below a header; all columns and fields are counted
in one aggregation by table, header and column, so that a table's cells are reduced
before they move. What is decided one after another (which field takes which column)
is a fold over a table's few candidates, an array of one row.

Shares are in ten-thousandths, rounded down. Null cells are empty; of two cells in one
place both count. A table without enough rows, columns or values gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import pages

#: What values of fields look like; shares that a column needs; rows that are looked at, and how many a table has at least.
HANDS = ["LH", "RH", "LHR", "RHR", "LHRA", "RHRA", "LH/LHR", "RH/RHR", "RHRA/LHR", "LHRA/RHR", "RHR/LHR", "LHR/RHR", "IN", "OUT", "LEFT", "RIGHT"]
RATING = r"^(\d{2,3}\s*MIN|[0-9.]+\s*HR|RATED|[ABC]|N/?A|NONE|NR|--|-|20|45|60|90|120|180)$"
LABEL = r"^(\d{1,3}\s*[Mm][Ii][Nn]\.?|\d{1,3}\s*[Hh][Rr]\.?|NR|N/?A|NONE|RATED|--?|—|[ABC])$"
LABEL_MINUTES = ["20", "45", "60", "90", "120", "180"]
SAMPLED_HAND = r"(?i)^(LH|RH|LHR|RHR|LHRB|RHRB)$"
NEEDED = {"door_number": 5000, "hw_set": 3000, "hw_heading": 3000, "hand": 4000, "fire_rating": 3000, "location": 3000, "door_type": 3000, "frame_type": 3000}
FIELDS = [*NEEDED]
HEADERS, SAMPLE, LEAST_ROWS = 3, 30, 8


def _code(v: Column) -> Column:
    return v.rlike(r"^[A-Z]{1,5}[-]?[A-Z0-9]*$") & (F.length(v) <= 10)


def _set_value(v: Column) -> Column:
    return v.rlike(r"(?i)^[A-Z0-9][A-Z0-9.\-:]{0,19}$") & v.rlike(r"\d")


def looks_like(v: Column) -> dict[str, Column]:
    """Whether a cell looks like a value of each field."""
    upper = F.upper(v)
    return {
        "door_number": pages.valid_door(v), "hw_set": _set_value(v), "hw_heading": _set_value(v), "hand": upper.isin(HANDS), "fire_rating": upper.rlike(RATING),
        "location": (F.length(v) > 8) & v.contains(" "), "door_type": _code(v), "frame_type": _code(v),
    }


def one_to_one(candidates: Column, taken: Column | None = None) -> Column:
    """Of candidates (field, col, ..) in order those whose field and column no earlier one has; taken: what is assigned before."""
    none = F.slice(candidates, 1, 0) if taken is None else taken
    new = lambda got, x: ~F.exists(got, lambda y: (y["field"] == x["field"]) | (y["col"] == x["col"]))
    return F.aggregate(candidates, none, lambda got, x: F.when(new(got, x), F.concat(got, F.array(x))).otherwise(got))


def value_scores(cells: DataFrame) -> DataFrame:
    """(table_id, header, col, n, doors, kinds, scores): of each column below each possible header the filled cells, distinct valid doors, distinct values, and each field's share."""
    near = cells.where(F.col("row") < HEADERS + SAMPLE + 1).withColumn("cell", F.trim(T.clean_cell(F.col("cell"))))
    near = near.where("row > 0 and cell <> ''").select("table_id", "row", "col", "cell", *(c.alias(f) for f, c in looks_like(F.col("cell")).items()))  # once a cell, not for each header
    below = near.withColumn("header", F.explode(F.sequence(F.lit(0), F.lit(HEADERS - 1)))).where("row > header and row <= header + 30")
    fits = {f: F.col(f) for f in FIELDS}
    counts = below.groupBy("table_id", "header", "col").agg(F.count("*").alias("n"), F.size(F.collect_set(F.when(fits["door_number"], F.upper("cell")))).alias("doors"), F.size(F.collect_set("cell")).alias("kinds"), *(F.count(F.when(c, 1)).alias(f) for f, c in fits.items()))
    share = lambda f: F.when(F.col("n") >= 3, F.expr(f"10000 * {f} div n")).otherwise(0)
    return counts.select("table_id", "header", "col", "n", "doors", "kinds", F.array(*(F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), share(f).alias("score")) for k, f in enumerate(FIELDS))).alias("scores"))


def detected(cells: DataFrame) -> DataFrame:
    """(table_id, header, field, col) of tables that list openings by what their columns hold.

    The first of three rows under which eight rows or more lie, a column looks like door numbers and another like sets,
    and the doors are five or more and mostly distinct. Columns that are left may be named by their headers.
    """
    size = cells.groupBy("table_id").agg(F.max("row").alias("last"))
    scores = value_scores(cells).where("n >= 5")
    need = F.create_map(*(F.lit(x) for kv in NEEDED.items() for x in kv))
    some = F.filter(F.transform("scores", lambda x: F.struct((-x["score"]).alias("by"), F.col("col"), x["place"].alias("place"), x["field"].alias("field"), F.col("doors"), F.col("kinds"), F.col("n"))), lambda x: -x["by"] >= need[x["field"]])
    wide = scores.groupBy("table_id", "header").agg(F.array_sort(F.flatten(F.collect_list(some))).alias("c")).join(size, "table_id").where(F.col("last") - F.col("header") >= LEAST_ROWS)
    wide = wide.withColumn("got", one_to_one(F.col("c")))
    of = lambda f: F.get(F.filter("got", lambda x: x["field"] == f), F.lit(0))
    door = of("door_number")
    wide = wide.where(door.isNotNull() & (of("hw_set").isNotNull() | of("hw_heading").isNotNull()) & (door["doors"] >= 5) & (10 * door["kinds"] >= 6 * door["n"]))
    wide = wide.groupBy("table_id").agg(F.min(F.struct("header", "got")).alias("r")).select("table_id", "r.header", F.transform("r.got", lambda x: F.struct(x["field"].alias("field"), x["col"].alias("col"))).alias("got"))
    words = cells.where(F.col("row") < HEADERS).join(wide.select("table_id", "header"), "table_id").where("row = header").select("table_id", "col", F.trim(T.clean_cell(F.col("cell"))).alias("header"))
    place = F.create_map(*(F.lit(x) for kv in zip(FIELDS, range(len(FIELDS)), strict=True) for x in kv))
    named = pages.header_scores(words).where("score >= 3000").groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", place[F.col("field")].alias("place"), "field"))).alias("more"))
    named = named.select("table_id", F.transform("more", lambda x: F.struct(x["field"].alias("field"), x["col"].alias("col"))).alias("more"))
    out = wide.join(named, "table_id", "left").withColumn("got", F.when(F.col("more").isNull(), F.col("got")).otherwise(one_to_one(F.col("more"), F.col("got"))))
    return out.select("table_id", "header", F.explode("got").alias("g")).select("table_id", "header", "g.field", "g.col")


def sampled_scores(cells: DataFrame, sample: int = 5) -> DataFrame:
    """(table_id, col, field, score) by the first few filled cells of each column below row 0; sets weigh 0.7 and places 0.5, as their looks say less."""
    own = cells.where(f"row between 1 and {sample}").withColumn("cell", F.trim(F.coalesce("cell", F.lit("")))).where("cell <> ''")
    v = F.col("cell")
    rated = v.rlike(LABEL) | v.isin(LABEL_MINUTES)
    fits = {"fire_rating": (rated, 10), "hand": (v.rlike(SAMPLED_HAND), 10), "door_number": (pages.looks_like_door(v), 10), "hw_set": (v.rlike(r"(?i)^[A-Z0-9][A-Z0-9\-.:]{0,10}$") & ~v.rlike(r"^\d+$"), 7), "location": (v.contains(" ") & ~rated & ~v.rlike(SAMPLED_HAND), 5)}
    counts = own.groupBy("table_id", "col").agg(F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(f) for f, (c, _) in fits.items()))
    long = counts.select("table_id", "col", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.expr(f"{w} * 1000 * {f} div n").alias("score")) for f, (_, w) in fits.items()))).alias("s"))
    return long.select("table_id", "col", "s.field", "s.score").where("score > 0")


def merged_scores(headers: DataFrame, contents: DataFrame) -> DataFrame:
    """(table_id, col, field, score) of both: the higher counts."""
    return headers.unionByName(contents).groupBy("table_id", "col", "field").agg(F.max("score").alias("score"))


def confidences(cells: DataFrame) -> DataFrame:
    """(table_id, field, col, confidence in hundredths) of the mapping by headers and samples together; columns with no header have none."""
    words = cells.where("row = 0").select("table_id", "col", F.col("cell").alias("header")).where(T.blank_to_null(F.trim("header")).isNotNull())
    scores = merged_scores(pages.header_scores(words), sampled_scores(cells).join(words.select("table_id", "col"), ["table_id", "col"], "left_semi"))
    got = pages.assign_columns(scores)
    return got.select("table_id", "field", "col", F.expr("(score + 50) div 100").alias("confidence"))


def schedules(cells: DataFrame) -> DataFrame:
    """(page, table_id, quality in ten-thousandths): the best table of doors of each page. cells: page, table_id, row, col, cell.

    Headers name three columns or more, doors and two other fields at 0.4 and above. Of the five rows below, three
    or more are filled, half at most hold contacts, and three tenths of the doors' column look like doors.
    """
    head, rows = cells.where("row = 0"), cells.where("row between 1 and 5")
    words = head.select("table_id", "col", T.clean_cell(F.col("cell")).alias("header")).where("trim(header) <> ''")
    scores = pages.header_scores(words)
    best = scores.groupBy("table_id", "field").agg(F.max("score").alias("score")).where("score >= 4000").groupBy("table_id").agg(F.bool_or(F.col("field") == "door_number").alias("door"), F.count("*").alias("fields"), F.sum("score").alias("sum"))
    best = best.where("door and fields >= 3").join(words.groupBy("table_id").agg(F.count("*").alias("named")), "table_id").where("named >= 3")
    filled = rows.groupBy("table_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", T.clean_cell(F.col("cell")).alias("cell")))), lambda x: x["cell"]).alias("cells")).where(F.exists("cells", lambda x: F.trim(x) != ""))
    filled = filled.groupBy("table_id").agg(F.count("*").alias("rows"), F.count(F.when(pages.contact_row(F.col("cells")), 1)).alias("contacts")).where("rows >= 3 and 2 * contacts <= rows")
    doors = pages.assign_columns(scores).where("field = 'door_number'").select("table_id", "col").join(rows.select("table_id", "col", T.clean_cell(F.col("cell")).alias("cell")), ["table_id", "col"]).where("trim(cell) <> ''")
    few = doors.groupBy("table_id").agg(F.count("*").alias("n"), F.count(F.when(pages.looks_like_door(F.col("cell")), 1)).alias("good")).where("10 * good < 3 * n")
    out = best.join(filled, "table_id").join(few, "table_id", "left_anti").join(head.select("page", "table_id").distinct(), "table_id")
    out = out.withColumn("quality", F.expr("sum * (10 + fields) div (10 * fields)"))
    return out.groupBy("page").agg(F.max_by(F.struct("table_id", "quality"), F.struct(F.col("quality"), -F.col("table_id"))).alias("r")).select("page", "r.table_id", "r.quality")
