"""Words with places on pages: lines, columns, lists of openings by three strategies, and what lies within regions.

Words are rows (page, word_id, x0, x1, top, bottom, text). Places are numbers of any
unit; words without a page or a place are in no line and no region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import grids, pages, sets


def within(regions: DataFrame, words: DataFrame, *more: str) -> DataFrame:
    """region_id, word_id and more columns of all words that lie in a region (region_id, page, x0, x1, top, bottom) whole, edges included.

    Pages are cut into squares whose sides are powers of two. A region is in the four squares at most of the first
    size that is not below its sides; a word is in one square of each size that some region has. Pairs of one square
    are tested exactly. So neither a large region among small ones nor many on one page meets more than its surroundings.
    Words and regions are moved once, by page; words are laid into squares where they have come to.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("bottom") - F.col("top"), F.lit(1.0))
    at = lambda x: F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("size")))
    own = regions.where("page is not null and x0 <= x1 and top <= bottom").withColumn("size", F.ceil(F.log2(side)).cast("int"))
    sizes = [r["size"] for r in own.select("size").distinct().collect()]  # of numbers' magnitudes: some dozens at most
    box = ("x0", "x1", "top", "bottom")
    own = own.withColumn("gx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("gy", F.explode(F.sequence(at("top"), at("bottom"))))
    rest = [c for c in more if c not in ("page", "word_id", *box)]
    held = words.where("page is not null").select("page", "word_id", *box, *rest)
    both = held.unionByName(own.select("page", "size", "gx", "gy", F.struct("region_id", *box).alias("region")), allowMissingColumns=True).repartition("page")
    word = F.col("region").isNull()
    both = both.withColumn("size", F.explode(F.when(word, F.array(*map(F.lit, sizes)).cast("array<int>")).otherwise(F.array("size"))))
    both = both.withColumns({"gx": F.when(word, at("x0")).otherwise(F.col("gx")), "gy": F.when(word, at("top")).otherwise(F.col("gy"))})
    near = F.collect_list("region").over(Window.partitionBy("page", "size", "gx", "gy"))
    inside = lambda r: (F.col("x0") >= r["x0"]) & (F.col("x1") <= r["x1"]) & (F.col("top") >= r["top"]) & (F.col("bottom") <= r["bottom"])
    out = both.withColumn("near", near).where("region is null").withColumn("near", F.explode(F.filter("near", inside)))
    return out.select(F.col("near.region_id").alias("region_id"), "word_id", *more)


def region_texts(regions: DataFrame, words: DataFrame, slack: float = 3.0) -> DataFrame:
    """region_id, n and text: a region's words in reading order, its lines parted by line ends."""
    own = within(regions, words, "x0", "top", "text").where("word_id is not null").withColumnRenamed("region_id", "page")
    rows = with_lines(own, slack).groupBy("page", "line").agg(F.count("*").alias("n"), _joined().alias("text"))
    rows = rows.groupBy("page").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return rows.select(F.col("page").alias("region_id"), "n", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


def with_lines(words: DataFrame, slack: float = 3.0) -> DataFrame:
    """words with their line's number on the page, from 1: a line ends where the next word is lower by more than `slack`."""
    words = words.where("page is not null and top is not null and x0 is not null")
    last = F.lag("top").over(Window.partitionBy("page").orderBy("top", "x0", "word_id"))
    rows = words.withColumn("_far", F.col("top") - last > slack)
    return sets.segments(rows, ["page"], ["top", "x0", "word_id"], F.col("_far")).withColumnRenamed("segment", "line").drop("_far")


def _joined() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))), lambda x: x["text"]), " ")


def cells(words: DataFrame, columns: DataFrame, slack: float = 3.0, left: float = 10.0) -> DataFrame:
    """(table_id, row, col, cell): each page's words by line and by the last column (page, col, start) that starts before them; a page is a table."""
    own = with_lines(words, slack).join(pages.nearest_column(words, columns, left), ["page", "word_id"]).where("col is not null")
    return own.groupBy(F.col("page").alias("table_id"), (F.col("line") - 1).cast("int").alias("row"), "col").agg(_joined().alias("cell"))


def openings(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """(table_id, row, door_number and a column for each other field): rows below the header whose door is valid. mapping: table_id, header, field, col."""
    rows = table.join(mapping, ["table_id", "col"]).where(F.col("row") > F.col("header"))
    value = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, T.clean_cell(F.col("cell")))), F.lit("")).alias(f)
    rows = rows.groupBy("table_id", "row").agg(*map(value, grids.FIELDS))
    return rows.where(pages.valid_door(F.col("door_number"))).withColumn("door_number", F.upper(F.trim("door_number")))


def openings_by_priority(strategies: list[DataFrame], by: list[str]) -> DataFrame:
    """Openings of several strategies: for each of `by` and door the row of the first strategy that has it, and of it the first; `strategy` says which."""
    return sets.union_by_priority(strategies, [*by, "door_number"], "row")
