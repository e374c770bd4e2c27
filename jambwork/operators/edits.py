"""Changes to stored rows: revisions applied, corrections, bulk edits, nested writes; and rows nested again for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import sets as S


def apply_revision(old: DataFrame, new: DataFrame, key: str, fields: list[str], progress: list[str], keep: Column) -> DataFrame:
    """old with a revision: rows that new lacks go, others take its fields, new ones come; progress is kept where `keep` says so (a column of new), else emptied."""
    a = old.select(key, *(F.col(f).alias(f"a_{f}") for f in fields), *progress, F.lit(True).alias("_there"))
    rows = new.withColumn("_keep", keep).join(a, key, "left")
    state = F.when(F.col("_there").isNull(), "inserted").otherwise("updated").alias("state")
    held = [F.when(F.coalesce("_there", F.lit(False)) & F.col("_keep"), F.col(p)).alias(p) for p in progress]
    return rows.select(key, *fields, *held, state)


def corrected(items: DataFrame, removed: DataFrame, fixed: DataFrame, added: DataFrame) -> DataFrame:
    """items (set_id, pos, name, qty) after corrections: names removed and fixed case aside (the first fix counts; a value that is null stays), new ones appended unless the set has the name."""
    key = F.lower(F.trim("name")).alias("_k")
    rows = items.withColumn("_k", key)
    left = rows.join(removed.select("set_id", key).distinct(), ["set_id", "_k"], "left_anti")
    fix = fixed.groupBy("set_id", key).agg(F.min_by(F.struct("new_name", "new_qty"), "pos").alias("_f"))
    done = left.join(fix, ["set_id", "_k"], "left").select("set_id", "pos", F.coalesce("_f.new_name", "name").alias("name"), F.coalesce("_f.new_qty", "qty").alias("qty"), F.when(F.col("_f").isNotNull(), "fixed").otherwise("kept").alias("state"))
    fresh = added.withColumn("_k", key).join(rows.select("set_id", "_k").distinct(), ["set_id", "_k"], "left_anti")
    return done.unionByName(S.first_per_group(fresh, ["set_id", "_k"], F.col("pos")).select("set_id", "pos", "name", "qty", F.lit("added").alias("state")))


def set_fields(doors: DataFrame, edits: DataFrame, fields: list[str]) -> DataFrame:
    """doors with the first edit (door_key, field, value, pos) of each field, and `edited`: the fields that an edit has set, each then certain."""
    first = edits.where(F.col("field").isin(fields)).groupBy("door_key", "field").agg(F.min_by("value", "pos").alias("v"))
    wide = first.groupBy("door_key").pivot("field", fields).agg(F.first("v"))
    rows = doors.join(wide.select(F.col("door_key"), *(F.col(f).alias(f"_{f}") for f in fields)), "door_key", "left")
    edited = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"_{f}").isNotNull(), F.lit(f)) for f in fields))), ",")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in doors.columns), edited.alias("edited"))


def set_by_name(items: DataFrame, parents: DataFrame, key: str, name: str, values: dict[str, Column]) -> DataFrame:
    """items of the given parents that have the name take the values; others stay."""
    rows = items.join(parents.select(key, F.lit(True).alias("_in")).distinct(), key, "left")
    hit = F.coalesce(F.col("_in"), F.lit(False)) & (F.col("name") == name)
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).drop("_in")


def canonical_models(items: DataFrame, variants: DataFrame) -> DataFrame:
    """items whose model is a known variant (manufacturer, variant, canonical), case and punctuation aside, take the canonical one."""
    one = variants.groupBy(F.lower("manufacturer").alias("_m"), T.model_key(F.col("variant")).alias("_v")).agg(F.min("canonical").alias("_c"))
    rows = items.join(one, (F.lower("manufacturer") == F.col("_m")) & (T.model_key(F.col("model")) == F.col("_v")), "left")
    return rows.withColumn("model", F.coalesce("_c", "model")).select(*items.columns)


def unnested(payload: DataFrame, schema: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(openings, items) of payloads (run, body as JSON) whose run is known: leaves and quantities default to 1, places to 0."""
    rows = payload.join(known.select("run"), "run", "left_semi").select("run", F.explode(F.from_json("body", schema)).alias("o"))
    openings = rows.select("run", "o.door_number", F.coalesce("o.leaf_count", F.lit(1)).alias("leaf_count"))
    items = rows.select("run", "o.door_number", F.explode("o.items").alias("i")).select("run", "door_number", "i.name", F.coalesce("i.qty", F.lit(1)).alias("qty"), F.coalesce("i.sort_order", F.lit(0)).alias("sort_order"))
    return openings, items


def renested(openings: DataFrame, items: DataFrame) -> DataFrame:
    """By set the heading and items of its first opening by door number: (hw_set, door_number, items as text, doors)."""
    first = openings.groupBy("hw_set").agg(F.min(F.struct("door_number", "opening_id")).alias("o"), F.count("*").alias("doors"))
    own = items.join(first.select(F.col("o.opening_id").alias("opening_id")), "opening_id", "left_semi")
    listed = own.groupBy("opening_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), "|").alias("items"))
    return first.select("hw_set", "doors", F.col("o.door_number").alias("door_number"), F.col("o.opening_id").alias("opening_id")).join(listed, "opening_id", "left").select("hw_set", "doors", "door_number", F.coalesce("items", F.lit("")).alias("items"))


def note_buckets(notes: DataFrame, openings: DataFrame, items: DataFrame) -> DataFrame:
    """notes (note_id, scope, opening_id, item_id, leaf_side) with `bucket`: project, opening, leaf or item; what has no item or leaf of its own goes to the opening."""
    rows = notes.join(openings.select("opening_id", F.lit(True).alias("_o")), "opening_id", "left").join(items.select("opening_id", "item_id", F.lit(True).alias("_i")).distinct(), ["opening_id", "item_id"], "left")
    bucket = F.when(F.col("scope") == "project", "project").when(F.col("_o").isNull(), "none").when((F.col("scope") == "item") & F.col("_i"), "item").when((F.col("scope") == "leaf") & F.col("leaf_side").isin("active", "inactive"), "leaf").otherwise("opening")
    return rows.withColumn("bucket", bucket).drop("_o", "_i")


def merged_pages(sets: DataFrame) -> DataFrame:
    """Sets of several pages (set_id, pos, items, door_count, doors, convention) as one each: items added up, doors once, the first known convention; sets without items and doors go."""
    rows = sets.groupBy("set_id").agg(
        F.sum("items").alias("items"), F.sum("door_count").alias("said"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("doors")))).alias("doors"),
        F.min_by(F.when(F.col("convention") != "unknown", F.col("convention")), F.when(F.col("convention") != "unknown", F.col("pos"))).alias("convention"),
    )
    rows = rows.where((F.col("items") > 0) | (F.size("doors") > 0))
    return rows.select("set_id", "items", F.greatest("said", F.size("doors").cast("long")).alias("door_count"), F.array_join("doors", ",").alias("doors"), F.coalesce("convention", F.lit("unknown")).alias("convention"))


def stamped_ratings(rows: DataFrame, rating: str, *fields: str) -> DataFrame:
    """rows whose blank rating is the first found in the fields, one after another; it is taken out of the field that had it."""
    blank = T.blank_to_null(F.col(rating)).isNull()
    found = [F.coalesce(T.fire_rating(F.col(f)), F.lit("")) for f in fields]
    earlier, out = F.lit(False), {}
    for f, x in zip(fields, found, strict=True):
        out[f] = F.when(blank & ~earlier & (x != ""), T.without_rating(F.col(f))).otherwise(F.col(f))
        earlier = earlier | (x != "")
    return rows.withColumns(out | {rating: F.when(blank, F.coalesce(*(F.nullif(x, F.lit("")) for x in found), F.lit(""))).otherwise(F.col(rating))})
