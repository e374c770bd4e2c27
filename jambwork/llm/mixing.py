"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets slots of one block of words each. The slots' golden-ratio
points are mapped through the sources' cumulative slot counts, so that any
stretch of the schedule has nearly the mix of the whole. A source's slots are
ranked, and slot by slot take the next block of its documents, which are
shuffled by a hash, laid end to end and cut into blocks of equal words; after
the last block they begin again.

Golden-ratio points hit an interval as often as its length says but for a few:
slots that a source has over its target are dropped, those that lack follow
after the others. So each source's words come to its target but for the
fraction of a word.

DataFrame functions only. A source may hold most rows: positions within a source
are sums over hash ranges first, and within a range then; ranks likewise.
Tables that come to one task have a row for each source.

Null texts have size 0; null sources are a source of their own, the last. A
source without words has target 0. Repeated rows count like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jambwork.llm.common import WORD, stored, table, with_row_keys

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: The golden ratio's fraction in units of 2**-64: points are k * PHI modulo 2**64, exact for any k.
PHI = 0x9E3779B97F4A7C15
#: Cells of the schedule's axis, by which points meet sources; slots that are ranked at once.
CELLS, AT_ONCE = 4096, 1 << 16
#: Least and most words of a block; between them, so many blocks as to make about SLOTS slots.
LEAST_BLOCK, MOST_BLOCK, SLOTS = 16, 8192, 1 << 20


def _running(df: DataFrame, value: str, by: list[str], order: list[str], coarse: Column) -> DataFrame:
    """df with `before`: the sum of value over the rows of the same `by` that come before; coarse is monotone in order."""
    df = df.withColumn("coarse", coarse)
    sums = df.groupBy(*by, "coarse").agg(F.sum(value).alias("here"))
    w = Window.partitionBy(*by).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "coarse", F.coalesce(F.sum("here").over(w), F.lit(0)).alias("base"))
    w = Window.partitionBy(*by, "coarse").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("within", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return out.join(sums, [*by, "coarse"]).withColumn("before", (F.col("base") + F.col("within")).cast("long")).drop("coarse", "base", "within")


def targets(sizes: DataFrame) -> DataFrame:
    """source, nr (its place, from 0), source_size, target, words (whole ones of the target) of each source of sizes (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nr = F.row_number().over(order) - 1
    by = by.withColumn("nr", nr.cast("long")).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("nr") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * MOST_EPOCHS
    by = by.withColumn("cap", cap).withColumn("all", F.sum("source_size").over(Window.partitionBy()))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "nr")
    by = by.withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = by.withColumn("rest", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    big = lambda x: F.col(x).cast("decimal(19,0)")
    open_ = (big("all") - big("full")) * big("w") < big("cap") * big("rest")
    first = F.min(F.when(open_, F.struct("full", "rest"))).over(Window.partitionBy())
    by = by.withColumn("first", first)
    level = (F.col("all") - F.col("first.full")).cast("double") / F.col("first.rest")
    capped = F.col("first").isNull() | (F.col("full") < F.col("first.full")) | ((F.col("full") == F.col("first.full")) & (F.col("rest") > F.col("first.rest")))
    by = by.withColumn("target", F.when(capped, F.col("cap").cast("double")).otherwise(F.least(F.col("w") * level, F.col("cap").cast("double"))))
    return by.select("source", "nr", "source_size", "target", F.floor("target").cast("long").alias("words"))


def sized(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.select("doc_id", "source", *keys, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(sources: DataFrame) -> DataFrame:
    """Sources with block (words of a block), blocks, slots (that the target needs) and begin (the first on the schedule's axis)."""
    whole = Window.partitionBy()
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(MOST_BLOCK), F.expr(f"sum(source_size) over () div {SLOTS}"))).cast("long")
    out = sources.where("words > 0").withColumn("block", block)
    out = out.withColumn("blocks", F.expr("(source_size + block - 1) div block"))
    out = out.withColumn("slots", F.expr("words div source_size * blocks + (words % source_size + block - 1) div block"))
    out = out.withColumn("begin", F.coalesce(F.sum("slots").over(Window.orderBy("nr").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
    return out.withColumn("all_slots", F.sum("slots").over(whole))


def schedule(sources: DataFrame) -> DataFrame:
    """slot, nr, rank, block_nr and taken (words) of the schedule of planned sources."""
    spark = sources.sparkSession
    total = sources.agg(F.max("all_slots")).first()[0] or 0
    cell = lambda x: F.expr(f"cast({x} as decimal(28,0)) * {CELLS} div {max(total, 1)}").cast("long")
    point = f"(cast(slot as decimal(19,0)) * cast({PHI} as decimal(20,0)) + {2**63}) % {2**64}"
    slots = spark.range(total).select(F.col("id").alias("slot")).withColumn("x", F.expr(f"cast({point} as decimal(20,0))")).withColumn("x", F.expr(f"cast(x * cast({total} as decimal(18,0)) div {2**64} as long)")).withColumn("cell", cell("x"))
    where = sources.select("nr", "begin", (F.col("begin") + F.col("slots")).alias("end"), F.explode(F.sequence(cell("begin"), cell("begin + slots - 1"))).alias("cell"))
    met = slots.join(where, "cell").where("x >= begin and x < end").select("slot", "nr", F.lit(1).alias("one"))
    ranked = _running(met, "one", ["nr"], ["slot"], F.floor(F.col("slot") / AT_ONCE)).select("slot", "nr", F.col("before").alias("rank"))
    ranked = ranked.join(sources.select("nr", "slots"), "nr").where("rank < slots").drop("slots")
    got = ranked.groupBy("nr").count()
    lack = sources.join(got, "nr", "left").withColumn("count", F.coalesce("count", F.lit(0))).where("count < slots")
    late = lack.select("nr", "begin", F.explode(F.sequence(F.col("count"), F.col("slots") - 1)).alias("rank")).select((F.col("begin") + F.col("rank") + total).alias("slot"), "nr", "rank")
    out = ranked.unionByName(late).join(sources.select("nr", "block", "blocks", "source_size", "words"), "nr")
    out = out.withColumn("block_nr", F.expr("rank % blocks")).withColumn("at", F.expr("rank div blocks * source_size + block_nr * block"))
    size = F.least(F.col("block"), F.col("source_size") - F.col("block_nr") * F.col("block"))
    return out.select("slot", "nr", "rank", "block_nr", size.alias("size"), F.least(size, F.col("words") - F.col("at")).alias("taken"))


def mix(docs: DataFrame, *keys: str) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes, repeats counted), first_slot and n_slots (of the schedule that take from the row), and the keys of each row of docs (doc_id, source, text)."""
    sizes = stored(sized(docs, *keys))
    sources = stored(targets(sizes))
    planned = stored(plan(sources))
    slots = schedule(planned)
    whole = F.col("taken") == F.col("size")
    use = slots.where("taken > 0").groupBy("nr", "block_nr").agg(
        F.count(F.when(whole, 1)).alias("times"), F.min(F.when(whole, F.col("slot"))).alias("first"),
        F.coalesce(F.sum(F.when(~whole, F.col("taken"))), F.lit(0)).alias("part"), F.min(F.when(~whole, F.col("slot"))).alias("last"),
    )
    rows = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).select("doc_id", *keys, "size", "nr", "source_size", "target", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")).alias("turn"))
    laid = _running(rows.where("size > 0").drop("target", "source_size"), "size", ["nr"], ["turn", "doc_id", "size", *keys], F.substring("turn", 1, 3))
    laid = laid.join(planned.select("nr", "block", "source_size", "target"), "nr")
    piece = laid.withColumn("block_nr", F.explode(F.expr("sequence(before div block, (before + size - 1) div block)")))
    piece = piece.withColumn("lo", F.greatest(F.col("before") - F.col("block_nr") * F.col("block"), F.lit(0))).withColumn("hi", F.least(F.col("before") + F.col("size") - F.col("block_nr") * F.col("block"), F.col("block")))
    cut = F.greatest(F.lit(0), F.least(F.col("part"), F.col("hi")) - F.col("lo"))
    piece = piece.join(use, ["nr", "block_nr"], "left").withColumn("cut", cut)
    words, sum_ = F.col("times") * (F.col("hi") - F.col("lo")) + F.col("cut"), lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    taken = piece.groupBy("doc_id", *keys, "nr", "before", "size", "source_size", "target").agg(
        sum_(words).alias("taken"), F.min(F.least("first", F.when(F.col("cut") > 0, F.col("last")))).alias("first_slot"), sum_(F.col("times") + (F.col("cut") > 0).cast("int")).alias("n_slots")
    )
    columns = ["doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots", *keys]
    zero = F.lit(0).cast("long")
    none = rows.where("size = 0").withColumns({"taken": zero, "first_slot": F.lit(None).cast("long"), "n_slots": zero})
    return taken.select(columns).unionByName(none.select(columns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each row as often as the mix takes it, half of a row or more as a whole one.

    Rows aren't cut, so a source's words miss its target by half of one row at most.
    """
    keyed, keys = with_row_keys(docs), ["row1", "row2"]
    times = mix(keyed, *keys).groupBy(*keys).agg(F.sum(F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5)).cast("int").alias("times"))
    rows = keyed.join(times.where("times > 0"), keys).dropDuplicates(keys)
    return rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM d GROUP BY source),
t AS (SELECT *, CASE nr % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_, sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS k FROM t WINDOW o AS (ORDER BY cap / w::DOUBLE, nr)),
m AS (SELECT k, (total - full_)::DOUBLE / rest::DOUBLE AS level FROM f WHERE (total - full_) * w < cap * rest ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN (SELECT k FROM m) IS NULL OR f.k < (SELECT k FROM m) THEN cap::DOUBLE ELSE least(w * (SELECT level FROM m), cap::DOUBLE) END AS target FROM f),
n AS (SELECT g.*, s.nr, floor(g.target)::BIGINT AS words, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM g JOIN s ON g.source IS NOT DISTINCT FROM s.source),
b AS (SELECT *, greatest(16, least(8192, sum(source_size) OVER () // 1048576))::BIGINT AS block FROM n WHERE words > 0),
c AS (SELECT *, (source_size + block - 1) // block AS blocks FROM b),
e AS (SELECT *, words // source_size * blocks + (words % source_size + block - 1) // block AS slots FROM c),
h AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_, sum(slots) OVER ()::BIGINT AS all_slots FROM e),
x AS (SELECT i AS slot, ((i::HUGEINT * 11400714819323198485::HUGEINT + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT * all_slots // 18446744073709551616::HUGEINT)::BIGINT AS x FROM (SELECT max(all_slots) AS all_slots FROM h), range(all_slots) r(i)),
y AS (SELECT nr, slot, row_number() OVER (PARTITION BY nr ORDER BY slot) - 1 AS rank FROM x JOIN h ON x.x >= begin_ AND x.x < begin_ + slots),
z AS (SELECT y.nr, y.slot, y.rank FROM y JOIN h USING (nr) WHERE y.rank < h.slots UNION ALL SELECT h.nr, begin_ + i + all_slots, i FROM h, range((SELECT count(*) FROM y WHERE y.nr = h.nr), h.slots) r(i)),
l AS (SELECT nr, slot, rank % blocks AS block_nr, least(block, source_size - rank % blocks * block, words - rank // blocks * source_size - rank % blocks * block) AS given FROM z JOIN h USING (nr)),
p AS (SELECT d.doc_id, d.size, d.turn, n.nr, n.source_size, n.target, h.block, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, row_number() OVER () AS row FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN h ON h.nr = n.nr),
i AS (SELECT *, unnest(generate_series(before // block, (before + size - 1) // block)) AS block_nr FROM p WHERE size > 0),
k AS (SELECT i.row, l.slot, greatest(0, least(before + size - i.block_nr * block, block, given) - greatest(before - i.block_nr * block, 0)) AS t FROM i JOIN l ON l.nr = i.nr AND l.block_nr = i.block_nr),
o AS (SELECT row, sum(t) AS taken, min(slot) FILTER (t > 0) AS first_slot, count(*) FILTER (t > 0) AS n_slots FROM k GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots FROM p LEFT JOIN o USING (row)
"""
