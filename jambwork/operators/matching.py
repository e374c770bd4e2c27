"""Exclusive matching: what may be taken once, by those who ask in turn; sets and items of two sources on top of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import linkage, merge
from jambwork.sources.sinks import stored


def exclusive(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, a and b: what the b's take if in their turn each takes the best a that is left.

    pairs: by, a, b, turn (a number of each b within `by`, no two the same) and choice (what b prefers, the least first, no two the same).

    All b's ask at once, an a keeps the first in turn, and whoever comes after it is refused by that a for good; what
    is refused asks its next. When nobody is refused, this is what the turns would give, as no a ever goes back to a
    later b. Groups of `by` where nobody is refused are done: only the others' pairs go into another round. Rounds
    grow with the length of chains of refusals and not with the number of b's, and each round's pairs are stored.
    """
    left, done = stored(pairs), []
    while True:
        asks = left.groupBy(*by, "b", "turn").agg(F.min_by("a", "choice").alias("a"))
        kept = stored(asks.groupBy(*by, "a").agg(F.min("turn").alias("first"), F.min_by("b", "turn").alias("b"), F.count("*").alias("n")))
        refused = kept.where("n > 1").select(*by).distinct()
        done.append(kept.join(refused, by, "left_anti").select(*by, "a", "b"))
        if refused.isEmpty():
            return reduce(DataFrame.unionByName, done)
        left = stored(left.join(refused, by, "left_semi").join(kept.select(*by, "a", "first"), [*by, "a"], "left").where("first is null or turn <= first").drop("first"))


def matched_sets(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b and tier: sets (by, set_id, pos, heading) of two sources, each once.

    Tier 1: equal ids. Tier 2: ids that are equal but for case, spaces, hyphens and underscores; of the left the last
    such counts, of the right the first. Tier 3: headings that share half of their words or more, each of the right's
    sets in turn with its best free one, ties to the first. Rows of one id count once, without an id not at all.
    """
    first = lambda d, n: d.where("set_id is not null").groupBy(*by, F.col("set_id").alias(n)).agg(F.min("pos").alias(f"{n}_pos"), F.min_by("heading", "pos").alias(f"{n}_heading"))
    x, y = stored(first(left, "a")), stored(first(right, "b"))
    one = x.join(y.withColumn("a", F.col("b")), [*by, "a"]).select(*by, "a", "b", F.lit(1).alias("tier"))
    free = lambda d, n, *got: reduce(lambda r, g: r.join(g.select(*by, n), [*by, n], "left_anti"), got, d)
    kx = x.groupBy(*by, T.set_key(F.col("a")).alias("k")).agg(F.max_by("a", "a_pos").alias("a"))
    ky = free(y, "b", one).groupBy(*by, T.set_key(F.col("b")).alias("k")).agg(F.min_by("b", "b_pos").alias("b"))
    two = stored(free(kx.join(ky, [*by, "k"]), "a", one).select(*by, "a", "b", F.lit(2).alias("tier")))
    words = lambda d, n: free(d, n, one, two).withColumn("word", T.tokens(F.col(f"{n}_heading"))).select(*by, n, f"{n}_pos", F.size("word").alias(f"{n}_size"), F.explode("word").alias("word"))
    met = words(x, "a").join(words(y, "b"), [*by, "word"]).groupBy(*by, "a", "b").agg(*(F.first(c).alias(c) for c in ("a_pos", "b_pos", "a_size", "b_size")), F.count("*").alias("both"))
    scored = met.withColumn("score", F.col("both") / (F.col("a_size") + F.col("b_size") - F.col("both"))).where("score >= 0.5")
    three = exclusive(scored.select(*by, "a", "b", F.struct("b_pos", "b").alias("turn"), F.struct((-F.col("score")).alias("by"), "a_pos", "a").alias("choice")), by)
    return one.unionByName(two).unionByName(three.withColumn("tier", F.lit(3)))


#: Which source is preferred where both differ: true the second.
FIELDS = {"name": True, "qty": False, "manufacturer": True, "model": True, "finish": True}
#: From worst to best.
LEVELS = ["conflict", "single_source", "full"]


def paired_items(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """block, a_pos and b_pos: each of the right's items (block, pos, name) in its turn with the left's that its name matches, if no earlier one has it; no second choice."""
    found = linkage.match_names(right.select(block, F.col("name").alias("a")).distinct(), left.select(block, F.col("name").alias("b")), block).where("b is not null").select(block, F.col("a").alias("name"), F.col("b").alias("taken"))
    asks = right.join(found, [block, "name"]).groupBy(block, "taken").agg(F.min("pos").alias("b_pos"))
    return left.groupBy(block, F.col("name").alias("taken")).agg(F.min("pos").alias("a_pos")).join(asks, [block, "taken"]).select(block, "a_pos", "b_pos")


#: Blocks of so many items of both sources at most are paired within a row each.
MANY = 256


def _paired_in_rows(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """block, a and b: all items, those that paired_items pairs in one row. A block's items come to one row, which is all that is moved."""
    rows = left.select(block, F.col("item").alias("x")).unionByName(right.select(block, F.col("item").alias("y")), allowMissingColumns=True)
    own = rows.groupBy(block).agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"))
    name, pos = (lambda items, f=f: F.transform(items, lambda x: x[f]) for f in ("name", "pos"))
    at = lambda b: F.array_min(pos(F.filter("xs", lambda x: x["name"] == b)))
    taken = lambda y, found: F.get(F.filter(found, lambda m: m["a"] == y["name"]), F.lit(0))["b"]
    asks = T.let(linkage.matches(name(F.col("ys")), name(F.col("xs"))), lambda found: F.transform("ys", lambda y: F.struct(y.alias("y"), T.let(taken(y, found), at).alias("at"))))
    own = own.withColumn("asks", asks)
    of = lambda at: F.transform(F.filter("asks", lambda k: (k["at"] == at) & k["y"]["pos"].isNotNull()), lambda k: k["y"])
    first = F.transform("xs", lambda x: F.struct(x.alias("a"), F.array_min(of(x["pos"])).alias("b")))
    rest = F.transform(F.filter("asks", lambda k: F.coalesce(k["y"]["pos"] != F.array_min(pos(of(k["at"]))), F.lit(True))), lambda k: F.struct(F.get("xs", F.lit(-1)).alias("a"), k["y"].alias("b")))
    return own.select(block, F.inline(F.concat(first, rest)))


def _paired_by_joins(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """_paired_in_rows for blocks of any size, and for items without one, which have no pair."""
    left, right = (d.select(block, F.col("item")["pos"].alias(f"{n}_pos"), F.col("item").alias(n)) for d, n in ((left, "a"), (right, "b")))
    pairs = paired_items(left.select(block, "a.pos", "a.name"), right.select(block, "b.pos", "b.name"), block)
    return left.join(pairs, [block, "a_pos"], "left").join(right, [block, "b_pos"], "full_outer").select(block, "a", "b")


def reconciled_items(left: DataFrame, right: DataFrame, block: str) -> DataFrame:
    """block, a_pos, b_pos, a struct (value, confidence, chosen_from) for each of FIELDS and the worst of their confidences, of all items of both sources.

    Items of one source have its values as single_source. left, right: block, pos (unique in it) and FIELDS. Blocks of MANY
    items at most are paired within a row, larger ones by joins, in which no block comes to one task as a whole.
    """
    left, right = (d.select(block, F.struct("pos", *(F.col(f).cast("string").alias(f) for f in FIELDS)).alias("item")) for d in (left, right))
    large = stored(left.select(block).unionByName(right.select(block)).groupBy(F.col(block).alias("_b")).agg(F.count("*").alias("n")).where(f"n > {MANY} or _b is null").select("_b"))
    if large.isEmpty():
        rows = _paired_in_rows(left, right, block)
    else:
        part = lambda how: [d.join(large, d[block].eqNullSafe(large["_b"]), how) for d in (left, right)]
        rows = _paired_in_rows(*part("left_anti"), block).unionByName(_paired_by_joins(*part("left_semi"), block))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()

    def field(f: str, second: bool) -> Column:
        one = F.struct(F.coalesce(F.col("a")[f], F.col("b")[f], F.lit("")).alias("value"), F.lit("single_source").alias("confidence"), F.when(F.col("a").isNotNull(), "a").otherwise("b").alias("chosen_from"))
        return F.when(both, merge.reconciled(F.col("a")[f], F.col("b")[f], second)).otherwise(one).alias(f)

    rows = rows.select(block, F.col("a.pos").alias("a_pos"), F.col("b.pos").alias("b_pos"), *(field(f, second) for f, second in FIELDS.items()))
    place = lambda f: F.array_position(F.array(*map(F.lit, LEVELS)), F.col(f)["confidence"])
    return rows.withColumn("overall", F.element_at(F.array(*map(F.lit, LEVELS)), F.least(*map(place, FIELDS)).cast("int")))
