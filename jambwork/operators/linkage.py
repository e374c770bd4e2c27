"""Joins: nested children, orphans, coalescing and tiered lookups, fuzzy matching in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.sources.sinks import stored


def nested(parents: DataFrame, children: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """Parents with their children as an ordered array of structs, empty if there are none."""
    own = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    kind = own.schema[name].dataType
    return parents.join(own, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Parents without a child: all of them."""
    return parents.join(children.select(key), key, "left_anti")


def blocked(openings: DataFrame, items: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Distinct active openings with a damaged item, and the nation that it came from."""
    bad = items.where("damaged").select("opening_id", "supplier_id").distinct()
    return openings.where("is_active").select("opening_id", "project_id").join(bad, "opening_id").join(suppliers, "supplier_id").select("project_id", "opening_id", "nation").distinct()


def secured(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows that a member may see."""
    return rows.join(members.select(key).distinct(), key, "left_semi")


def coalescing_full_join(left: DataFrame, right: DataFrame, key: str, fields: list[str], required: list[str]) -> DataFrame:
    """Both sides' rows by key, the left's fields where not blank, else the right's.

    Rows of the left alone that have none of the required fields go if the right
    has any row. A blank fire rating becomes NR. `origin` tells both, left or right.
    """
    a = left.select(key, *(T.blank_to_null(F.col(f)).alias(f"a_{f}") for f in fields), F.lit(True).alias("in_a"))
    b = right.select(key, *(T.blank_to_null(F.col(f)).alias(f"b_{f}") for f in fields), F.lit(True).alias("in_b"))
    rows = a.join(b, key, "full_outer")
    origin = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "left").otherwise("right")
    enriched = F.exists(F.array(*(F.struct(F.col(f"a_{f}").isNull() & F.col(f"b_{f}").isNotNull()) for f in fields)), lambda x: x["col1"])
    out = rows.select(key, origin.alias("origin"), (F.col("in_a").isNotNull() & enriched).alias("enriched"), *(F.coalesce(f"a_{f}", f"b_{f}", F.lit("NR" if f == "fire_rating" else "")).alias(f) for f in fields))
    if right.isEmpty():
        return out
    lost = (F.col("origin") == "left")
    for f in required:
        lost &= F.col(f) == ""
    return out.where(~lost)


def priority_lookup(rows: DataFrame, first: DataFrame, second: DataFrame, key1: Column, key2: Column, value: str) -> DataFrame:
    """value of the first table by one key, else of the second by another; both tables are (key, value) with unique keys."""
    one = first.select(F.col("key").alias("_k1"), F.col(value).alias("_v1"))
    two = second.select(F.col("key").alias("_k2"), F.col(value).alias("_v2"))
    out = rows.withColumn("_a", key1).withColumn("_b", key2).join(one, F.col("_a") == F.col("_k1"), "left").join(two, F.col("_b") == F.col("_k2"), "left")
    how = F.when(F.col("_v1").isNotNull(), "first").when(F.col("_v2").isNotNull(), "second").otherwise("none")
    return out.select(*rows.columns, F.coalesce("_v1", "_v2").alias(value), how.alias("via"))


#: Ends of keys that are left out where no name is equal.
SUFFIX = r"[:\-](WI|EX|OPP)$"


def lengths(rows: DataFrame, *texts: Column) -> list[list[int]]:
    """The lengths that each of some texts has: one row, of as many numbers as the longest has characters at most."""
    return list(rows.agg(*(F.collect_set(F.length(t)) for t in texts)).first())


def begins(value: Column, of: list[int]) -> Column:
    """A text's beginnings of given lengths, itself included."""
    return F.transform(F.filter(F.array(*map(F.lit, sorted(of))).cast("array<int>"), lambda n: n <= F.length(value)), lambda n: F.substr(value, F.lit(1), n))


def _rows(*parts: Column) -> Column:
    return F.concat(*(F.coalesce(p, F.array().cast("array<struct<side:int,meet:string,tier:int>>")) for p in parts))


def asked(key: Column, names: list[int], kind: int = 0, suffix: str = SUFFIX) -> Column:
    """Where a key meets names, as (side, meet, tier): equal, equal without its suffix, or one begins with the other.

    Only beginnings of lengths that names have (`names`) are listed. Texts of different kinds don't meet; nor do two beginnings.
    """
    row = lambda side, meet, tier: F.struct(F.lit(2 * kind + side).alias("side"), meet.alias("meet"), F.lit(tier).alias("tier"))
    bare = F.regexp_replace(key, suffix, "")
    equal = F.when(F.length(key).isin(names), F.array(row(0, key, 1)))
    less = F.when(F.length(bare).isin(names) & (bare != key), F.array(row(0, bare, 2)))
    down = F.transform(F.filter(begins(bare, names), lambda x: x != bare), lambda x: row(0, x, 3))
    up = F.when(F.length(bare) < max(names, default=0), F.array(row(1, bare, 3)))
    return _rows(equal, less, down, up)


def offered(name: Column, keys: list[int], kind: int = 0) -> Column:
    """Where a name meets keys, as (side, meet): with all of it, and with its beginnings of lengths that bare keys have."""
    row = lambda side, meet: F.struct(F.lit(2 * kind + side).alias("side"), meet.alias("meet"), F.lit(0).alias("tier"))
    up = F.transform(F.filter(begins(name, keys), lambda x: x != name), lambda x: row(1, x))
    return F.transform(_rows(F.array(row(0, name)), up), lambda x: x.dropFields("tier"))


def tiered_lookup(keys: DataFrame, known: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """For each key the value of the known name that is equal, equal without its suffix, or the longest prefix either way.

    One equi-join: the prefixes of each side that are as long as something of the other's
    are listed, which grows with the length of names and not with the product of the sides.
    """
    rows = stored(keys.select("key").distinct().where("length(key) > 0"))
    known = stored(known.select("name", "value").where("length(name) > 0"))
    (names,), (bare,) = lengths(known, F.col("name")), lengths(rows, F.regexp_replace("key", suffix, ""))
    met = rows.select("key", F.inline(asked(F.col("key"), names, suffix=suffix))).join(known.select("*", F.inline(offered(F.col("name"), bare))), ["side", "meet"])
    best = met.groupBy("key").agg(F.min_by(F.struct("tier", "name", "value"), F.struct(F.col("tier"), -F.length("name"), F.col("name"))).alias("m"))
    return rows.join(best, "key", "left").select("key", "m.tier", "m.name", "m.value")


#: Length of the pieces by which names meet that hold each other: the shorter of such two has four characters at least.
PIECE = 4
#: So many names of a block's smaller side are compared with all of the other.
FEW = 32


def _meeting_keys(name: Column, own: str, other: str) -> Column:
    """Keys that two names share if they share a word, are equal when normalised, or one holds the other and isn't twice as long.

    A name's first piece is marked as its own, all its pieces as what the other side's first may be: so keys grow with
    a name's length. They are hashes; names that meet by chance are told apart when they are compared.
    """
    low = F.lower(name)
    pieces = F.when(F.length(low) >= PIECE, F.transform(F.sequence(F.lit(1), F.length(low) - PIECE + 1), lambda i: F.xxhash64(F.lit(other), F.substr(low, i, F.lit(PIECE)))))
    words = F.transform(T.tokens(name), lambda t: F.xxhash64(F.lit("t"), t))
    one = F.array(F.xxhash64(F.lit("="), T.item_name(name)), F.xxhash64(F.lit(own), F.substr(low, F.lit(1), F.lit(PIECE))))
    return F.array_distinct(F.concat(words, one, F.coalesce(pieces, F.array().cast("array<bigint>"))))


def _traits(name: Column) -> list[Column]:
    """What two names that aren't equal but for case are compared by."""
    return [F.lower(name).alias("low"), C.keyword(name).alias("kind"), T.item_name(name).alias("item"), T.tokens(name).alias("words")]


def _tier(a: Column, b: Column, x: Column, y: Column, score: Column) -> Column:
    """How two names with their traits and the Jaccard of their words match; null where they don't."""
    alike = F.coalesce(x["kind"] == y["kind"], F.lit(True))
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = (x["low"].contains(y["low"]) | y["low"].contains(x["low"])) & (F.length(a) >= 8) & (2 * short >= long)
    return F.when(alike & (x["item"] == y["item"]), 3).when(alike & inside, 4).when(alike & (score > 0.5), 5)


def matches(wanted: Column, offered: Column) -> Column:
    """match_names of two arrays of names within one row: (a, b) of each distinct wanted name that has one."""
    told = lambda names: F.array_distinct(F.filter(names, lambda n: n.isNotNull()))

    def same(a: Column, bs: Column) -> Column:
        equal = F.filter(bs, lambda b: b["low"] == F.lower(a))
        return F.array_min(F.transform(equal, lambda b: F.struct((b["b"] != a).alias("tier"), b["b"].alias("b"))))["b"]

    def alike(a: Column, bs: Column) -> Column:
        common = lambda b: F.size(F.array_intersect(a["words"], b["words"]))
        score = lambda b: T.let(common(b), lambda n: T.let(F.size(a["words"]) + F.size(b["words"]) - n, lambda m: F.when(m == 0, F.lit(1.0)).otherwise(n / F.greatest(m, F.lit(1)))))
        row = lambda b: T.let(score(b), lambda s: F.struct(_tier(a["a"], b["b"], a, b, s).alias("tier"), (-F.round(s, 6)).alias("by"), b["b"].alias("b")))
        best = F.array_sort(F.filter(F.transform(bs, row), lambda x: x["tier"].isNotNull()))
        tied = lambda x: F.coalesce((F.get(x, F.lit(1))["tier"] == F.get(x, F.lit(0))["tier"]) & (F.get(x, F.lit(1))["by"] == F.get(x, F.lit(0))["by"]), F.lit(False))
        return T.let(best, lambda x: F.when(~tied(x), F.get(x, F.lit(0))["b"]))

    def further(names: Column, bs: Column) -> Column:
        own = lambda d, n: F.transform(d, lambda x: F.struct(x.alias(n), *_traits(x)))
        return T.let(own(F.transform(bs, lambda b: b["b"]), "b"), lambda rich: F.transform(own(names, "a"), lambda a: F.struct(a["a"].alias("a"), alike(a, rich).alias("b"))))

    def all_of(bs: Column) -> Column:
        first = F.transform(told(wanted), lambda a: F.struct(a.alias("a"), same(a, bs).alias("b")))
        left = lambda x: F.transform(F.filter(x, lambda m: m["b"].isNull()), lambda m: m["a"])
        return T.let(first, lambda x: F.when(F.exists(x, lambda m: m["b"].isNull()), F.concat(x, further(left(x), bs))).otherwise(x))

    every = T.let(F.transform(told(offered), lambda b: F.struct(b.alias("b"), F.lower(b).alias("low"))), all_of)
    return F.filter(every, lambda m: m["b"].isNotNull())


def match_names(wanted: DataFrame, offered: DataFrame, block: str) -> DataFrame:
    """For each wanted (block, a_id, a) the one offered (block, b) of the best tier, or none if that tier ties.

    Tiers: equal; equal but for case (the first by name); then among names of no other category: normalised; one
    holds the other (the wanted one of 8 characters at least, half as long at least); words' Jaccard above one half.
    Within the last three the best Jaccard counts. Names are compared once each within a block. What is equal but for
    case is found first; only names that are left, and the blocks that have such, are compared further: with all of a block
    where one side has FEW at most, which is fewer rows than keys; else with those that share a key. Either grows with the names.
    """
    a = stored(wanted.select(block, "a", F.lower("a").alias("_low")).where("a is not null").distinct())
    b = stored(offered.select(block, "b", F.lower("b").alias("_low")).where("b is not null").distinct())
    equal = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
    same = stored(a.join(b, [block, "_low"]).groupBy(block, "a").agg(F.min(F.struct(equal.alias("tier"), "b")).alias("m"), F.first("_low").alias("_low")))
    exact = same.select(block, "a", "m.tier", F.round(T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("m.b"))), 6).alias("score"), "m.b")
    own = lambda d, n: d.select(block, n, F.struct(*_traits(F.col(n))).alias(f"of_{n}"))
    a = stored(own(a.join(same.select(block, "a"), [block, "a"], "left_anti"), "a"))
    b = own(b.join(a.select(block).distinct(), block, "left_semi"), "b")
    least = a.groupBy(block).agg(F.count("*").alias("n")).join(b.groupBy(block).agg(F.count("*").alias("m")), block).withColumn("least", F.least("n", "m"))
    few, many = (stored(d.join(least.select(block, "least"), block)) for d in (a, b))
    met = few.where(f"least <= {FEW}").drop("least").join(many.where(f"least <= {FEW}").drop("least"), block)
    keyed = few.where(f"least > {FEW}").withColumn("t", F.explode(_meeting_keys(F.col("a"), "<", ">"))).drop("least").join(many.where(f"least > {FEW}").withColumn("t", F.explode(_meeting_keys(F.col("b"), ">", "<"))).drop("least"), [block, "t"])
    met = met.unionByName(keyed.drop("t").dropDuplicates([block, "a", "b"]))
    score = T.jaccard(F.col("of_a.words"), F.col("of_b.words"))
    scored = met.select(block, "a", "b", _tier(F.col("a"), F.col("b"), F.col("of_a"), F.col("of_b"), score).alias("tier"), F.round(score, 6).alias("score")).where("tier is not null")
    top = scored.groupBy(block, "a").agg(F.min("tier").alias("tier"))
    best = scored.join(top, [block, "a", "tier"]).groupBy(block, "a", "tier", "score").agg(F.min("b").alias("b"), F.count("*").alias("n"))
    best = best.groupBy(block, "a", "tier").agg(F.max(F.struct("score", "b", "n")).alias("m"))
    found = exact.unionByName(best.where("m.n = 1").select(block, "a", "tier", "m.score", "m.b"))
    return wanted.join(found, [block, "a"], "left")


def assign_once(pairs: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """Each left takes its right if no earlier left has it; no second choice."""
    w = Window.partitionBy(block, right).orderBy(left)
    return pairs.where(F.col(right).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def typo_pairs(names: DataFrame, block: str) -> DataFrame:
    """Pairs a < b of a block's names at edit distance 1.

    Names at distance 1 are equal when some one character is left out of the
    longer or of both, so names meet by an equi-join on what is left.
    """
    rows = names.select(block, "name").distinct()
    less = F.transform(F.sequence(F.lit(0), F.length("name")), lambda i: F.when(i == 0, F.col("name")).otherwise(F.concat(F.substr(F.col("name"), F.lit(1), i - 1), F.substr(F.col("name"), i + 1))))
    keys = rows.withColumn("k", F.explode(F.array_distinct(less)))
    met = keys.select(block, "k", F.col("name").alias("a")).join(keys.select(block, "k", F.col("name").alias("b")), [block, "k"]).where("a < b")
    return met.select(block, "a", "b").distinct().where(F.levenshtein("a", "b") == 1)


def jaccard_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard of the token sets of every row of left (a, text) with every row of right (b, text), where they share a token.

    Rows meet by an equi-join on tokens; intersections are counted, unions follow from the sizes.
    """
    sides = [(left, a, "ra", "n"), (right, b, "rb", "m")]
    x, y = (d.select(k, F.monotonically_increasing_id().alias(r), T.tokens(F.col("text")).alias("t")).select(k, r, F.size("t").alias(n), F.explode("t").alias("t")) for d, k, r, n in sides)
    both = x.join(y, "t").groupBy("ra", "rb", a, b, "n", "m").agg(F.count("*").alias("k"))
    return both.select(a, b, F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))


def typo_candidates(families: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs a < b at edit distance 1 of the names in a category of a maker, case aside, neither of which is known.

    families are (category, manufacturer, name), known ones (manufacturer, name); null is a blank maker or category.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit(""))).alias(c)
    new = families.select(F.coalesce("category", F.lit("")).alias("category"), low("manufacturer"), low("name")).join(known.select(low("manufacturer"), low("name")), ["manufacturer", "name"], "left_anti")
    pairs = typo_pairs(new.select(F.struct("category", "manufacturer").alias("block"), "name"), "block")
    return pairs.select("block.category", "block.manufacturer", "a", "b")
