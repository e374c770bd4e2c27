"""Exclusive matching against turns taken one after another, and items of two sources."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from jambwork.operators import linkage, matching, quality


def in_turn(pairs: list[tuple]) -> set:
    """(block, a, b) of pairs (block, a, b, turn, choice), each b in its turn taking the best a that is left."""
    taken, out = set(), set()
    for block, turn, b in sorted({(p[0], p[3], p[2]) for p in pairs}):
        free = sorted((p[4], p[1]) for p in pairs if p[0] == block and p[2] == b and (block, p[1]) not in taken)
        if free:
            taken.add((block, free[0][1]))
            out.add((block, free[0][1], b))
    return out


def test_exclusive(spark):
    r = random.Random(8)
    pairs = [(block, f"a{a}", f"b{b}", b, c) for block in range(12) for b in range(r.randrange(1, 14)) for c, a in enumerate(r.sample(range(8), r.randrange(1, 8)))]
    got = matching.exclusive(spark.createDataFrame(pairs, "block int, a string, b string, turn int, choice int"), ["block"])
    assert {(x["block"], x["a"], x["b"]) for x in got.collect()} == in_turn(pairs)


def test_chain_of_refusals(spark):
    """Each b wants what the one before it got: the last is refused again and again."""
    pairs = [(1, a, b, b, a) for b in range(9) for a in range(9)]
    got = matching.exclusive(spark.createDataFrame(pairs, "block int, a int, b int, turn int, choice int"), ["block"])
    assert {(x["a"], x["b"]) for x in got.collect()} == {(i, i) for i in range(9)}
    assert matching.exclusive(spark.createDataFrame([], "block int, a int, b int, turn int, choice int"), ["block"]).collect() == []


def sets(spark, *rows):
    return spark.createDataFrame([(1, s, i, h) for i, (s, h) in enumerate(rows)], "project int, set_id string, pos int, heading string")


def test_matched_sets(spark):
    left = sets(spark, ("A1", "x"), ("b-2", "y"), ("B 2", "y"), ("c", "office doors"), ("d", "office doors wide"), (None, "office"))
    right = sets(spark, ("A1", "other"), ("b_2", ""), ("B2", ""), ("r1", "office doors wide"), ("r2", "office doors wide"), ("r3", "office doors wide"), ("r4", None))
    got = {(r["a"], r["b"], r["tier"]) for r in matching.matched_sets(left, right, ["project"]).collect()}
    assert got == {("A1", "A1", 1), ("B 2", "b_2", 2), ("d", "r1", 3), ("c", "r2", 3)}


def test_reconciled_items(spark):
    schema = "block int, pos int, name string, qty int, manufacturer string, model string, finish string"
    left = spark.createDataFrame([(1, 1, "Hinge", 3, "", "5BB1", "626"), (1, 2, "Closer", 1, "LCN", "", ""), (1, 3, "Hinge", 9, "", "", "")], schema)
    right = spark.createDataFrame([(1, 1, "HINGE", 3, "Ives", "5bb1", "630"), (1, 2, "hinge", 1, "", "", ""), (1, 3, "Wall Stop", None, None, "x", "")], schema)
    got = {(r["a_pos"], r["b_pos"]): r for r in matching.reconciled_items(left, right, "block").collect()}
    assert set(got) == {(1, 1), (2, None), (3, None), (None, 2), (None, 3)}
    one = got[1, 1]
    assert [tuple(one[f]) for f in matching.FIELDS] == [("Hinge", "full", "a"), ("3", "full", "a"), ("Ives", "single_source", "b"), ("5BB1", "full", "a"), ("630", "conflict", "b")]
    assert one["overall"] == "conflict" and got[2, None]["overall"] == "single_source" and tuple(got[None, 3]["qty"]) == ("", "single_source", "b")


def test_items_of_small_blocks_meet_in_rows_as_by_joins(spark, monkeypatch):
    """Blocks within a row and blocks by joins give the same; items without a block, a name or a position stay, and have no pair."""
    r = random.Random(5)
    some = ["Hinge", "HINGE", "Hinge (2)", "Wall Stop", "wall  stop 406", "Kick Plate", "Kick Plate 8400 x 2", "Closer LH", "closer", "Door Closer LH", "Lockset RHR", "zzz", None, "", "Exit Device", "Device Exit 99"]
    schema = "block int, pos int, name string, qty int, manufacturer string, model string, finish string"
    side = lambda: [(b, p, r.choice(some), r.choice([1, 2, None]), r.choice(["LCN", "lcn", ""]), r.choice(["x", None]), "") for b in [*range(60), None] for p in range(r.randrange(0, 9))]
    left, right = (spark.createDataFrame([*side(), *more], schema) for more in ([(70, 1, "Hinge", 1, "", "", "")], [(71, 1, "Hinge", 1, "", "", ""), (72, None, "Hinge", 1, "", "", "")]))
    every = lambda: sorted(map(str, matching.reconciled_items(left, right, "block").collect()))
    got = {}
    for many in (0, 6, 10_000):
        monkeypatch.setattr(matching, "MANY", many)
        got[many] = every()
    assert got[0] == got[6] == got[10_000] and len([x for x in got[0] if "a_pos=None" not in x and "b_pos=None" not in x]) > 40
    plain = matching.reconciled_items(left.where("block is not null").repartition(4, "block"), right.where("block is not null").repartition(4, "block"), "block")._jdf.queryExecution().executedPlan().toString()
    assert "ENSURE_REQUIREMENTS" not in plain and "Join" not in plain


def test_leaf_sums_ignore_rows_of_the_opening(spark):
    """An electric hinge under the same name doesn't hide three leaves' hinges."""
    openings = spark.createDataFrame([(1, 2)], "opening_id int, leaf_count int")
    rows = [(1, "Hinges", "5BB1", 4, side) for side in ("active", "inactive", "active")]
    items = lambda *more: spark.createDataFrame([*rows, *more], "opening_id int, name string, model string, qty int, leaf_side string")
    for own in (items(), items((1, "Hinges", "5BB1 CON TW8", 4, "active"))):
        assert quality.leaf_violations(openings, own).where(F.col("rule") == "per_leaf_qty_sum_mismatch").count() == 1


def test_keys_grow_with_names_and_blocks_of_any_size_match_alike(spark, monkeypatch):
    """A name of 40 characters has fewer keys than two for each; by all of a block or by keys, the same is found."""
    one = spark.createDataFrame([("x" * 40,)], "a string")
    assert one.select(F.size(linkage._meeting_keys(F.col("a"), "<", ">")).alias("n")).first()["n"] <= 80
    r = random.Random(3)
    word = ["door", "closer", "kickplate", "plate", "hinge (2)", "hinge", "wall", "stop", "lockset 626", "lock"]
    names = lambda: sorted({" ".join(r.sample(word, r.randrange(1, 4))) for _ in range(60)})
    wanted = spark.createDataFrame([("s", x) for x in names()], "block string, a string")
    offered = spark.createDataFrame([("s", x.title()) for x in names()], "block string, b string")
    every = lambda: sorted(map(str, linkage.match_names(wanted, offered, "block").collect()))
    monkeypatch.setattr(linkage, "FEW", 1000)
    first = every()
    monkeypatch.setattr(linkage, "FEW", 0)
    assert every() == first and any("tier=4" in x or "tier=5" in x for x in first)
