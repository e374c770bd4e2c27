"""Mended words and fields, annotation tiers, boxes and small functions by cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import annotation, boxes, healing, quantity, views


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "want"), [
    ("Continuous Hi nge", "Continuous Hinge"), ("Protection Pla te", "Protection Plate"), ("Electrified Mortis e L ock", "Electrified Mortise Lock"), ("Closer by others", "Closer by others"),
    ("4 x 4 Hinge", "4 x 4 Hinge"), ("Door C", "DoorC"), ("A B", "AB"), ("C 4", "C 4"), ("lockset unlocks", "lockset unlocks"), ("", ""), (None, ""), ("É t é", "Été"), ("one", "one"),
])
def test_healed(spark, given, want):
    assert value(spark, healing.healed(F.lit(given).cast("string"))) == want


@pytest.mark.parametrize(("given", "want"), [
    (("Kick Plate 8400 626 IV", "", "", ""), ("Kick Plate", "IV", "8400", "626")), (("Continuous Hi", "nge", "780", "AL"), ("Continuous Hinge", "", "780", "AL")), (("Hinge", "IV", "5BB1", "x y"), ("Hinge", "IV", "5BB1", "x y")),
    (("Hinge 12 RH", "", "", ""), ("Hinge", "", "12 RH", "")), (("5BB1 626", "", "", None), ("5BB1", "", "", "626")), (("Hinge", None, None, None), ("Hinge", None, None, None)), (("Gasket", "Z", "", ""), ("GasketZ", "", "", "")), ((None, "", "", ""), ("", "", "", "")),
])
def test_mended(spark, given, want):
    rows = spark.createDataFrame([given], "name string, manufacturer string, model string, finish string")
    assert tuple(healing.mended(rows, ["IV"]).first()) == want


def test_divisors(spark):
    sets = spark.createDataFrame([(1, "A1", "A", 2, 3), (1, "B1", "B", 0, 0), (1, "C1", "G", 0, 0), (1, "D1", None, 0, 0), (1, "E1", None, 0, 0), (2, "B1", None, None, None), (1, None, None, 5, 5)], "p int, set_id string, generic_id string, heading_doors int, heading_leaves int")
    openings = spark.createDataFrame([(1, "b1", "x", 2), (1, "B1", None, 1), (1, "", "g", 1), (1, None, "d-1.2", 2), (1, "A1", "", 1)], "p int, hw_heading string, hw_set string, leaf_count int")
    got = {(r["p"], r["set_id"]): (r["doors"], r["leaves"], r["origin"]) for r in annotation.divisors(sets, openings, "p").collect()}
    assert got == {(1, "A1"): (2, 3, "heading"), (1, "B1"): (2, 3, "opening"), (1, "C1"): (1, 1, "generic"), (1, "D1"): (1, 2, "crossed"), (1, "E1"): (0, 0, "none"), (2, "B1"): (0, 0, "none")}


def test_annotated(spark):
    sets = spark.createDataFrame([(1, "A", "A", 6, 12, "unknown"), (1, "B", "B", 4, 4, "per_opening"), (1, "C", "C", 1, 1, "unknown")], "p int, set_id string, generic_id string, heading_doors int, heading_leaves int, convention string")
    rows = [("A", "Hinge", 42), ("A", "Closer", 6), ("A", "Threshold", 3), ("A", "Lockset RHR", 6), ("A", "Lockset LHR", 6), ("A", "Auto Operator", 6), ("A", "Hinge x", None), ("B", "Hinge", 12), ("C", "Hinge", 9), ("C", "Closer", 1)]
    items = spark.createDataFrame([(1, s, i, n, "", q) for i, (s, n, q) in enumerate(rows)], "p int, set_id string, pos int, name string, model string, qty int")
    openings = spark.createDataFrame([], "p int, hw_heading string, hw_set string, leaf_count int")
    got = {(r["set_id"], r["name"]): (r["qty_source"], r["qty_total"], r["divisor"]) for r in annotation.annotated(items, sets, openings, "p").collect()}
    assert got == {
        ("A", "Hinge"): ("needs_division", 42, 12), ("A", "Closer"): ("needs_review", 6, 6), ("A", "Threshold"): ("parsed", 3, 6), ("A", "Lockset RHR"): ("rhr_lhr_pair", 6, 6), ("A", "Lockset LHR"): ("rhr_lhr_pair", 6, 6),
        ("A", "Auto Operator"): ("needs_division", 6, 6), ("A", "Hinge x"): ("parsed", None, None), ("B", "Hinge"): ("parsed", 12, 4), ("C", "Hinge"): ("needs_cap", 9, None), ("C", "Closer"): ("parsed", None, None),
    }


def test_normalised_sources(spark):
    rows = spark.createDataFrame([(6, "rhr_lhr_pair"), (6, "needs_review"), (42, "needs_division"), (5, "llm_override")], "qty long, qty_source string").selectExpr("*", "12 AS divisor", "5 AS most", "true AS is_hinge")
    got = [(r["qty"], r["qty_source"], r["qty_total"]) for r in quantity.normalise(rows).collect()]
    assert got == [(1, "divided", 6), (6, "flagged", None), (4, "divided", 42), (5, "llm_override", None)]


def test_within(spark):
    words = [(1, i, float(x), float(x + w), float(y), float(y + 8)) for i, (x, y, w) in enumerate((x, y, w) for x in range(-40, 200, 13) for y in range(0, 90, 9) for w in (0, 5, 60))] + [(None, 9999, 0.0, 1.0, 0.0, 1.0)]
    regions = [(k, 1, float(a), float(b), float(c), float(d)) for k, (a, b, c, d) in enumerate([(0, 64, 0, 64), (-50, 500, -5, 500), (10, 11, 0, 90), (-40, -40, 0, 8), (5, 4, 0, 9), (63.5, 129, 8, 26)])]
    w = spark.createDataFrame(words, "page int, word_id int, x0 double, x1 double, top double, bottom double")
    r = spark.createDataFrame(regions, "region_id int, page int, x0 double, x1 double, top double, bottom double")
    got = {(x["region_id"], x["word_id"]) for x in boxes.within(r, w).collect()}
    assert got == {(k, i) for k, p, a, b, c, d in regions for q, i, x0, x1, top, bottom in words if p == q and a <= x0 and x1 <= b and c <= top and bottom <= d and a <= b}
    assert boxes.within(r.where("false"), w).collect() == []


def test_natural_order(spark):
    names = ["D2", "D10", "D1000000009", "D200000000", "D10000000000000000001", "d3", "D02b", "D2a", "", "10", "A"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(views.natural_key(F.col("n")), "n").collect()]
    assert got == ["", "10", "A", "D2", "D2a", "D02b", "d3", "D10", "D200000000", "D1000000009", "D10000000000000000001"]


@pytest.mark.parametrize(("given", "want"), [("3/4 HOUR", None), ("door, 90 min rated", "90 MIN"), ("1.5 hr", "1.5 HR"), ("4 hours", None), ("20Min", "20MIN"), (None, None)])
def test_fire_rating(spark, given, want):
    assert value(spark, T.fire_rating(F.lit(given).cast("string"))) == want


def test_words_are_moved_once_to_regions(spark):
    """Words are shuffled by page and laid into squares there, and a region's text needs no second join."""
    words = spark.createDataFrame([(p, p * 10 + i, 5.0 * i, 5.0 * i + 4, 0.0, 9.0, f"w{i}") for p in (1, 2) for i in range(4)] + [(None, 99, 0.0, 1.0, 0.0, 1.0, "x")], "page long, word_id long, x0 double, x1 double, top double, bottom double, text string")
    regions = spark.createDataFrame([(7, 1, 0.0, 10.0, 0.0, 9.0), (8, 1, 0.0, 900.0, -1.0, 900.0), (9, 2, 4.0, 15.0, 0.0, 10.0), (6, None, 0.0, 1.0, 0.0, 1.0)], "region_id long, page long, x0 double, x1 double, top double, bottom double")
    got = boxes.region_texts(regions, words)
    assert {(x["region_id"], x["n"], x["text"]) for x in got.collect()} == {(7, 2, "w0 w1"), (8, 4, "w0 w1 w2 w3"), (9, 2, "w1 w2")}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2
