"""Sets meet all names of openings in one join, by beginnings that the other side has; against a plain version, and what is moved."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from jambwork.operators import annotation, linkage
from jambwork.plans import texts

SETS = "p int, set_id string, generic_id string, heading_doors int, heading_leaves int"
OPENINGS = "p int, hw_heading string, hw_set string, leaf_count int"


def plan(rows) -> str:
    return rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def looked_up(key, names):
    bare = re.sub("[:-](WI|EX|OPP)$", "", key)
    tiers = [(1, n) for n in names if n == key] + [(2, n) for n in names if n == bare] + [(3, n) for n in names if bare.startswith(n) or n.startswith(bare)]
    return min(tiers, key=lambda x: (x[0], -len(x[1]), x[1]), default=None)


def expected(sets, openings):
    out = {}
    for p, s, g, doors, leaves in sets:
        if s is None:
            continue
        if doors and doors > 0:
            out[p, s] = (doors, leaves, "heading")
            continue
        mine = [o for o in openings if o[0] == p]
        found = None
        for origin, key, at in (("opening", s, 1), ("generic", g if g and g.strip() else s, 2)):
            names = {(o[at] or "").strip().upper() for o in mine} - {""}
            hit = looked_up(key.strip().upper(), names) if key.strip() else None
            if hit and not found:
                own = [o for o in mine if (o[at] or "").strip().upper() == hit[1]]
                found = (len(own), sum(o[3] for o in own), origin)
        plain = lambda v: re.sub(r"[\s\-_]+", "", (v or "").lower())
        own = [o for o in mine if plain(s) and (plain(o[1]).startswith(plain(s)) or plain(o[2]).startswith(plain(s)))]
        out[p, s] = found or ((len(own), sum(o[3] for o in own), "crossed") if own else (0, leaves or 0, "none"))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_divisors_as_said(spark, seed):
    dice = random.Random(seed)
    names = ["", " ", None, ":WI", "-EX", "A", "a", "AB", "ab-1", "AB:EX", "AB-1:WI", "A B", "AB1", "abc", "ABCD", "B", "b-1", "B1X", "B_1", "-", "Straße", "STRASSE", "é", "É1"]
    sets = [(p, s, dice.choice(names), dice.choice([None, 0, 0, 0, 3]), dice.choice([None, 0, 5])) for p in range(4) for s in [None, *names[3:]] if dice.random() < 0.8]
    openings = [(dice.choice([0, 1, 2, 3, 9]), dice.choice(names), dice.choice(names), dice.choice([1, 2])) for _ in range(25)]
    got = annotation.divisors(spark.createDataFrame(sets, SETS), spark.createDataFrame(openings, OPENINGS), "p").collect()
    assert {(r["p"], r["set_id"]): (r["doors"], r["leaves"], r["origin"]) for r in got} == expected(sets, openings)


def test_only_beginnings_that_the_other_side_has(spark):
    listed = lambda c: [tuple(x)[:2] for x in spark.range(1).select(c.alias("c")).first()["c"]]
    assert listed(linkage.asked(F.lit("H012:WI"), [4])) == [(0, "H012")]
    assert listed(linkage.asked(F.lit("H012"), [2, 6])) == [(0, "H0"), (1, "H012")]
    assert listed(linkage.offered(F.lit("H012-X"), [4, 6, 9])) == [(0, "H012-X"), (1, "H012")]
    assert listed(linkage.asked(F.lit("H012"), [])) == []


def test_tiers_meet_in_one_join(spark):
    keys = spark.createDataFrame([("AB:EX",), ("AB",), ("ABCD",), ("X",), ("",), (None,)], "key string")
    got = linkage.tiered_lookup(keys, spark.createDataFrame([("AB", 1), ("ABC", 2), ("AB:EX", 3), ("", 4)], "name string, value int"))
    assert {tuple(r) for r in got.collect()} == {("AB:EX", 1, "AB:EX", 3), ("AB", 1, "AB", 1), ("ABCD", 3, "ABC", 2), ("X", None, None, None)}
    assert plan(got).count("Join") == 2  # with names, and back to all keys


def test_items_of_sets_are_moved_twice(spark, sf):
    """To their openings and to their set; totals, windows and the divisors come to them there, sorted once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        said = plan(texts.m05_set_quantities(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = said.splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    items = list(itertools.takewhile(lambda line: line[lines[join].index("+-") + 3] == ":", lines[join + 1 :]))
    has = lambda what: sum(f"- {what} " in line for line in items)
    assert (has("Window"), has("Exchange"), has("Sort")) == (2, 3, 3)  # both sides of the join with openings, and their sets
