"""Items, sections and doors of schedule lines by cases, and against an automaton that reads line by line."""

from __future__ import annotations

import random
import re

import pytest

from jambwork.operators import grammar


def frame(spark, pages: dict[int, list[str | None]]):
    return grammar.sectioned(spark.createDataFrame([(p, i, t) for p, lines in pages.items() for i, t in enumerate(lines)], "page long, line long, text string"))


def items(spark, *lines) -> list[tuple]:
    rows = grammar.items(frame(spark, {1: list(lines)})).orderBy("section", "line").collect()
    return [(r["set_id"], r["qty"], r["qty_total"], r["name"], r["manufacturer"], r["model"], r["finish"]) for r in rows]


def test_specworks(spark):
    got = items(spark, "Heading A1 (HwSet 7)", "( 9) 9 EA Too early 12", "Each Assembly to have:", "( 6) 3 EA HINGE FULL MORTISE 5BB1 4.5 652 IVE", "HEI: ask", "HVY", None, "WT", "( 2) 1 SET Seal, AL zer", "( 1) 1 EA Lever L9010 03A", "Project: x", "( 4) 4 EA Too late")
    assert got == [("A1", 3, 6, "HINGE FULL MORTISE HVY WT", "IVE", "5BB1 4.5", "652"), ("A1", 1, 2, "Seal", "ZER", "", "AL"), ("A1", 1, 1, "Lever", "", "L9010 03A", "")]


@pytest.mark.parametrize(("lines", "want"), [
    (["3 EA Hinge, Hvy 5BB1 4-1/2 US26D 630 (HI-1) Ives", "Wt"], (3, "Hinge, Hvy Wt", "Ives", "5BB1 4-1/2", "US26D 630")),
    (["1 EA Threshold 625A x 36\" (TH-10) Zero", "International"], (1, "Threshold", "Zero International", '625A x 36"', "")),
    (["1 ea Closer 4040XP AL (CL-3)", "Norton Door", "Arm"], (1, "Closer Arm", "Norton Door", "4040XP", "AL")),
    (["1 EA Closer (CL-3)", "per plan", "Norton"], (1, "Closer", "", "", "")),
    (["1 EA Closer (CL-3) LCN", "long", "Please ask", "more"], (1, "Closer long", "LCN", "", "")),
    (["1 EA Closer (CL-3) LCN", "At header only", "3' 0\" x 7' 0\"", "long"], (1, "Closer long", "LCN", "", "")),
    (["2 PR Bolt by others", "FB51T set"], (2, "Bolt by others", "", "FB51T set", "")),
    (["2 PR 626 (AB-1) X"], (2, "", "X", "", "626")),
])
def test_esc(spark, lines, want):
    (got,) = items(spark, "Heading #: E1-XL.1", "1 SGL DOOR(S)1.01.A.02 LH", *lines)
    assert (got[1], *got[3:]) == want


def test_generic(spark):
    got = items(spark, "Hardware Set 4", "3  Hinges  Ives  5BB1  626", "12 Lockset\tND80", "100 Hinges", "3 widgets", "Hinge 3", "HW Set 5", "1 Closer  LCN")
    assert got == [("4", 3, None, "Hinges", "Ives", "5BB1", "626"), ("4", 12, None, "Lockset", "ND80", "", ""), ("5", 1, None, "Closer", "LCN", "", "")]


def test_sections(spark):
    pages = {1: ["For 2 Single Doors #", "Heading #X1 (Set A)", "For 3 Pair Doors #", "1 Hinge", "Hardware Set B", "1 Hinge"], 2: ["no heading", "1 Hinge"], 3: ["x", "Heading #: Q1", "2 PR DOOR:1.01.A.02", "1 SGL DOOR(S)1.01.A.03Room", "Heading #: Q2"], 4: [None, "", "  "]}
    got = grammar.section_counts(frame(spark, pages)).orderBy("page", "section").collect()
    assert [(r["page"], r["set_id"], r["generic_id"], r["doors"], r["leaves"]) for r in got] == [(1, "X1", "A", 3, 6), (1, "B", "B", 2, 2), (3, "Q1", "Q1", 3, 5), (3, "Q2", "Q2", 0, 0)]


def test_doors(spark):
    got = grammar.doors(frame(spark, {1: ["Heading #: Q1", "2 PRA/PRI Door:1.01.A.02BLobby RHRA x", "1 SGL DOOR(S)12.01.Z.x9", "1 SGL DOORS 3"]})).orderBy("line").collect()
    assert [(r["door_number"], r["n"], r["leaves"], r["door_type"], r["hand"]) for r in got] == [("1.01.A.02B", 2, 4, "PR", "RHRA"), ("12.01.Z.x9", 1, 1, "SGL", "")]


def test_once(spark):
    got = grammar.once(grammar.items(frame(spark, {1: ["Hardware Set 4", "1 Cont. Hinge", "2 continuous  hinge", "1 Closer  A", "1 Closer  B", "3 Closer  LCN  x1  AL", "4 Pull  LCN  X1  AL"]}))).orderBy("line").collect()
    assert [(r["qty"], r["name"], r["manufacturer"], r["model"]) for r in got] == [(1, "Cont. Hinge", "", ""), (2, "continuous", "hinge", ""), (1, "Closer", "A", ""), (3, "Closer", "LCN", "x1")]


def test_nothing(spark):
    assert items(spark) == [] and grammar.section_counts(frame(spark, {})).collect() == []


def automaton(lines: list[str]) -> list[tuple]:
    """(line, lines that go on with it) of the items of one page of the first two formats, read line by line."""
    spec = any(re.search(grammar.SPECWORKS_PAGE, x) for x in lines)
    headings = [i for i, x in enumerate(lines) if re.match(grammar.SECTION, x)]
    starts = [0] if spec or len(headings) < 2 else headings
    out = []
    for a, b in zip(starts, [*starts[1:], len(lines)], strict=True):
        item, listed = None, not spec
        for i in range(a, b):
            x = lines[i]
            if re.match(grammar.SPECWORKS_END if spec else grammar.ESC_END, x):
                break
            if spec and re.search(grammar.BEGIN, x):
                listed = True
            elif not x or not listed or (x.startswith("HEI:") if spec else re.search(grammar.ESC_SKIP, x) or re.match(grammar.DOOR, x)):
                continue
            elif re.match(grammar.SPECWORKS_ITEM if spec else grammar.ESC_ITEM, x):
                item = (i, [])
                out.append(item)
            elif item:
                item[1].append(i)
    return out


def test_as_read_line_by_line(spark):
    r = random.Random(6)
    some = ["( 2) 1 EA Hinge 5BB1 626 IVE", "3 EA Closer 4040 (CL-1) LCN", "Wt", "more words", "", "HEI: x", "Totals each assembly", "Project: y", "Supplier: z", "1 SGL DOOR(S)1.01.A.02 LH", "Phase: 2", "Heading #: E2", "at header"]
    pages = {p: [r.choice(["Heading A1 (HwSet 7)", "Heading #: E1"]), *(r.choice(some) for _ in range(r.randrange(1, 30)))] for p in range(80)}
    got = grammar._opened(frame(spark, pages)).where("item > 0").groupBy("page", "section", "item").agg({"line": "collect_list"}).collect()
    got = sorted((g["page"], *sorted(g["collect_list(line)"])) for g in got)
    assert got == sorted((p, i, *rest) for p, lines in pages.items() for i, rest in automaton(lines))


def test_lines_are_sorted_once_for_pages_and_once_for_sections(spark):
    got = grammar.items(frame(spark, {1: ["HEADING #: A1", "2 EA Hinge 5BB1 626 (HI-1) Ives"], 2: ["Hardware SET B2", "3  Wall Stop  Ives  WS406  626"]}))
    assert {(r["page"], r["set_id"], r["qty"], r["name"]) for r in got.collect()} == {(1, "A1", 2, "Hinge"), (2, "B2", 3, "Wall Stop")}
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 2


def test_repeats_are_told_where_the_page_is(spark):
    """A page's lines are moved once: items are counted by section and key in the partition where they have been read."""
    lines = {1: ["Hardware Set 4", "", "1 Cont Hinge", None, "2 continuous hinge", "1 Door Closer", "Hardware Set 5", "3 Cont Hinge"], 2: ["Hardware Set 4", "1 Thresh Plate", "1 threshold plate"]}
    got = grammar.once(grammar.items(frame(spark, lines)))
    assert sorted((r["page"], r["section"], r["line"], r["qty"], r["name"]) for r in got.collect()) == [(1, 1, 2, 1, "Cont Hinge"), (1, 1, 5, 1, "Door Closer"), (1, 2, 7, 3, "Cont Hinge"), (2, 1, 1, 1, "Thresh Plate")]
    plan = got.groupBy("page").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
