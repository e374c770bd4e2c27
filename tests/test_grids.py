"""Tables found by content: cases of headers, thresholds and folds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import grids


def cells(spark, *tables: list[list]):
    rows = [(t, t, r, c, x) for t, table in enumerate(tables) for r, row in enumerate(table) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "page long, table_id long, row int, col int, cell string")


def doors(n: int, at: int = 0) -> list[list]:
    return [[f"{100 + i}A", "DH1", "LH"] for i in range(at, at + n)]


def found(spark, *tables) -> dict:
    out = {}
    for r in grids.detected(cells(spark, *tables)).collect():
        out.setdefault((r["table_id"], r["header"]), {})[r["field"]] = r["col"]
    return out


def test_detected(spark):
    whole = {"door_number": 0, "hw_set": 1, "hand": 2}
    got = found(spark, [["Index", "x", "y"], *doors(8)], [["Index", "x", "y"], *doors(7)], [["a", "b", "c"], *doors(4), *doors(4)], [["a", "b", "c"], *([["101A", "DH1", "LH"]] * 9)])
    assert got == {(0, 0): whole}  # the others have seven rows, four doors, and one


def test_header_in_a_later_row(spark):
    """Text in most cells of the first rows' samples can't spoil eight and more of doors, and few filled columns are named by their headers."""
    noise = [["Door index of the tower", None, None], ["Opening", "Group", "Handing"]]
    table = [*noise, *[[d, s, h if i < 3 else ""] for i, (d, s, h) in enumerate(doors(9))]]
    (((_, header), got),) = found(spark, table).items()
    assert header == 0 and got["door_number"] == 0 and got["hw_set"] == 1


def test_named_by_header(spark):
    table = [["No.", "Set", "Handing", "Handing"], *[[d, s, "", ""] for d, s, _ in doors(9)]]
    assert found(spark, table) == {(0, 0): {"door_number": 0, "hw_set": 1, "hand": 2}}


def test_nothing(spark):
    empty = cells(spark).where("false")
    assert grids.detected(empty).collect() == [] and grids.schedules(empty).collect() == [] and grids.confidences(empty).collect() == []


def test_one_to_one(spark):
    c = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("col")) for f, k in [("a", 1), ("b", 1), ("a", 2), ("b", 2), ("c", 1)]))
    assert [tuple(x) for x in spark.range(1).select(grids.one_to_one(c)).first()[0]] == [("a", 1), ("b", 2)]


@pytest.mark.parametrize(("rows", "page"), [
    ([["1.1A", "DH1", "Room a"]] * 3, True), ([["1.1A", "DH1", "Room a"]] * 2, False), ([["x y", "DH1", "Room a"]] * 4, False),
    ([["101A", "DH1", "5 Main Street"]] * 3, False), ([["101A", "DH1", "5 Main Street"], ["101B", "DH1", "x"], ["101C", "", ""], ["101D", None, "a@b.org"]], True),
])
def test_schedules(spark, rows, page):
    got = grids.schedules(cells(spark, [["Opening", "HW Set", "Location"], *rows])).collect()
    assert bool(got) == page


@pytest.mark.parametrize(("given", "want"), [
    ("1.01.A.06A—", "1.01.A.06A"), ("a–‒-", "a"), ("a\x7fb\x01c", "abc"), ("a‖b║", "a b"), ("line\n  two ", "line\n two"), ("â\u0080\u0093 x Â½", "– x 1⁄2"),
    ("(cid:12)x", "x"), ("ﬁre", "fire"), (None, ""), ("   ", ""), ("Ã©tÃ©", "été"), ("tab\there", "tab\there"),
])
def test_clean_cell(spark, given, want):
    assert spark.range(1).select(T.clean_cell(F.lit(given).cast("string")).alias("v")).first()["v"] == want
