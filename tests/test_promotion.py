"""Promotion reads its three results from what is stored once."""

from __future__ import annotations

from jambwork.operators import promotion


def test_doors_meet_once(spark):
    """Items and openings come without another shuffle; rows without a door and doors without an opening keep their items."""
    fields = "hw_set string, hw_heading string, location string, door_type string, frame_type string, fire_rating string, hand string, pdf_page int, leaf_count int"
    own = ("s", "h", "l", "t", "f", "r", "x", 1, None)
    openings = spark.createDataFrame([(1, d, *own, True) for d in ("A", "B", "C", None)], f"project_id long, door_number string, {fields}, is_active boolean")
    items = spark.createDataFrame([(1, "A", "Hinge", 3, "m"), (1, "B", "Hinge", 3, "m"), (1, "B", None, 1, "m"), (1, "Z", "Lost", 1, "m"), (1, None, "Loose", 1, "m"), (None, "A", "Loose", 1, "m")], "project_id long, door_number string, name string, qty int, model string")
    staged = spark.createDataFrame([(7, d, *own) for d in ("A", "B", "D")], f"run_id long, door_number string, {fields}")
    parts = spark.createDataFrame([(7, "A", "Hinge", 4, "m"), (7, "B", "Hinge", 3, "m2"), (7, "D", "Lock", None, "m"), (7, "E", "No door", 1, "m")], "run_id long, door_number string, name string, qty int, model string")
    after, left, counts = promotion.merged(openings, items, spark.createDataFrame([(7, 1)], "run_id long, project_id long"), staged, parts)
    assert {(r["door_number"], r["action"], r["is_active"], r["leaf_count"]) for r in after.collect()} == {("A", "updated", True, 1), ("B", "unchanged", True, 1), ("C", "removed", False, None), (None, "removed", False, None), ("D", "added", True, 1)}
    want = [(1, "A", "Hinge", 4, "m"), (1, "B", "Hinge", 3, "m"), (1, "B", None, 1, "m"), (1, "Z", "Lost", 1, "m"), (1, None, "Loose", 1, "m"), (None, "A", "Loose", 1, "m"), (1, "D", "Lock", None, "m")]
    assert sorted(map(str, left.collect())) == sorted(map(str, spark.createDataFrame(want, items.schema).collect()))
    assert [tuple(r[c] for c in ("run_id", "added", "updated", "unchanged", "deactivated", "items_promoted")) for r in counts.collect()] == [(7, 1, 1, 1, 2, 2)]
    for rows in (after, left):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
