"""Streams that act, tables in versions, and promotions: replays, crashes, refusals, and awkward rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jambwork.functions import taxonomy as C
from jambwork.functions import text as T
from jambwork.operators import grammar, promotion
from jambwork.sources import versions
from jambwork.streaming import live

EVENT = "k string, v int, acted_at timestamp, event_id long"
NOON = datetime(2024, 1, 1, 12)


def at(seconds):
    return NOON + timedelta(seconds=seconds)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_versions(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, v int"
    frame = lambda *r: versions.with_bucket(spark.createDataFrame(list(r), schema), ["k"], 4)
    own = frame().drop("bucket").schema
    assert versions.last(spark, path) is None and versions.current(spark, path, "t", own).isEmpty() and versions.log(spark, path, "t", own).isEmpty()
    first = frame(("a", 1), ("b", 2), (None, 3), ("a", 1))
    assert versions.publish(spark, path, 0, {"t": first}, first)
    second = frame(("a", 9))
    others = rows(first.join(second.select("bucket"), "bucket", "left_anti"), "k", "v")
    with pytest.raises(versions.Refused, match="odd"):  # what a check refuses is not seen, not in the log either
        versions.publish(spark, path, 1, {"t": second}, second, {"odd": lambda t: t["t"].where("v % 2 = 1")})
    assert versions.last(spark, path) == 0 and rows(versions.current(spark, path, "t", own), "k", "v") == rows(first, "k", "v")
    assert versions.publish(spark, path, 2, {"t": second}, second)
    assert not versions.publish(spark, path, 2, {"t": first}, first)
    assert rows(versions.current(spark, path, "t", own), "k", "v") == sorted([*others, ("a", 9)], key=str)
    assert rows(versions.log(spark, path, "t", own), "version") == [(0,)] * 4 + [(2,)]
    assert versions.publish(spark, path, 3, {"t": frame()}, second)  # a touched bucket without rows becomes empty
    assert rows(versions.current(spark, path, "t", own), "k", "v") == others
    assert versions.publish(spark, path, 4, {"t": frame()}, frame()) and versions.last(spark, path) == 4
    assert rows(versions.current(spark, path, "t", own), "k", "v") == others


def test_folded(spark, tmp_path):
    path = str(tmp_path / "s")
    batch = lambda *r: spark.createDataFrame([(k, v, s if s is None else at(s), i) for k, v, s, i in r], EVENT)
    fold = lambda n, b: live.folded(b, path, n, ["k"], ["v"], buckets=4)
    first = batch(("a", 1, 10, 1), ("a", 2, 10, 2), ("a", 2, 10, 2), ("b", 5, 3, 3), (None, 7, 3, 4), ("c", 8, None, 5))
    assert fold(0, first) and not fold(0, first)
    assert fold(1, batch(("a", 3, 9, 6), ("b", 6, 3, 7))) and fold(2, batch())
    schema = batch().schema
    assert rows(versions.current(spark, path, "state", batch().drop("event_id").schema), "k", "v") == [("a", 2), ("b", 6)]
    assert rows(versions.log(spark, path, "rejected", schema), "event_id", "version") == [(4, 0), (5, 0), (6, 1)]


def test_stream_is_the_batches(spark, tmp_path):
    """A stream that starts again over the same folders, and one whose progress is lost after the publication, give one state."""
    source, path = str(tmp_path / "in"), str(tmp_path / "s")
    first = spark.createDataFrame([("a", 1, at(5), 1), ("b", 2, at(5), 2)], EVENT)
    first.coalesce(1).write.parquet(source)
    run = lambda mark: live.keep_state(spark.readStream.schema(EVENT).parquet(source), path, str(tmp_path / mark), ["k"], ["v"], buckets=2).awaitTermination()
    run("c")
    run("other")  # batch 0 comes again
    spark.createDataFrame([("a", 3, at(4), 3), ("b", 4, at(6), 4)], EVENT).coalesce(1).write.mode("append").parquet(source)
    run("c")
    assert rows(versions.current(spark, path, "state", first.drop("event_id").schema), "k", "v") == [("a", 1), ("b", 4)]
    assert rows(versions.log(spark, path, "rejected", first.schema), "event_id") == [(3,)]


def test_refreshes(spark, tmp_path):
    events = spark.createDataFrame([("a", 1, at(0), 1), ("a", 1, at(4), 2), ("a", 1, at(9), 3), ("a", 1, at(15), 11), ("b", 1, at(1), 4), (None, 1, at(2), 5), (None, 1, at(2), 5), ("c", 1, None, 6)], EVENT)
    want = [("a", at(0), at(14), 3), ("a", at(15), at(20), 1), ("b", at(1), at(6), 1), (None, at(2), at(7), 2)]
    columns = ("k", F.col("began").cast("timestamp"), F.col("due").cast("timestamp"), "n")
    assert rows(live.refreshes(events, ["k"]), *columns) == sorted(want, key=str)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(1).write.parquet(source)
    run = lambda: live.refreshes(spark.readStream.schema(EVENT).parquet(source), ["k"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    for s, i in ((600, 8), (3, 9), (700, 10)):  # the second is too late: its run is out
        spark.createDataFrame([("z" if s > 500 else "a", 1, at(s), i)], EVENT).coalesce(1).write.mode("append").parquet(source)
        run()
    got = rows(spark.read.parquet(out).where("k IS NULL OR k <> 'z'"), *columns)
    assert got == sorted(want, key=str)
    assert "server_updated_at" in live.stamped(events).columns and live.stamped(events).where("server_updated_at IS NULL").isEmpty()


def test_replayed(spark):
    queue = [("q", 1, 200, 0), ("q", 2, 409, 1), ("q", 3, 401, 5), ("q", 4, None, None), ("q", 5, 503, 4), ("q", 6, 401, 0), ("q", 7, 200, 0), (None, 8, 200, 0), ("r", 9, 200, 7)]
    got = live.replayed(spark.createDataFrame(queue, "q string, id long, status int, retry_count int"), F.col("status"), ["id"], ["q"])
    assert [tuple(r) for r in got.orderBy("id").select("outcome", "retry_count").collect()] == [("synced", 0), ("conflict", 1), ("given_up", 5), ("failed", 1), ("failed", 5), ("waiting", 0), ("waiting", 0), ("synced", 0), ("given_up", 7)]
    assert tuple(live.replay_counts(got).first()) == (3, 4, 1)
    assert tuple(live.replay_counts(got.where("false")).first()) == (0, 0, 0)


DOOR = "project_id long, door_number string, hw_set string, hw_heading string, location string, door_type string, frame_type string, fire_rating string, hand string, pdf_page int, leaf_count int, is_active boolean"
ITEM = "project_id long, door_number string, name string, qty int"


def staged_of(spark, *doors):
    own = spark.createDataFrame([(r, d, *[None] * 9, True) for r, d in doors], DOOR).drop("is_active").withColumnRenamed("project_id", "run_id")
    return own


def test_promotion(spark, tmp_path):
    path = str(tmp_path / "p")
    door = lambda p, d, active=True: (p, d, "S", None, "old", None, None, None, None, None, 2, active)
    openings = spark.createDataFrame([door(1, "A"), door(1, "B", False), door(1, "C"), door(1, "D"), door(2, "A"), door(3, "A")], DOOR)
    items = spark.createDataFrame([(1, "A", "Hinge", 3), (1, "A", "Stop", 1), (1, "B", "Hinge", 3), (1, "C", "Hinge", 3), (2, "A", "Lock", 1), (1, "D", "Kept", None)], ITEM)
    write = {n: versions.with_bucket(t, ["project_id"], 2) for n, t in (("openings", openings), ("items", items))}
    versions.publish(spark, path, 0, write, write["openings"], promotion.CHECKS)
    runs = spark.createDataFrame([(10, 1, "reviewing"), (20, 2, "promoted"), (30, 3, "completed_with_issues"), (40, 4, "reviewing")], "run_id long, project_id long, status string")
    members = spark.createDataFrame([(p, 7, "admin") for p in (1, 1, 2, 3)] + [(4, 7, "member")], "project_id long, user_id long, role string")
    requests = spark.createDataFrame([(r, 7) for r in (10, 10, 20, 30, 40, 50)], "run_id long, user_id long")
    staged = staged_of(spark, (10, "A"), (10, "B"), (10, "C"), (10, "E"), (20, "Z"), (30, "Y"), (30, "X"), (40, "A"))
    parts = [(10, "A", "Stop", None), (10, "A", "Hinge", 3), (10, "B", "Hinge", 4), (10, "C", "Hinge", 3), (10, "E", "Lock", 1), (10, "E", "Lock", 1), (40, "A", "x", 1), (20, "Z", "x", 1)]
    parts = spark.createDataFrame(parts, ITEM).withColumnRenamed("project_id", "run_id")
    go = lambda n, s, i: promotion.promote(spark, path, n, requests, runs, members, s, i, openings.schema, items.schema, 2)
    twice = staged_of(spark, (10, "A"), (10, "A"))
    with pytest.raises(versions.Refused, match="twice"):
        go(1, twice, parts)
    state = lambda: (rows(versions.current(spark, path, "openings", openings.schema), "project_id", "door_number", "location", "leaf_count", "is_active"), rows(versions.current(spark, path, "items", items.schema), *items.columns))
    assert state() == (rows(openings, "project_id", "door_number", "location", "leaf_count", "is_active"), rows(items, *items.columns))
    assert go(2, staged, parts) and not go(2, staged, parts)
    doors, left = state()
    assert doors == [(1, "A", None, 1, True), (1, "B", None, 1, True), (1, "C", None, 1, True), (1, "D", "old", 2, False), (1, "E", None, 1, True), (2, "A", "old", 2, True), (3, "A", "old", 2, True)]
    assert left == sorted([(1, "A", "Hinge", 3), (1, "A", "Stop", 1), (1, "B", "Hinge", 4), (1, "C", "Hinge", 3), (1, "D", "Kept", None), (1, "E", "Lock", 1), (1, "E", "Lock", 1), (2, "A", "Lock", 1)], key=str)
    told = "run_id long, project_id long, error string, added long, updated long, unchanged long, deactivated long, items_promoted long"
    got = {r["run_id"]: tuple(r)[2:] for r in versions.log(spark, path, "promotions", spark.createDataFrame([], told).schema).select(*(x.split()[0] for x in told.split(", "))).collect()}
    assert got[10] == (None, 1, 1, 2, 1, 3)
    assert got[20][0].startswith('Cannot promote extraction in status "promoted"') and got[40][0] == promotion.NO_ADMIN and got[50][0] == promotion.NOT_FOUND
    assert got[30][0] == "Cannot promote: 2 door(s) have no hardware items: X, Y. Exclude them or add hardware before promoting."


def test_nothing_staged_changes_nothing(spark):
    openings = spark.createDataFrame([(1, "A", *[None] * 9, True)], DOOR)
    items = spark.createDataFrame([(1, "A", "x", 1)], ITEM)
    accepted = spark.createDataFrame([(10, 1)], "run_id long, project_id long")
    after, left, counts = promotion.merged(openings, items, accepted, staged_of(spark, (9, "Z")), items.withColumnRenamed("project_id", "run_id").limit(0))
    assert rows(after, "is_active", "action") == [(True, None)] and rows(left, "name") == [("x",)]
    assert rows(counts, "run_id", "added", "updated", "unchanged", "deactivated", "items_promoted") == [(10, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize(("name", "want"), [
    ("Hinge 5BB1", None), (None, "empty"), (" ", "empty"), ("Single Door #1", "pattern"), (" door ", "pattern"), ("Door Closer", None), ("REVIEWED by: x", "pattern"), ("a_____", "pattern"), ("March 3", "pattern"), ("Marching bar", None),
    ("Hinge, one, two", "pattern"), ("hinge", "lower case"), ("éclair", "lower case"), ("- Hinge", "punctuation"), ("Closer are mounted", "sentence"), ("Locked w hen in", "sentence"), ("NTOWN CONNECT IO N", "garble"), ("A B", None), ("IV SC LC", None), ("Lock AL BK", None),
])
def test_not_hardware(spark, name, want):
    assert spark.range(1).select(C.not_hardware(F.lit(name).cast("string")).alias("v")).first()["v"] == want


@pytest.mark.parametrize(("field", "given", "want"), [
    ("fire_rating", "x\n90Min", "90Min"), ("fire_rating", " x ", ""), ("fire_rating", "x R) 90Min", "90Min"), ("location", "R)\nL) ROOM 101 R) ", "ROOM 101"), ("location", "X-RAY ROOM", "X-RAY ROOM"), ("location", "x ROOM", "x ROOM"),
    ("hand", "R) x RHR", "RHR"), ("hand", "xRHR", "xRHR"), ("door_number", " R) 101 ", "R) 101"), ("other", " a ", "a"), ("hand", None, ""), ("location", "L)", ""),
])
def test_without_marks(spark, field, given, want):
    assert spark.range(1).select(T.without_marks(F.lit(field), F.lit(given).cast("string")).alias("v")).first()["v"] == want


def test_heading_map(spark):
    text = ["Heading #: 1", "Opening Description: 20 Min too early", "Opening Description: none", "opening description - 1 hr x", "Opening Description: 90 MIN", "Heading #: 2", "90 MIN"]
    lines = grammar.sectioned(spark.createDataFrame([(1, 2 * k, t) for k, t in enumerate(text)], "page long, line int, text string"))
    doors = spark.createDataFrame([(1, 1, 3, "A"), (1, 1, 7, "B"), (1, 2, 11, "A"), (1, 2, 11, "C"), (1, 1, 9, None), (2, 1, 1, "C")], "page long, section long, line int, door_number string")
    assert rows(grammar.heading_map(lines, doors), "door_number", "page", "section", "fire_rating") == [("A", 1, 1, "1 HR"), ("B", 1, 1, "90 MIN"), ("C", 1, 2, None)]
    assert grammar.heading_map(lines.limit(0), doors.limit(0)).isEmpty()


def test_set_doors(spark):
    listed = [(1, 1, 1, "DH1", "G", "a1"), (1, 1, 2, "DH1", "G", "B1"), (2, 1, 1, "X", None, "A1"), (2, 1, 2, "X", "", "c1"), (3, 1, 1, "?", "?", "d1"), (3, 1, 2, "X", None, None)]
    known = [("DH1.1", "G", 2), ("DH1.0", "G", 1), ("X", None, 3), ("G", "other", 0)]
    got = grammar.set_doors(spark.createDataFrame(listed, "page long, section long, line long, set_id string, generic_id string, door_number string"), spark.createDataFrame(known, "set_id string, generic_id string, position long"))
    assert rows(got, "page", "line", "door_number", "set_id") == [(1, 1, "a1", "DH1.0"), (1, 2, "B1", "DH1.0"), (2, 2, "c1", "X")]
