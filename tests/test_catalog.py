"""Every query of the library against its SQL on the smallest tables, and the awkward cases of single operators."""

from __future__ import annotations

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from jambwork.functions import text as T
from jambwork.operators import linkage, merge, pages, quantity, rollups, sets
from jambwork.plans import catalog, edits, live, schedule, texts, views  # noqa: F401
from jambwork.streaming import progress

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries for what the smallest tables don't have: their rows are of cases that larger ones hold, or that the tests below make.
RARE = {"j24_typo_pairs", "w03_gap_outliers", "p24_zero_items"}


def plain(value):
    return str(round(value, 6) if isinstance(value, float) else value)


@pytest.mark.parametrize("name", [*catalog.QUERIES])
def test_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = df.collect()
    assert got or name in RARE
    if name not in catalog.ORACLE_SQL:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    cols = [x[0] for x in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in got) == sorted(tuple(map(plain, (dict(zip(cols, r, strict=True))[c] for c in sorted(cols)))) for r in want.fetchall())


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("f", "given", "want"), [
    (T.set_key, "DH-4A_0 ", "dh4a0"), (T.door_key, " 110-02c ", "110-02C"), (T.revision_key, "012", "12"), (T.revision_key, "O12", "012"),
    (T.door_shape, "1.01.A.01A", "D.D.L.DL"), (T.door_shape, "110-01C", "D-DL"), (T.door_shape, "ST-100", "L-D"),
    (T.hand, "see LHRA", "LH"), (T.hand, "none", None), (T.fire_rated, "n/a", False), (T.fire_rated, "NR", True), (T.fire_rated, None, False),
    (T.flag, "Yes", True), (T.flag, "0", False), (T.flag, "?", None), (T.fire_rating, "door, 90 min rated", "90 MIN"),
    (T.opening_size, "3070", (36.0, 84.0)), (T.opening_size, "6'0\" x 7'0\"", (72.0, 84.0)), (T.opening_size, "914 x 2134", (36.0, 84.0)), (T.opening_size, "x", None),
])
def test_functions(spark, f, given, want):
    got = value(spark, f(F.lit(given).cast("string")))
    assert (tuple(got) if isinstance(got, tuple) else got) == want


def test_jaccard(spark):
    score = lambda a, b: value(spark, T.jaccard(T.tokens(F.lit(a)), T.tokens(F.lit(b))))
    assert score("a b", "b c") == pytest.approx(1 / 3) and score("", "") == 1 and score("", "x") == 0


def test_ambiguous_names_do_not_match(spark):
    wanted = spark.createDataFrame([("s", "Door Closer"), ("s", "Lockset"), ("s", "Kick Plate"), ("s", "Exit Stop"), ("s", "kickplate")], "block string, a string")
    offered = spark.createDataFrame([("s", "Door Closer, 4000"), ("s", "Door Closer, 5000"), ("s", "lockset"), ("t", "Kick Plate"), ("s", "Door Stop Exit"), ("s", "plate"), ("s", "Stop Exit One")], "block string, b string")
    got = {r["a"]: r["b"] for r in linkage.match_names(wanted, offered, "block").collect()}
    assert got == {"Door Closer": None, "Lockset": "lockset", "Kick Plate": "plate", "Exit Stop": None, "kickplate": "plate"}


def matched(wanted: list[tuple], offered: list[tuple]) -> dict:
    """(tier, score, b) of each wanted (block, a), by comparing all names of a block."""
    def name(x):
        for pattern, to in [(r"\s*\([^)]*\)\s*", " "), (r'[,\s]+[0-9][0-9\-/]*"?(\s*x\s*[0-9][0-9\-/]*"?)*\s*$', ""), (r"(\s+[a-z]*[0-9][a-z0-9]*)+\s*$", ""), (r"""[,."'\s]+$""", ""), (r"\s+", " ")]:
            x = re.sub(pattern, to, x.lower())
        return x.strip(" ")

    kind = lambda x: next((k for k in ("hinge", "closer", "lockset", "exit", "stop", "seal", "threshold", "kick", "flush", "coordinator", "bolt") if k in x.lower()), None)
    out = {}
    for block, a in {*wanted}:
        found = []
        for b in {y for x, y in offered if x == block and y is not None and a is not None}:
            x, y, la, lb = {*a.lower().split()}, {*b.lower().split()}, a.lower(), b.lower()
            score = len(x & y) / len(x | y) if x | y else 1.0
            short, long = sorted([len(a), len(b)])
            alike = None in (kind(a), kind(b)) or kind(a) == kind(b)
            inside = (la in lb or lb in la) and len(a) >= 8 and 2 * short >= long
            tier = 1 if a == b else 2 if la == lb else 3 if alike and name(a) == name(b) else 4 if alike and inside else 5 if alike and score > 0.5 else None
            if tier:
                found.append((tier, -round(score, 6), b))
        found.sort()
        tied = len(found) > 1 and found[0][0] > 2 and found[0][:2] == found[1][:2]
        out[block, a] = (found[0][0], -found[0][1], found[0][2]) if found and not tied else (None, None, None)
    return out


NAMES_TO_MATCH = ["electromagnetic", "electromagnetics", "doorcloser", "heavy doorclosers", "(left)", "(LEFT)", "(right)", "closers", "closer", "Door Closer (left)", "door closer", "DOOR CLOSER 4 1/2", "flush bolt set", "flush bolt", "exitdevice", "xexitdevicex", "kick plate 10", "plate kick", "", "  ", "a", "A", "aaaaaaaaaa", "aaaaaaaaa", "overhead stop holder", "overhead stop"]


def test_names_match_as_when_all_are_compared(spark):
    for turn in range(3):
        wanted = [("x", n) for i, n in enumerate(NAMES_TO_MATCH) if i % 3 != turn] + [("y", "doorcloser"), ("x", None)]
        offered = [("x", n) for i, n in enumerate(NAMES_TO_MATCH) if i % 3 == turn or i % 5 == turn] + [("z", "doorcloser"), ("x", None)]
        got = linkage.match_names(spark.createDataFrame(wanted, "block string, a string"), spark.createDataFrame(offered, "block string, b string"), "block").collect()
        assert {(r["block"], r["a"]): (r["tier"], r["score"], r["b"]) for r in got} == matched(wanted, offered)


def test_names_that_share_no_token_match(spark):
    pairs = [("electromagnetic", "electromagnetics"), ("doorclosers", "doorcloser"), ("(left)", "(LEFT)")]
    wanted, offered = (spark.createDataFrame([(str(i), p[k]) for i, p in enumerate(pairs)], f"block string, {'ab'[k]} string") for k in (0, 1))
    assert {r["a"]: (r["b"], r["tier"]) for r in linkage.match_names(wanted, offered, "block").collect()} == {"electromagnetic": ("electromagnetics", 4), "doorclosers": ("doorcloser", 4), "(left)": ("(LEFT)", 2)}


def test_matches_of_the_query(spark, sf):
    got = {(r["manufacturer"], r["a"]): (r["tier"], r["score"], r["b"]) for r in catalog.QUERIES["j16_match_names"](spark, sf).collect()}
    p = [r for r in catalog.frame(spark, sf, "products").select("manufacturer", "name").distinct().collect()]
    assert got == matched([*got], [tuple(r) for r in p])


def test_all_documents_meet_all_items(spark, sf):
    items = spark.createDataFrame([(i, f"w{i} common") for i in range(45)] + [(99, ""), (98, None)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"W{i} common") for i in range(50)] + [(7, "w44 alone"), (7, "w44 alone"), (None, "w3"), (60, "")], "doc_id long, text string")
    got = [tuple(r) for r in linkage.jaccard_pairs(docs, items, "doc_id", "item_id").collect()]
    want = [(d, i, 1.0 if d == i else 0.333333) for d in range(50) for i in range(45)] + [(7, 44, 0.333333)] * 2 + [(None, 3, 0.5)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    seen = catalog.QUERIES["u10_jaccard_all"](spark, sf).select("item_id").distinct().count()
    assert seen == spark.read.parquet(f"{sf}/benchmark.parquet").count()


def test_whole_names_are_compared_for_typos(spark, tmp_path):
    names = ["Supplier#000000001", "Supplier#100000001", "Supplier#000000011", "Supplier#200000001x"]
    spark.createDataFrame([(x,) for x in names], "s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["a"], r["b"]) for r in catalog.QUERIES["j24_typo_names"](spark, str(tmp_path)).collect()}
    assert got == {("Supplier#000000001", "Supplier#100000001"), ("Supplier#000000001", "Supplier#000000011")}


def test_typos_by_category_and_maker(spark):
    rows = [("hinge", "Ives", "5BB1"), ("hinge", "IVES", "5bb2"), ("closer", "Ives", "5BB3"), ("hinge", "LCN", "5BB1"), ("hinge", "Ives", "5BB12"), ("hinge", None, "x1"), ("hinge", "", "x2")]
    families = spark.createDataFrame(rows, "category string, manufacturer string, name string")
    known = spark.createDataFrame([("ives", "5bb12"), ("lcn", "5BB2")], "manufacturer string, name string")
    got = {tuple(r) for r in linkage.typo_candidates(families, known).collect()}
    assert got == {("hinge", "ives", "5bb1", "5bb2"), ("hinge", "", "x1", "x2")}


def test_coalescing_join(spark):
    fields = "door string, location string, hand string, fire_rating string, hw_set string"
    left = spark.createDataFrame([("1", "", None, "", "A"), ("2", "", "", "", "")], fields)
    right = spark.createDataFrame([("1", "LOBBY", "", "", ""), ("3", "", "", "90", "")], fields)
    got = {r["door"]: r for r in linkage.coalescing_full_join(left, right, "door", ["location", "hand", "fire_rating", "hw_set"], ["location", "hand", "hw_set"]).collect()}
    assert set(got) == {"1", "3"} and got["1"]["location"] == "LOBBY" and got["1"]["fire_rating"] == "NR" and got["1"]["enriched"]
    none = linkage.coalescing_full_join(left, right.where("false"), "door", ["location", "hand", "fire_rating", "hw_set"], ["location", "hand", "hw_set"])
    assert none.count() == 2


def test_gap_outliers(spark):
    rows = spark.createDataFrame([("d", p) for p in (1, 2, 9, 10, 11, 20)] + [("e", 5)], "doc string, page int")
    assert [r["page"] for r in sets.gap_outliers(rows, ["doc"], "page").collect()] == [20]


def test_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, "m", "x", ""), (0, "m", "y", ""), (2, "m", "", "")], "pos int, model string, a string, b string")
    assert sets.most_complete(rows, F.col("model"), ["a", "b"], "pos").first()["a"] == "y"


def test_quantities(spark):
    rows = [(8, "needs_division", 2, 9, False), (7, "needs_division", 2, 9, False), (7, "needs_division", 2, 9, True), (9, "needs_cap", 1, 5, False), (6, "propagated", 2, 1, False)]
    got = quantity.normalise(spark.createDataFrame(rows, "qty long, qty_source string, divisor int, most int, is_hinge boolean")).collect()
    assert [(r["qty"], r["qty_source"], r["qty_total"]) for r in got] == [(4, "divided", 8), (4, "flagged", 7), (4, "divided", 7), (5, "capped", 9), (6, "propagated", None)]


def test_leaves_of_a_pair(spark):
    rows = spark.createDataFrame([(1, 2, "hinge", 4, 1), (1, 2, "electric_hinge", 1, 1), (1, 2, "opening", 0, 1)], "opening_id int, leaf_count int, kind string, qty int, electric int")
    got = {(r["kind"], r["leaf_side"]): r["leaf_qty"] for r in quantity.leaf_rows(rows).collect()}
    assert got == {("hinge", "active"): 3, ("hinge", "inactive"): 4, ("electric_hinge", "active"): 1, ("opening", "shared"): 1}


def test_nothing_staged_changes_nothing(spark):
    old = spark.createDataFrame([("1", "x", True)], "door_number string, location string, is_active boolean")
    sign = spark.createDataFrame([("1", "a:1")], "door_number string, signature string")
    got = merge.promote(old, old.drop("is_active").where("false"), sign, sign).first()
    assert got["action"] == "unchanged" and got["is_active"]


def test_reconciled_fields(spark):
    pick = lambda a, b, p: tuple(value(spark, merge.reconciled(F.lit(a), F.lit(b), p)))
    assert pick("", "", True) == ("", "conflict", "none") and pick("x", "", True) == ("x", "single_source", "a")
    assert pick("LCN", " lcn ", True) == ("LCN", "full", "a") and pick("3", "4", False) == ("3", "conflict", "a") and pick("3", "3.0", True)[1] == "full"


def test_greedy_mapping_is_one_to_one(spark):
    headers = spark.createDataFrame([(1, 0, "Door No."), (1, 1, "Door Type"), (1, 2, "Hardware Set"), (1, 3, "")], "table_id long, col int, header string")
    got = pages.assign_columns(pages.header_scores(headers)).collect()
    assert len({r["field"] for r in got}) == len({r["col"] for r in got}) == len(got)
    assert {r["field"]: r["col"] for r in got}["door_number"] == 0


def test_words_go_to_the_last_column_before_them(spark):
    words = spark.createDataFrame([(1, 1, 5.0), (1, 2, 95.0), (1, 3, 400.0)], "page int, word_id int, x0 double")
    columns = spark.createDataFrame([(1, "a", 20.0), (1, "b", 100.0)], "page int, col string, start double")
    assert {r["word_id"]: r["col"] for r in pages.nearest_column(words, columns).collect()} == {1: None, 2: "b", 3: "b"}


def test_rate_limit_without_events(spark, sf):
    from jambwork.sources.tables import frame

    assert rollups.rate_limit(frame(spark, sf, "activity").where("false"), catalog.AS_OF, 5).count() == 0


def test_results_do_not_depend_on_partitions(spark, sf):
    from jambwork.sources.tables import frame

    a = frame(spark, sf, "activity")
    state = lambda d: sorted(map(str, progress.latest(d, ["actor_id"], ["amount"]).collect()))
    assert state(a) == state(a.repartition(7, F.rand(1)))


def test_stream_equals_batch(spark, sf, tmp_path):
    from jambwork.sources.tables import frame

    a = progress.with_event_time(frame(spark, sf, "activity"))
    a.repartition(4).write.parquet(str(tmp_path / "in"))
    twice = spark.readStream.schema(a.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = progress.latest(twice, ["actor_id"], ["amount"]).writeStream.outputMode("complete").format("memory").queryName("latest_state").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("latest_state").collect())) == sorted(map(str, progress.latest(a, ["actor_id"], ["amount"]).collect()))


def test_replays_count_once(spark, sf, tmp_path):
    from jambwork.sources.tables import frame

    a = progress.with_event_time(frame(spark, sf, "activity"))
    a.unionByName(a).repartition(1).write.parquet(str(tmp_path / "in"))
    q = progress.once(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("replayed").count() == a.count()


def test_stale_writes_are_rejected(spark):
    state = spark.sql("SELECT 1 AS actor_id, 10 AS amount, TIMESTAMP '2024-01-02 00:00:00' AS acted_at")
    batch = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP '2024-01-01 00:00:00', 7), (1, 2, TIMESTAMP '2024-01-02 00:00:00', 8), (2, 3, TIMESTAMP '2024-01-01 00:00:00', 9) AS t(actor_id, amount, acted_at, event_id)")
    new, rejected = progress.fold(state, batch, ["actor_id"], ["amount"])
    assert {r["actor_id"]: r["amount"] for r in new.collect()} == {1: 2, 2: 3} and [r["event_id"] for r in rejected.collect()] == [7]


def test_columns_by_score_and_then_by_place(spark):
    headers = ["Door No.", "Hdwr Group", "Heading", "Room", "Type", "Fr.", "Label", "12"]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(headers)] + [(2, 0, "Remarks")], "table_id long, col int, header string")
    got = {r["field"]: r["col"] for r in pages.assign_columns(pages.header_scores(rows)).collect() if r["table_id"] == 1}
    assert got["door_number"] == 0 and got["hw_set"] == 1 and got["hw_heading"] == 2 and got["location"] in (3, 6) and got["frame_type"] == 5
    assert len({*got.values()}) == len(got)


def test_pages_are_packed_and_long_segments_cut(spark):
    kinds = [("cover", []), ("door_schedule", []), ("door_schedule", []), ("hardware_set", ["A"]), ("hardware_set", ["A"]), ("hardware_set", ["B"]), ("hardware_set", ["B", "C"]), ("hardware_set", ["C"]), ("hardware_set", ["C"]), ("reference", []), ("other", [])]
    rows = spark.createDataFrame([(1, i, t, ids, False) for i, (t, ids) in enumerate(kinds)], "doc long, page long, type string, ids array<string>, continued boolean")
    of = lambda most: [r["chunk"] for r in pages.chunks(rows, most).orderBy("page").collect()]
    assert of(40) == [-1, 0, 0, 0, 0, 0, 0, 0, 0, -1, 0]
    assert of(4) == [-1, 0, 0, 0, 0, 1, 1, 1, 1, -1, 2]
    assert of(3) == [-1, 0, 0, 1, 1, 2, 2, 2, 3, -1, 4]


def test_first_leaf_and_item_are_the_sql_s(spark, tmp_path):
    """Positions are numbers of line and item together, so that items of a million and more come after later lines; of equal ones the first row counts."""
    import pandas as pd

    rows = [(1, 1, 1, "O", 0), (1, 1, 1, "F", 1), (2, 1, 2, "F", 0), (2, 1, 2, "O", 1), (3, 5, 7, "F", 0), (3, 1, 9_000_000, "O", 0), (4, 2, 1_000_005, "F", 0), (4, 3, 5, "O", 0)]
    lines = pd.DataFrame([(o, p, 0, n, 1.0, 0.0, 0.0, 0.0, "N", s, pd.Timestamp("2020-01-01")) for o, n, p, s, _ in rows], columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
    orders = pd.DataFrame([(o, 1, "O", 1.0, pd.Timestamp("2020-01-01"), "1-URGENT") for o in (1, 2, 3, 4)], columns="o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())
    con = duckdb.connect()
    con.execute("set threads = 1")
    for name, df in (("lineitem", lines), ("orders", orders)):
        df.astype({c: "int32" for c in df.columns if c == "l_linenumber"}).to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for query in ("x22_leaf_progress", "x23_pairs_from_items"):
        df = catalog.QUERIES[query](spark, str(tmp_path))
        want = con.execute(catalog.ORACLE_SQL[query])
        cols = [x[0] for x in want.description]
        assert {tuple(r[c] for c in cols) for r in df.collect()} == set(want.fetchall())


def test_first_leaf_and_item_have_a_position_and_a_value(spark, tmp_path):
    """Rows without a line, an item or a status are none of which the first is taken, as in the SQL."""
    import pandas as pd

    rows = [(1, None, 2, "F"), (1, 4, None, "O"), (1, 5, 3, "F"), (2, 1, 1, None), (2, 1, 2, "F"), (3, 1, None, "F"), (4, None, None, "O"), (5, 2, 1, None), (5, 2, 5, "O"), (6, 7, None, "F"), (6, 8, 2, "F")]
    lines = pd.DataFrame([(o, p, 0, n, 1.0, 0.0, 0.0, 0.0, "N", s, pd.Timestamp("2020-01-01")) for o, p, n, s in rows], columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
    orders = pd.DataFrame([(o, 1, "O", 1.0, pd.Timestamp("2020-01-01"), "1-URGENT") for o in range(1, 8)], columns="o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority".split())
    con = duckdb.connect()
    con.execute("set threads = 1")
    for name, df in (("lineitem", lines), ("orders", orders)):
        df.astype({c: t for c, t in (("l_partkey", "Int64"), ("l_linenumber", "Int32")) if c in df}).to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for query in ("x22_leaf_progress", "x23_pairs_from_items"):
        df = catalog.QUERIES[query](spark, str(tmp_path))
        want = con.execute(catalog.ORACLE_SQL[query])
        cols = [x[0] for x in want.description]
        assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_patterns_are_literals(spark):
    """Patterns of categories are compiled once and not for each row; a text may fit several, of which the first counts."""
    from jambwork.functions import taxonomy as C

    df = spark.createDataFrame([("Continuous Hinge",), ("electric hinge",), ("Door Closer",), ("nothing",), (None,)], "name string")
    got = df.select(C.set_category(F.col("name")).alias("c"))
    assert [r["c"] for r in got.collect()] == ["continuous_hinge", "electric_hinge", "closer", None, None]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE namedlambda" not in plan.replace("lambda x_", "namedlambda") and "RLIKE lambda" not in plan


def test_only_other_characters_go_to_python(spark):
    """What is in ASCII is null in the batches that go to Python, and stays as it is."""
    df = spark.createDataFrame([("plain  text",), ("caf\u00c3\u00a9",), (None,)], "v string").select(T.clean_cell(F.col("v")).alias("c"))
    assert [r["c"] for r in df.collect()] == ["plain text", "caf\u00e9", ""]
    assert "_repaired(CASE WHEN" in df._jdf.queryExecution().analyzed().toString()
