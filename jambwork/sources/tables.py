"""Scans: the stored tables, and the domain's frames as projections of them.

The frames' columns are plain SQL expressions, which the catalog's oracles read too.
Only the columns that a query asks for reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Names and models of hardware, dealt to items by their numbers.
HARDWARE = [
    ("Hinge", "5BB1 4 1/2 x 4 1/2"), ("Hinges", "5BB1 CON TW8"), ("Continuous Hinge", "780"), ("Lockset RHR", "ND80"), ("Exit Device 99EO US26D", "99EO"), ("Flush Bolt", "458"), ("Closer LH", "4040XP"), ("Kick Plate", "8400"),
    ("Wall Stop", "WS406"), ("Threshold", "171A"), ("Gasketing", "188S"), ("Silencer", "SR64"), ("Coordinator", "3094"), ("Door", ""), ("Door (Active Leaf)", ""), ("Door (Inactive Leaf)", ""), ("Frame", ""), ("Auto Operator", "4640"),
    ("Cylinder Housing", "20-057"), ("Permanent Core", "23-030"), ("Door Viewer", ""), ("Astragal", ""), ("Widget", "X1"), ("Strike", "ES"),
]


def _dealt(k: int) -> str:
    return "CASE (l_partkey + l_linenumber) % 24 " + " ".join(f"WHEN {i} THEN '{x[k]}'" for i, x in enumerate(HARDWARE)) + " END"


FRAMES: dict[str, tuple[str, dict[str, str]]] = {
    "openings": ("orders", {
        "opening_id": "o_orderkey", "project_id": "o_custkey", "door_number": "concat('D', o_orderkey)", "hw_set": "concat('DH', o_orderkey % 40)",
        "location": "CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderpriority END",
        "hand": "CASE o_orderkey % 5 WHEN 0 THEN 'LH' WHEN 1 THEN 'RH' WHEN 2 THEN 'LHR' WHEN 3 THEN 'RHR' ELSE '' END",
        "fire_rating": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '45 MIN' WHEN 2 THEN '90 MIN' ELSE 'N/A' END",
        "door_type": "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE 'A' END", "frame_type": "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'F1' END",
        "leaf_count": "CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END", "is_active": "o_orderkey % 13 <> 0",
        "floor_number": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 7 END", "created_at": "o_orderdate", "status": "o_orderstatus",
    }),
    "items": ("lineitem", {
        "opening_id": "l_orderkey", "item_id": "l_partkey", "supplier_id": "l_suppkey", "sort_order": "l_linenumber", "qty": "CAST(l_quantity AS INT)",
        "checked": "l_linestatus = 'F'", "installed": "l_returnflag = 'R'", "qa_qc": "l_returnflag = 'A'", "damaged": "l_returnflag IN ('A', 'R')",
        "stage": "CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'ordered' WHEN 2 THEN 'received' WHEN 3 THEN 'pre_install' WHEN 4 THEN 'installed' WHEN 5 THEN 'qa_qc' ELSE 'lost' END",
        "leaf_side": "CASE l_linenumber % 4 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' ELSE 'shared' END",
    }),
    "hardware": ("lineitem", {
        "opening_id": "l_orderkey", "pos": "l_linenumber * 1000000 + l_partkey", "name": _dealt(0), "model": _dealt(1), "qty": "CAST(l_quantity AS INT) % 9",
        "leaf_side": "CASE l_linenumber % 4 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' ELSE 'shared' END",
    }),
    "products": ("part", {"item_id": "p_partkey", "name": "p_name", "manufacturer": "p_brand", "model": "concat(p_type, ' ', p_size)", "category": "p_type", "size": "p_size"}),
    "projects": ("customer", {"project_id": "c_custkey", "project": "c_name", "nation_id": "c_nationkey", "segment": "c_mktsegment"}),
    "activity": ("events", {"event_id": "event_id", "acted_at": "ts", "actor_id": "user_id", "action": "event_type", "amount": "value", "details": "props"}),
}


#: The place of a row in its table: settles ties as a scan does that keeps the first.
PLACE = "struct(_metadata.file_path, _metadata.row_index) AS place"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str, *more: str, by: str | None = None) -> DataFrame:
    """A frame; more: expressions over its table that it gets as well. by: a column of the table whose equal rows come to one task, before columns are made of them."""
    source, columns = FRAMES[name]
    rows = table(spark, sf_dir, source)
    return (rows.repartition(by) if by else rows).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()), *more)


def frames_sql() -> str:
    """The frames as named subqueries, for a WITH clause."""
    return ", ".join(f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source})" for name, (source, columns) in FRAMES.items())
