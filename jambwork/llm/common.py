"""What the operators of this subpackage share: tables, the shared folder, Arrow maps, components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word ends at a space or at 0x09 to 0x0D, as in every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def with_row_keys(docs: DataFrame) -> DataFrame:
    """docs with `row1` and `row2`, two hashes of the whole row: rows have both in common if they are equal in all columns."""
    values = [x for c in docs.columns for x in (F.col(c).isNull(), F.col(c))]
    return docs.withColumns({"row1": F.xxhash64(*values), "row2": F.xxhash64(F.lit(1), *values)})


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that all executors share; a local one only where none is set and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        root = tempfile.mkdtemp(prefix="jambwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_held = threading.local()


def _scratch() -> list[list[str]]:
    """What each open scratch block of this thread has stored."""
    if not hasattr(_held, "blocks"):
        _held.blocks = []
    return _held.blocks


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that this thread stores within, but those stored to be kept."""
    _scratch().append([])
    try:
        yield
    finally:
        for path in _scratch().pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """The rows written to the shared folder and read again: cuts lineage, and is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    if _scratch() and not keep:
        _scratch()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_groups(rows: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """rows with aggregates of their keys' group, in one shuffle and one computation of rows.

    The grouping reads all columns, so that both uses have the same exchange, which Spark then makes once.
    Rows with a null are left out. All rows of a group come to one task: keys that may have very many need a salt among them.
    """
    for x in rows.columns:  # no later filter may come before one use of the exchange only
        rows = rows.where(F.col(x).isNotNull())
    rows = rows.repartition(parts(rows.sparkSession), *keys)
    own = [x for x in rows.columns if x not in keys]
    groups = rows.groupBy(*keys).agg(*sums, *(F.max(x).alias(f"_{x}") for x in own))
    for x in own:
        groups = groups.where(F.col(f"_{x}").isNotNull()).drop(f"_{x}")
    return rows.join(groups, keys)


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """mapInArrow with f from a record batch to record batches (or tuples of columns)."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                for out in f(batch):
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=names)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node that can be reached.

    Each round hooks every root to its smallest neighbour, follows the hooks to
    their ends by doubling, and renames the edges; the rounds needed grow with
    the logarithm of the longest chain. Nothing is collected but counts.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    spark, label = edges.sparkSession, None
    while not edges.isEmpty():
        hook = stored(edges.groupBy("a").agg(F.min("b").alias("to")))
        while True:
            nxt = hook.select(F.col("a").alias("to"), F.col("to").alias("far"))
            hook = stored(hook.join(nxt, "to", "left").select("a", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
            moved = not hook.where("moved").isEmpty()
            hook = hook.select("a", "to")
            if not moved:
                break
        new = label.join(hook.select(F.col("a").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")).unionByName(hook.join(label.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("to").alias("root"))) if label is not None else hook.select(F.col("a").alias("node"), F.col("to").alias("root"))
        label = stored(new)
        to = hook.select(F.col("a").alias("x"), "to")
        e = edges.join(to.withColumnRenamed("x", "a"), "a", "left").select(F.coalesce("to", "a").alias("a"), "b")
        e = e.join(to.withColumnRenamed("x", "b"), "b", "left").select("a", F.coalesce("to", "b").alias("b")).where("a <> b")
        edges = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if label is None:
        return spark.createDataFrame([], "node long, root long")
    return label.unionByName(label.select(F.col("root").alias("node"), "root").distinct())
