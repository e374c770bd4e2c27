"""Writers: CSV reports, partition replacement, retention, appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(rows: DataFrame) -> DataFrame:
    """The rows written to the folder that all executors share (spark.checkpoint.dir) and read again: computed once, and lineage ends here.

    Only a local session without the setting gets a folder of its own.
    """
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the executors share")
        root = tempfile.mkdtemp(prefix="jambwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def export_rows(openings: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each item, and one with blank cells for an opening without items."""
    rows = openings.join(items, "opening_id", "left")
    return rows.select("opening_id", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))


def write_csv(rows: DataFrame, path: str, *order: str) -> None:
    rows.orderBy(*order).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that rows have, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def retained(rows: DataFrame, at: str, as_of: str, days: int, final: list[str]) -> DataFrame:
    """What a purge leaves: rows younger than so many days, or whose status isn't final."""
    return rows.where((F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.make_interval(days=F.lit(days))) | ~F.col("status").isin(*final))
