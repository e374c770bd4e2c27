"""Tables in versions: what is written shows at once when it is published, or not at all.

A folder holds `rows/<name>/version=<v>/bucket=<b>` and a manifest, which says for each
table and bucket which version counts. A version's rows are written first and read by
nobody; then its manifest is written as one file, whose commit is the publication. So
lost executors, failed checks and crashes before that leave the last version as it was,
and a version that is written again takes the place of its own leftovers. Versions
ascend; one that isn't above the last is a replay and is passed over, so that a batch
of a stream counts once however often it comes. One writer at a time.

Only buckets that a version touches are written again. Rows go to buckets by the hash
of a key, nulls to one of them. Manifests have a row for each table and bucket and one more,
which bounds what is broadcast; old versions and manifests stay until they are cleaned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

BUCKETS = 64
MANIFEST = "id long, name string, bucket int, version long"


class Refused(ValueError):
    """A check on the rows failed, nothing was published."""


def with_bucket(rows: DataFrame, key: list[str], buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    spark.createDataFrame([], MANIFEST).coalesce(1).write.mode("ignore").parquet(f"{path}/manifest/start")
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).parquet(f"{path}/manifest")


def last(spark: SparkSession, path: str) -> int | None:
    """The last published version, None before the first."""
    return _manifests(spark, path).agg(F.max("id")).first()[0]


def _written(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    whole = StructType([f for f in schema if f.name not in ("version", "bucket")]).add("version", LongType()).add("bucket", IntegerType())
    spark.createDataFrame([], whole).write.mode("ignore").partitionBy("version", "bucket").parquet(f"{path}/rows/{name}")
    return spark.read.schema(whole).parquet(f"{path}/rows/{name}")


def current(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """The table's published rows, with their bucket; none before the first version."""
    rows, manifests = _written(spark, path, name, schema), _manifests(spark, path)
    newest = manifests.where((F.col("id") == F.lit(last(spark, path)).cast("long")) & (F.col("name") == name)).select("bucket", "version")
    return rows.join(F.broadcast(newest), ["version", "bucket"]).select(*(c for c in rows.columns if c != "version"))


def log(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    """What all published versions have written to a table, as (columns, version)."""
    out = _manifests(spark, path).select(F.col("id").alias("version")).distinct()
    return _written(spark, path, name, schema).join(F.broadcast(out), "version", "left_semi").drop("bucket")


def publish(spark: SparkSession, path: str, version: int, tables: dict[str, DataFrame], touched: DataFrame, checks: dict[str, object] | None = None) -> bool:
    """Writes, checks, then publishes rows (with `bucket`) of several tables together; False if this version is already out.

    touched has the buckets that the rows replace, in each table; a touched bucket without rows becomes empty.
    checks map a message to a function of the written tables, which gives the rows that must not be; any such row refuses the version.
    """
    before = last(spark, path)
    if before is not None and version <= before:
        return False
    touched = touched.select("bucket").distinct()
    written = {}
    for name, rows in tables.items():
        _written(spark, path, name, rows.schema)
        at = f"{path}/rows/{name}/version={version}"
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)  # few files a bucket, and large buckets are split
        written[name] = spark.read.schema(rows.schema).parquet(at)
    for message, wrong in (checks or {}).items():
        if not wrong(written).isEmpty():
            raise Refused(message)
    new = touched.select(F.explode(F.array(*map(F.lit, tables))).alias("name"), "bucket").withColumn("version", F.lit(version).cast("long"))
    old = _manifests(spark, path).where(F.col("id") == F.lit(before).cast("long")).drop("id")
    own = spark.range(1).select(F.lit("").alias("name"), F.lit(0).alias("bucket"), F.lit(version).cast("long").alias("version"))  # a version of no rows counts too
    kept = old.where("name <> ''").join(F.broadcast(new), ["name", "bucket"], "left_anti").select("name", "bucket", "version")
    rows = kept.unionByName(new.select("name", "bucket", "version")).unionByName(own)
    rows.select(F.lit(version).cast("long").alias("id"), "name", "bucket", "version").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{version}")
    return True
