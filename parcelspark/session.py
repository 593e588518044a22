"""Session helpers shared by every job: staged tables, size-checked lookups, group ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 256 * 1024 * 1024

# Staging folders of local applications without a configured one.
_local_folders: dict[str, str] = {}

# Applications whose executors have the package.
_shipped: set[str] = set()


def build_session(name: str = "parcelspark", cpus: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, however it got onto the driver's path."""
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        home = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="parcelspark-code-"), "parcelspark.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(home)))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(application)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: `spark.checkpoint.dir`, else a local one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="parcelspark-")
    return _local_folders[application]


def staging_folder(spark: SparkSession) -> str:
    """This application's folder for staged tables."""
    return f"{work_dir(spark)}/parcelspark/{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result once and go on from the table.

    Used where several later jobs read the same result; the table lies in shared storage, so losing
    executors costs no recomputation. `clear_staged` removes it once no result needs it any more.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete everything this application has staged."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks to aim for when a step multiplies the work per row."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Redistribute compact rows before a step that is costly per row or expands it.

    Input files may be few, and neighbouring rows may be equally heavy; the fixed number keeps
    adaptive execution from merging the partitions back by their small size.
    """
    return df.repartition(parallelism(df.sparkSession), *keys)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    small_bytes: int,
    spread: list[str],
    how: str = "left",
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
    salts: int = 64,
) -> DataFrame:
    """Join a large table with a per-group table of measured size.

    Up to `limit_bytes` the small side is broadcast. Beyond it both sides carry a salt, so that a
    group holding a large share of `big` is spread over `salts` tasks; the salt is a hash of the
    `spread` columns. `small_bytes` is the measured size of the small side in memory.
    """
    if small_bytes <= limit_bytes:
        return big.join(F.broadcast(small), on, how)
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(copies, [*on, "_salt"], how).drop("_salt")


def rank_in_group(
    df: DataFrame, group: list[str], order: list[str], bucket: F.Column, out: str
) -> DataFrame:
    """Zero-based row number inside each group without sorting a whole group in one task.

    `bucket` must grow with the order columns. Rows are numbered inside (group, bucket) and shifted
    by the size of the group's earlier buckets, so even a group holding most rows is spread out.
    """
    df = df.withColumn("_bucket", bucket)
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(*group, "_bucket").orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inside))
    match = F.col("_bucket") == F.col("_b")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (
        numbered.join(offsets, match)
        .withColumn(out, (F.col("_inside") - 1 + F.col("_offset")).cast("long"))
        .drop("_bucket", "_inside", "_offset", "_b", *[f"_g{i}" for i in range(len(group))])
    )
