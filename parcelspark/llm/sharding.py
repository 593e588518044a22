"""Contiguous shards of nearly equal bytes, from global prefix sums of the sizes.

The rows are range-partitioned in the order of their ids. Each partition's total is known from one small aggregate;
the running sum of these totals gives every partition its offset, and a running sum inside the partition the rest.
A shard boundary lies at each equal step of the grand total; a row belongs to the shard that holds its middle byte.
Only id, size and checksum are moved. No task holds more than one range partition, whatever the key's distribution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.session import stage

ORDER = ["doc_id", "text_crc32", "size", "_row"]


def assign_shards(
    docs: DataFrame, shards: int = 40, overhead: int = 16, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and `doc`, a struct of the columns in `carry`) of every row.

    size: bytes of the text plus `overhead`; null and empty texts have `overhead` bytes and checksum 0. slot counts
    from 0 inside a shard without gaps. Null ids come first; rows with equal ids follow in the order of checksum and
    size; fully equal rows share their places in any order. Fewer rows than shards leave some shards without rows,
    an empty table gives no rows. Columns not named in `carry` are left out, whatever they are called.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] if carry else []
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
        *kept,
    )
    ranged = rows.repartitionByRange(*ORDER).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, "shard-ranges")

    # One row per partition: its offset in bytes and the grand total.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.sum("_bytes").over(everything).alias("_total"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*ORDER)
    start = F.col("_bytes_before") + F.sum("size").over(inside) - F.col("size")
    placed = (
        ranged.join(offsets, "_part")
        .withColumn("_start", start)
        .withColumn("_index", F.col("_rows_before") + F.row_number().over(inside) - 1)
        # Twice the middle byte over twice the total keeps the division in whole numbers.
        .withColumn("shard", F.expr(f"int(least({shards - 1}, ((2 * _start + size) * {shards}) div greatest(2 * _total, 1)))"))
        .select("doc_id", "size", "text_crc32", "shard", "_index", *(["doc"] if carry else []))
    )
    placed = stage(placed, "shard-rows")

    # Shards follow the row order, so a shard begins after the rows of all earlier ones. One row per shard.
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("_index") - F.col("_first")).cast("long").alias("slot"),
        *(["doc"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write the documents as one folder per shard, inside each file in the order of the slots."""
    placed = assign_shards(docs, shards, carry=docs.columns)
    columns = [F.col("doc").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    (
        placed.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .select("shard", "slot", *columns)
        .write.partitionBy("shard")
        .parquet(path)
    )
