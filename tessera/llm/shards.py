"""Contiguous shards of near-equal bytes from a global prefix sum of sizes.

Rows are range-partitioned by the order columns and written once with their partition number. Each partition's total
(one row a partition) gives its offset, a running sum inside the partition gives every row's place in bytes and rows,
and a row's shard is where the middle of its bytes falls among equal targets: shards are contiguous, and no shard is
off its target by more than one row at either end.

Cases: null text has size 1 and checksum 0; rows with equal order columns keep one order by checksum and size; null ids
come first; an empty table gives an empty result; other columns of `rows` pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, save, table


def sized(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def shard(rows: DataFrame, size_col: str, order: list[str], shards: int = 8, rows_a_part: int = 50_000) -> DataFrame:
    """rows + shard int, slot long (place in the shard), byte_start long (prefix sum); `rows` should be narrow."""
    parts = max(4, -(-rows.count() // rows_a_part))
    # rows that agree in the order columns are told apart, so that many of them are no part too large
    numbered = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = save(numbered.repartitionByRange(parts, *order, "_tie").withColumn("_part", F.spark_partition_id()), "shards")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum(size_col).alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select("_part", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"), F.sum("_bytes").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("_part").orderBy(*order, "_tie")
    placed = ranged.withColumn("_byte", F.sum(size_col).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size_col)).withColumn("_row", F.row_number().over(inside) - 1)
    placed = checked_join(placed, totals, "_part", "inner", parts)
    start = F.col("_byte0") + F.col("_byte")
    number = F.floor((start * 2 + F.col(size_col)).cast("decimal(38,0)") * shards / (F.col("_total") * 2).cast("decimal(38,0)"))
    placed = save(placed.withColumn("byte_start", start).withColumn("_row", F.col("_row0") + F.col("_row")).withColumn("shard", F.least(number, F.lit(shards - 1)).cast("int")).drop("_part", "_tie", "_byte", "_byte0", "_row0", "_total"), "shards_placed")
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return checked_join(placed, first, "shard", "inner", shards).withColumn("slot", (F.col("_row") - F.col("_first")).cast("long")).drop("_row", "_first")


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs + shard int. Only ids, checksums and sizes are sorted; the texts are then dealt by the shards' first rows.

    Rows that agree in id, checksum and size share a shard. A column `shard` of docs gives way.
    """
    order = [F.col(id_col), text_crc32(F.col(text_col)), sized(F.col(text_col))]
    placed = shard(docs.select(order[0].alias("_a"), order[1].alias("_b"), order[2].alias("_c")), "_c", ["_a", "_b", "_c"], shards)
    cuts = placed.groupBy("shard").agg(F.min(F.struct("_a", "_b", "_c")).alias("_cut")).orderBy("shard").collect()
    number = F.lit(0)
    for row in cuts[1:]:
        a, b, c = row["_cut"]
        own = F.struct(*order)
        number = F.when(own >= F.struct(F.lit(a).cast(docs.schema[id_col].dataType), F.lit(b).cast("long"), F.lit(c).cast("long")), F.lit(row["shard"])).otherwise(number)
    return docs.withColumn("shard", number.cast("int"))


def op5_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", sized(F.col("text")).alias("size"), text_crc32(F.col("text")).alias("text_crc32"))
    out = shard(docs, "size", ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
