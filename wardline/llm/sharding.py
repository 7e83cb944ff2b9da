"""Sharding by jump consistent hashing: stable keys go to shards without a ring table.

The key of a row is the first 64 bits of the MD5 of its id as text. The jump function walks from shard to
shard with a linear congruential generator; with one more shard a row either stays or goes to the new one, and
the expected share that moves is 1/(n+1).

Defined results: a null id counts as an id of its own (the empty text); a null text has no bytes; repeated rows
go to the same shard and get slots of their own; an empty table gives an empty result; other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wardline.llm.common import keep, keep_partitions

# Fixed value: the multiplier of the published jump consistent hash function.
MULTIPLIER = 2862933555777941757
U64 = "decimal(20,0)"


def stable_key(column: Column) -> Column:
    """Unsigned 64-bit key of any value, the same in every session and for every partitioning."""
    digest = F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast(U64)


def jump(key: Column, shards: int) -> Column:
    """Shard of an unsigned 64-bit key, 0 to ``shards - 1``.

    Each step of the walk moves to a larger shard, so ``shards`` steps always suffice; steps after the end of
    the walk leave the state as it is.
    """
    if shards < 1:
        raise ValueError("there must be at least one shard")
    two33 = F.lit(str(2**33)).cast(U64)
    start = F.struct(
        key.cast(U64).alias("key"), F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next")
    )

    def step(state: Column, _: Column) -> Column:
        drawn = ((state["key"] * F.lit(str(MULTIPLIER)).cast("decimal(19,0)") + F.lit(1)) % F.lit(str(2**64)).cast(U64)).cast(U64)
        high = ((drawn - drawn % two33) / two33).cast("bigint")
        ahead = ((state["next"] + 1) * (F.lit(float(2**31)) / (high + 1).cast("double"))).cast("bigint")
        moved = F.struct(drawn.alias("key"), state["next"].alias("shard"), ahead.alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["shard"].cast("int"))


def assign(rows: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 16, key_column: str | None = None) -> DataFrame:
    """Shard, slot in the shard and shard after growth for every row.

    Law ``key``: the id and the number of shards decide, nothing else. Rows with equal texts therefore part
    unless they share the key; pass ``key_column=text_column`` to keep them together. ``slot`` numbers the rows
    of a shard from 0 without gaps, by id, size and checksum.

    The text is read once; what is written, sorted and numbered is about 40 bytes a row. Numbering needs no
    group in one task: the rows are dealt by range, counted for each range and shard, and each range numbers
    its own rows from the running total of the earlier ranges. A row number is the last sort key, so many rows
    with one id spread over several ranges.
    """
    body = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    key = stable_key(F.col(key_column or id_column))
    narrow = keep(
        rows.select(
            F.col(id_column).alias("doc_id"),
            (F.octet_length(body).cast("bigint") + 1).alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            jump(key, shards).alias("shard"),
            jump(key, shards + 1).alias("grown_shard"),
        )
    )
    order = ["doc_id", "size", "text_crc32", "row"]
    dealt = keep_partitions(narrow.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order))
    ranged = keep(dealt.withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "range", before.alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "range").orderBy(*order)) - 1
    numbered = ranged.withColumn("inside", inside).join(starts, ["shard", "range"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("inside")).cast("bigint").alias("slot"), "grown_shard",
    )
