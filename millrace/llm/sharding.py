"""Contiguous, balanced shards from global byte-size prefix sums, in DataFrame operations alone.

Rows are put in order of the text's checksum and size, then doc_id, over range partitions, so that equal texts follow each other:
they lie in one shard, but for a group that a cut at an equal target goes through. Each partition sums its sizes; the running sum of those totals (one
row per partition) is added to the running sum inside the partition, which gives every row the number of bytes before it.
The byte range is cut at equal targets: a row goes to the shard in which its first byte lies, so a shard differs from its
target by less than one row. Only doc_id, size and checksum are shuffled, never a text.

Defined cases: a null text has no bytes and counts one; of equal texts a null doc_id sorts first; repeated rows each have their own slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep

SHARDS = 8
ORDER = ("text_crc32", "size", "doc_id", "row")


def shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, start (bytes before the row), shard, slot (place in the shard, from 0)."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    # Kept, because the partition that a row is in must not change between the totals and the sums that add to them.
    rows = keep(rows.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "ranges")
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row per range partition, so at most as many as spark.sql.shuffle.partitions.
    before = totals.select("part", F.coalesce(F.sum("bytes").over(every), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(every), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(*ORDER)
    placed = rows.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)}).join(F.broadcast(before), "part")
    start = F.col("bytes_before") + F.col("upto") - F.col("size")
    placed = placed.withColumn("start", start).select("doc_id", "size", "text_crc32", "start", F.expr(f"cast(start * {n_shards} div all_bytes as int)").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("index"))
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "start", "shard", (F.col("index") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Writes each row's columns under path/shard=N, in parts of ascending slot. Rows are matched on doc_id, checksum and size, and among equal ones by turn."""
    same = ["doc_id", "text_crc32", "size"]
    turn = lambda order: F.row_number().over(Window.partitionBy(*same).orderBy(order))
    place = shards(docs, n_shards).select(*same, "shard", "slot").withColumn("turn", turn("slot"))
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "doc_id", F.crc32(body).alias("text_crc32"), (F.octet_length(body).cast("long") + 1).alias("size"))
    own = own.withColumn("turn", turn(F.lit(0)))
    equal = own["doc_id"].eqNullSafe(place["doc_id"]) & (own["text_crc32"] == place["text_crc32"]) & (own["size"] == place["size"]) & (own["turn"] == place["turn"])
    out = own.join(place, equal).select("whole", place["shard"].alias("to_shard"), place["slot"].alias("to_slot"))
    # The user's columns may be named shard or slot; those of the folders come last and are named apart then.
    free = lambda name: name if name not in docs.columns else f"{name}_"
    out = out.select("whole.*", F.col("to_shard").alias(free("shard")), F.col("to_slot").alias(free("slot")))
    out.repartitionByRange(free("shard"), free("slot")).sortWithinPartitions(free("shard"), free("slot")).write.partitionBy(free("shard")).parquet(path)
