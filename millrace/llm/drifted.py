"""Drifted files: a table's rows in a fixed order, cut into files of equal length, each in a version of the schema that drifts from the evolved one.

The order is the checksum of the first column's decimal form, then the first column (nulls last, ties by the other columns). Rows are put into range partitions;
a row's global number is its number in its partition after those of the partitions before (one total each). Each file is written whole by one task, streaming.

Defined cases: no rows give no files; nulls stay; equal rows each keep their place; other columns than those asked for are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, keep, record_batch
from millrace.llm.rewrite import Appender, Column, schema_of

FILES = 500
VERSIONS, DRIFTED = 24, 16


def numbered(rows: DataFrame, files: int = FILES) -> DataFrame:
    """rows with r (from 0), file_no and version."""
    first, *rest = rows.columns
    keys = rows.withColumns({"crc": F.crc32(F.col(first).cast("string").cast("binary")), "tie": F.xxhash64(*rest), "nth": F.monotonically_increasing_id()})
    order = [F.col("crc").asc_nulls_last(), F.col(first).asc_nulls_last(), "tie", "nth"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = keep(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).select(*rows.columns, F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftright("at", 33)
    # One row per range partition, of which there are as many as spark.sql.shuffle.partitions says.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = own.withColumn("part", part).join(F.broadcast(totals), "part")
    r = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.select(*rows.columns, r.alias("r"), F.expr(f"1 + total div {files}").alias("in_file"))
    out = out.withColumn("file_no", F.expr("r div in_file")).drop("in_file")
    version = F.pmod(F.crc32(F.concat(F.lit("42:"), F.col("file_no").cast("string")).cast("binary")), F.lit(VERSIONS))
    return out.withColumn("version", F.when(version >= DRIFTED, F.lit(0)).otherwise(version).cast("long"))


def drift(columns: list[Column], version: int) -> list[Column]:
    """The columns that a file of this version has: ids stay, what they are called, where they stand and how wide they are drifts by bits."""
    names = {"name": "email", "email": "name"} if version & 1 else {}
    narrow = {"balance": pa.float32(), "nation_id": pa.int32()} if version & 8 else {}
    out = [Column(names.get(c.name, c.name), narrow.get(c.name, c.type), c.id) for c in columns if not (version & 4 and c.name in ("nation_id", "source"))]
    return [out[0], *reversed(out[1:])] if version & 2 else out


def write_files(rows: DataFrame, columns: list[Column], folder: str, attempts: str) -> DataFrame:
    """rows: as numbered() gives them. Writes folder/file-N.parquet and returns file_no, version and path of each."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartitionByRange(n, "file_no").sortWithinPartitions("r").select(*(c.name for c in columns), "file_no", "version")
    schema = "file_no bigint, version bigint, path string"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, have = None, None, []
        for batch in batches:
            numbers = batch.column("file_no")
            start = 0
            while start < batch.num_rows:
                number = numbers[start].as_py()
                end = start + int(pa.compute.sum(pa.compute.equal(numbers.slice(start), number)).as_py())
                if now is None or number != now[0]:
                    if out:
                        out.close()
                        yield record_batch({k: [v] for k, v in zip(("file_no", "version", "path"), now, strict=True)}, kinds)
                    version = batch.column("version")[start].as_py()
                    now = (number, version, f"{folder}/file-{number:05d}.parquet")
                    have = drift(columns, version)
                    out = Appender(now[2], attempts, schema_of(have))
                by_id = {c.id: batch.column(c.name).slice(start, end - start) for c in columns}
                out.append(pa.RecordBatch.from_arrays([by_id[c.id].cast(c.type, safe=False) for c in have], schema=out.schema))
                start = end
        if out:
            out.close()
            yield record_batch({k: [v] for k, v in zip(("file_no", "version", "path"), now, strict=True)}, kinds)

    kinds = arrow_schema(spark, schema)
    return keep(sorted_rows.mapInArrow(write, schema), "files")
