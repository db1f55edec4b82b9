"""Helpers that every training-data operator shares: reading a table's columns, scanning texts in
bounded Arrow batches, and keeping an intermediate table in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.storage import forget, keep  # noqa: F401

#: Most rows that Spark hands to a Python worker at once; with long texts the default of 10,000 rows is too much memory.
ROWS_PER_BATCH = 500


def bounded_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text's UTF-8 bytes, and the other columns asked for; extra columns of docs are left behind."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def scan(df: DataFrame, one: Callable[[pa.RecordBatch], dict[str, list] | None], schema: str) -> DataFrame:
    """Applies one(batch) -> columns to every batch, without a shuffle and without state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if (columns := one(batch)) is not None:
                yield record_batch(columns, kinds)

    kinds = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict, kinds: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in kinds], schema=kinds)


def smallest_hashed(df: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` rows, those whose column has the smallest hash.

    A share of the hash range that holds about four times as many rows is kept first, so that no task and no shuffle sees more, however large df is.
    """
    whole = 1 << 30
    h = F.pmod(F.xxhash64(column), F.lit(whole))
    share = min(1.0, 4 * most / max(1, df.count()))
    return df.where(h <= int(share * whole)).orderBy(h, column).limit(most)
