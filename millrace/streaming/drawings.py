"""New drawings as they arrive: each micro-batch of files is parsed, normalized and kept as a version of its drawings.

A drawing that comes again, under the same id, supersedes its earlier version as a whole: load() takes each drawing's rows from the last batch that had it, and what the new version lacks
is gone. Earlier versions stay on disk, so a reader of an older state is not disturbed, and a batch that is run again writes to the same folder and so replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources import drawings
from millrace.sources.drawings import Plant

TABLES = ("entities", "sub_objects", "identifiers", "connections", "properties", "warnings", "objects")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000, ids: str = "path") -> StreamingQuery:
    """Reads the files under source, in folders of any depth, that are new, and stops. ids: what a drawing is called, its path or its file's name; by name, a file that comes again in another folder is a new version.

    Of several files of one name in one batch, that with the last time of change counts, and of equal ones the last path.
    """
    if ids not in drawings.IDS:
        raise ValueError(f"ids must be one of {', '.join(drawings.IDS)}")
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).load(source)
    own = F.col("path") if ids == "path" else drawings.drawing_name(F.col("path"))

    def write(batch: DataFrame, number: int) -> None:
        named = batch.select(own.alias("drawing_id"), "path", "modificationTime")
        last = named.groupBy("drawing_id").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"))
        # Contents are joined by path, so that no two of them meet in one group.
        objects = batch.select("path", "content").join(last, "path").select("drawing_id", "content").mapInPandas(drawings.parsed, drawings.OBJECTS)
        plant = drawings.normalize(objects)
        for name in TABLES:
            getattr(plant, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        last.write.mode("overwrite").parquet(f"{target}/versions/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, target: str) -> Plant:
    """The tables of all drawings, each in its last version."""
    newest = spark.read.parquet(f"{target}/versions").groupBy("drawing_id").agg(F.max("batch").alias("batch"))
    return Plant(**{name: spark.read.parquet(f"{target}/{name}").join(newest, ["drawing_id", "batch"], "left_semi").drop("batch") for name in TABLES})
