"""Drifted schema rewrite: files whose columns were renamed, reordered, dropped or narrowed become files of one evolved schema.

Columns are matched by Parquet field id, never by name or place. Each task takes whole files, one after the other. A file is read in
batches of its row groups; each batch goes through an id-indexed column plan (take and cast, or fill), is appended to a ParquetWriter,
and updates two sha256 digests. So a task holds a batch and no more, however long the file is. A file that has the evolved schema
already is only read, for its digests, and stays as it is.

A rewritten file is first written under a name of its own in an attempts folder and then renamed, so a task may be repeated at any time.
The drifted files are deleted only after all new ones are there, by tasks too. What passes the driver is one count of files.

Defined cases: nulls stay nulls; a column that a file lacks is filled with the column's fill, null if it has none; a file's columns with
other ids, or with none, are left out; two columns of one id, or a value that the evolved type can't hold, are an error; a file
without rows is rewritten like any other; no files give no rows; texts have any length that a row group can hold.
In the digests a null is `?`, a time its microseconds since 1970, a floating number floor(2^20 * x) or nan, inf, -inf.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, keep, record_batch, scan

FIELD_ID = b"PARQUET:field_id"
#: Rows in a batch, and so in a row group of what is written.
BATCH_ROWS = 16_384
FILES_PER_TASK = 8
RESULT = "source_path string, path string, n_rows bigint, n_nulls bigint, ids_sha256 string, rows_sha256 string, start_columns string, columns string, rewritten boolean"


@dataclass(frozen=True)
class Column:
    name: str
    type: pa.DataType
    id: int
    fill: Any = None


def schema_of(columns: list[Column]) -> pa.Schema:
    return pa.schema([pa.field(c.name, c.type, metadata={FIELD_ID: str(c.id).encode()}) for c in columns])


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a URI as Hadoop writes them; executors open the folder that the cluster shares with it."""
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


@dataclass
class Plan:
    """For each evolved column the number of the file's column with its id, or None."""

    target: list[Column]
    have: pa.Schema
    takes: list[int | None] = field(init=False)
    untouched: bool = field(init=False)

    def __post_init__(self):
        ids = [int(f.metadata[FIELD_ID]) if f.metadata and FIELD_ID in f.metadata else None for f in self.have]
        known = [i for i in ids if i is not None]
        if len(set(known)) < len(known):
            raise ValueError(f"two columns have one field id: {sorted(known)}")
        at = {i: n for n, i in enumerate(ids)}
        self.takes = [at.get(c.id) for c in self.target]
        self.untouched = [(f.name, f.type, i, f.nullable) for f, i in zip(self.have, ids, strict=True)] == [(c.name, c.type, c.id, True) for c in self.target]

    def apply(self, batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
        columns = []
        for c, n in zip(self.target, self.takes, strict=True):
            columns.append(pa.repeat(pa.scalar(c.fill, c.type), batch.num_rows) if n is None else batch.column(n).cast(c.type))
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def shown(column: pa.Array) -> pa.Array:
    """A column's values as the digests have them."""
    kind = column.type
    if pa.types.is_timestamp(kind):
        column = column.cast(pa.timestamp("us", kind.tz)).cast(pa.int64())
    elif pa.types.is_floating(kind):
        scaled = pc.multiply(column.cast(pa.float64()), 1048576.0)
        try:
            column = pc.floor(scaled).cast(pa.int64())
        except pa.ArrowInvalid:  # nan, inf, or beyond 64 bits
            return pa.array([None if x is None else str(math.floor(x)) if math.isfinite(x) else str(x) for x in scaled.to_pylist()], pa.string())
    return column.cast(pa.string())


class Digests:
    """sha256 of the first column's values and of whole rows, over batches; and counts."""

    def __init__(self):
        self.ids, self.rows, self.n_rows, self.n_nulls = hashlib.sha256(), hashlib.sha256(), 0, 0

    def update(self, batch: pa.RecordBatch) -> None:
        if not batch.num_rows:
            return
        fields = [shown(c) for c in batch.columns]
        rows = pc.binary_join_element_wise(*fields, "|", null_handling="replace", null_replacement="?")
        for digest, values, between in ((self.ids, fields[0].fill_null("?"), ","), (self.rows, rows, "\n")):
            digest.update(((between if self.n_rows else "") + between.join(values.to_pylist())).encode())
        self.n_rows += batch.num_rows
        self.n_nulls += sum(c.null_count for c in batch.columns)


class Appender:
    """A Parquet file that grows by batches under a name of its own in `attempts`, and gets its real name when it is whole."""

    def __init__(self, path: str, attempts: str, schema: pa.Schema):
        self.schema, self.waiting, self.n = schema, [], 0
        self.fs, self.path = place(path)
        folder = place(attempts)[1]
        for new in (folder, self.path.rpartition("/")[0]):
            self.fs.create_dir(new, recursive=True)
        self.attempt = f"{folder}/{uuid.uuid4().hex}.parquet"
        self.writer = pq.ParquetWriter(self.attempt, schema, filesystem=self.fs)

    def append(self, batch: pa.RecordBatch) -> None:
        self.waiting.append(batch)
        self.n += batch.num_rows
        if self.n >= BATCH_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            self.writer.write_table(pa.Table.from_batches(self.waiting, self.schema))
        self.waiting, self.n = [], 0

    def close(self) -> None:
        self._flush()
        self.writer.close()
        if self.fs.type_name != "local" and self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)  # of an earlier attempt, with the same rows
        self.fs.move(self.attempt, self.path)


def rewrite_file(path: str, target: list[Column], attempts: str) -> dict:
    """Rewrites one file beside itself, in constant memory; returns its row of RESULT. The old file stays."""
    fs, at = place(path)
    schema, digests = schema_of(target), Digests()
    with fs.open_input_file(at) as source, pq.ParquetFile(source) as file:
        plan = Plan(target, file.schema_arrow)
        to = path if plan.untouched else f"{path.removesuffix('.parquet')}-evolved.parquet"
        out = None if plan.untouched else Appender(to, attempts, schema)
        for batch in file.iter_batches(batch_size=BATCH_ROWS, use_threads=False):
            evolved = plan.apply(batch, schema)
            digests.update(evolved)
            if out:
                out.append(evolved)
        if out:
            out.close()
    return {
        "source_path": path, "path": to, "n_rows": digests.n_rows, "n_nulls": digests.n_nulls, "ids_sha256": digests.ids.hexdigest(), "rows_sha256": digests.rows.hexdigest(),
        "start_columns": ",".join(plan.have.names), "columns": ",".join(schema.names), "rewritten": not plan.untouched,
    }


def rewrite(files: DataFrame, target: list[Column], attempts: str) -> DataFrame:
    """files: path, one row per Parquet file. Turns each into the evolved schema and returns a row per file (RESULT).

    attempts: a folder of the same file system for unfinished files, outside those that hold files; it is deleted at the end.
    """
    spark = files.sparkSession
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), files.count() // FILES_PER_TASK)
    spread = files.select("path").repartition(n_tasks)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([pa.field(f.name, f.type) for f in result])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                row = rewrite_file(path, target, attempts)
                yield record_batch({k: [v] for k, v in row.items()}, kinds)

    result = arrow_schema(spark, RESULT)
    # Kept before anything is deleted: the rows are the record of what was rewritten.
    done = keep(spread.mapInArrow(each, RESULT), "rewritten")
    scan(done.where("rewritten").select("source_path").repartition(n_tasks), _delete, "n bigint").agg(F.sum("n")).collect()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(attempts)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return done


def _delete(batch: pa.RecordBatch) -> dict[str, list]:
    for path in batch.column(0).to_pylist():
        fs, at = place(path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:  # a repeated task finds it gone
            fs.delete_file(at)
    return {"n": [batch.num_rows]}
