"""The rewrite against a plain version that knows nothing of field ids, on rows with nulls, odd numbers, equal ids and long texts."""

import datetime as dt
import hashlib
import math
import os
import zlib

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace.llm import drifted, queries, rewrite
from millrace.llm.rewrite import FIELD_ID, Column

SCHEMA = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, r long, version string, `file no` int"


def clients(n):
    when = dt.datetime(2024, 2, 1, 6, 0, 0, 123456)
    rows = []
    for i in range(n):
        rows.append((i * 7, None if i % 5 == 0 else i, "crm" if i % 3 else None, None if i % 11 == 0 else when + dt.timedelta(hours=i), f"N{i} Ünsal|x", None if i % 4 == 0 else f"n{i}@example.net", "C\nity", None if i % 6 == 0 else i % 25, "retail", [1.1, -0.3, None, 12345.67, math.nan, math.inf][i % 6], 1, "v", 2))
    rows += [(None, 1, "web", when, "nobody", None, "", 3, "public", 0.0, 1, "v", 2), (14, 2, "web", when, "again", "x" * 100_000, "", 3, "public", 5.5, 1, "v", 2)]
    return rows


def balance(x, single):
    if x is None:
        return "?"
    x = pa.scalar(x, pa.float32()).as_py() if single else x
    return str(math.floor(x * 1048576)) if math.isfinite(x) else str(x)


def expected(rows):
    """file_no -> (version, rows as text, ids, nulls)."""
    crc = lambda x: zlib.crc32(str(x).encode())
    ordered = sorted(rows, key=lambda r: (r[0] is None, crc(r[0]) if r[0] is not None else 0, r[0] or 0))
    size, files = 1 + len(rows) // 500, {}
    for i, row in enumerate(ordered):
        files.setdefault(i // size, []).append(row)
    out = {}
    for number, own in files.items():
        version = v if (v := crc(f"42:{number}") % 24) < 16 else 0
        shown, nulls = [], 0
        for row in own:
            cid, master, source, at, name, email, city, nation, segment, bal = row[:10]
            if version & 4:
                source, nation = "none", -1
            values = [cid, master, source, at and int((at - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)), name, email, city, nation, segment]
            nulls += sum(x is None for x in [*values, bal])
            shown.append("|".join(["?" if x is None else str(x) for x in values] + [balance(bal, version & 8)]))
        out[number] = (version, shown, ["?" if r[0] is None else str(r[0]) for r in own], nulls)
    return out


@pytest.mark.parametrize("n", [0, 40, 700])
def test_against_a_plain_version(spark, tmp_path, n):
    rows = clients(n) if n else []
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "clients.parquet"))
    got = queries.op13_rewrite(spark, str(tmp_path)).collect()
    want = expected(rows)
    assert sorted(r.file_no for r in got) == sorted(want)
    names = queries.CLIENT_COLUMNS
    for r in got:
        version, shown, ids, nulls = want[r.file_no]
        assert (r.version, r.n_rows, r.n_nulls, r.rewritten) == (version, len(shown), nulls, version != 0)
        assert r.ids_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert r.rows_sha256 == hashlib.sha256("\n".join(shown).encode()).hexdigest()
        start = list(names)
        if version & 1:
            start[4], start[5] = "email", "name"
        if version & 4:
            start = [c for c in start if c not in ("nation_id", "source")]
        if version & 2:
            start = [start[0], *start[:0:-1]]
        assert r.start_columns.split(",") == start and r.columns.split(",") == names
        file = pq.ParquetFile(r.path.removeprefix("file:"))
        assert [(f.name, int(f.metadata[FIELD_ID]), f.nullable) for f in file.schema_arrow] == [(c, i, True) for i, c in enumerate(names, 1)]
        assert file.schema_arrow.field("nation_id").type == pa.int64() and file.schema_arrow.field("balance").type == pa.float64()
    if got:
        folder = os.path.dirname(got[0].path.removeprefix("file:"))
        assert sorted(x for x in os.listdir(folder) if not x.endswith(".crc")) == sorted(os.path.basename(r.path) for r in got)
        assert os.listdir(os.path.dirname(folder)) == ["files"]
    if n == 700:
        assert len({r.version for r in got}) == 16


TARGET = [Column("a", pa.int64(), 1), Column("b", pa.string(), 2, "none"), Column("c", pa.float64(), 3)]


def write(path, fields, columns, rows_in_group=None):
    schema = pa.schema([pa.field(n, t, metadata={FIELD_ID: str(i).encode()} if i else None) for n, t, i in fields])
    pq.write_table(pa.table(columns, schema=schema), path, row_group_size=rows_in_group)
    return str(path)


def test_many_row_groups_stay_whole_and_batches_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(rewrite, "BATCH_ROWS", 50)
    n = 777
    path = write(tmp_path / "f.parquet", [("x", pa.float32(), 3), ("b", pa.int32(), 1), ("odd", pa.int32(), 9), ("none", pa.int32(), None)], [list(range(n)), list(range(n)), [1] * n, [2] * n], 100)
    seen = []
    update = rewrite.Digests.update
    monkeypatch.setattr(rewrite.Digests, "update", lambda self, batch: (seen.append(batch.num_rows), update(self, batch))[1])
    row = rewrite.rewrite_file(path, TARGET, str(tmp_path / "attempts"))
    out = pq.read_table(row["path"])
    assert max(seen) <= 50 and sum(seen) == n and os.path.exists(path)
    assert out.to_pydict() == {"a": list(range(n)), "b": ["none"] * n, "c": [float(i) for i in range(n)]}
    again = rewrite.rewrite_file(path, TARGET, str(tmp_path / "attempts"))  # as a task that is run again does
    assert again == row and pq.read_table(row["path"]).equals(out)
    assert rewrite.rewrite_file(row["path"], TARGET, str(tmp_path / "attempts"))["rewritten"] is False


def test_faulty_files_are_errors(tmp_path):
    twice = write(tmp_path / "t.parquet", [("a", pa.int64(), 1), ("b", pa.int64(), 1)], [[1], [2]])
    with pytest.raises(ValueError, match="one field id"):
        rewrite.rewrite_file(twice, TARGET, str(tmp_path / "attempts"))
    text = write(tmp_path / "x.parquet", [("a", pa.string(), 1)], [["no number"]])
    with pytest.raises(pa.ArrowInvalid):
        rewrite.rewrite_file(text, TARGET, str(tmp_path / "attempts"))
    empty = write(tmp_path / "e.parquet", [("a", pa.int64(), 1)], [[]])
    assert rewrite.rewrite_file(empty, TARGET, str(tmp_path / "attempts"))["n_rows"] == 0


def test_drift_keeps_ids():
    columns = [Column(n, pa.string(), i) for i, n in enumerate(queries.CLIENT_COLUMNS, 1)]
    for version in range(16):
        own = drifted.drift(columns, version)
        assert len(own) == (8 if version & 4 else 10) and own[0].id == 1
        assert all((c.name == columns[c.id - 1].name) != bool(version & 1 and c.id in (5, 6)) for c in own)
