import zlib

from tests.llm.helpers import AWKWARD, documents

from millrace.llm.queries import op10_sharding
from millrace.llm.sharding import shards, write_shards


def plain(rows, n):
    items = []
    for doc, text in rows:
        body = (text or "").encode()
        items.append((zlib.crc32(body), len(body) + 1, (doc is not None, doc or 0), doc))
    items.sort(key=lambda x: x[:3])
    total, at, slots, out = sum(x[1] for x in items), 0, {}, []
    for crc, size, _, doc in items:
        shard = at * n // total
        out.append((doc, size, crc, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        at += size
    return sorted(out, key=str)


def test_against_a_plain_loop(spark):
    rows = AWKWARD + [(i, "ab" * (i % 40)) for i in range(100, 500)]
    got = shards(documents(spark, rows, clash=True)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows, 8)


def test_one_document_holds_a_third(spark):
    rows = [(i, "a" * 100) for i in range(60)] + [(99, "b" * 3000)]
    got = shards(documents(spark, rows), 4).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(plain(rows, 4))


def test_empty_table(spark):
    assert shards(documents(spark, [])).count() == 0


def test_files(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(100)]
    write_shards(documents(spark, rows), f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.doc_id, r.text) for r in back) == rows and {r.shard for r in back} == set(range(8))


def test_files_of_repeated_rows_and_clashing_columns(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (1, "a"), (None, None), (None, ""), (2, "b")]
    write_shards(documents(spark, rows, clash=True), f"{tmp_path}/out", 2)
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(rows, key=str) and all(r.shard == 7 for r in back)
    for k in (0, 1):
        slots = sorted(r.slot for r in back if r.shard_ == k)
        assert slots == list(range(len(slots)))


def test_equal_texts_lie_together(spark):
    rows = [(i, f"text {i % 50}") for i in range(2000)]
    homes = {}
    for r in shards(documents(spark, rows)).collect():
        homes.setdefault(r.text_crc32, set()).add(r.shard)
    assert sum(len(x) - 1 for x in homes.values()) <= 7


def test_query_columns(spark, tmp_path):
    documents(spark, AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    got = op10_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and got.count() == len(AWKWARD)
