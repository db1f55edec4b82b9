"""Benchmark decontamination: document words that lie inside any occurrence of a benchmark window are hit.

The normalised windows (n consecutive words of an item; a shorter item is one window) are hashed, and the hash set is sent to
all tasks. Each task scans its texts once: windows made of benchmark words only are hashed, looked up, and then verified
word for word. No document is shuffled.

The set's size is checked: benchmark words are counted first and dealt into blocks of at most BLOCK_WINDOWS windows. With one
block, as with any usual benchmark, the scan is a single narrow pass. A larger benchmark is scanned one block at a time over
the kept documents' words, and the hits of each document are then joined.

Defined cases: a null text has no words; an item without words (or with a null text) has no window; a null item_id marks
words as hit but is not listed; items with equal windows are all listed; repeated rows are each reported; empty tables give
no rows (no documents) or no hits (no benchmark); other columns are ignored, and kept by clean().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, forget, keep, scan

WINDOW = 10
#: Windows that one broadcast block holds; at about 600 bytes each in a Python worker, 150 MB.
BLOCK_WINDOWS = 250_000

_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and other characters beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


class Windows:
    """The benchmark's windows, by length, as hashes of word numbers, with the items of each."""

    def __init__(self, items: list[tuple[int | None, bytes]], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), set()).update([item] if item is not None else [])
        self.items = {size: {w: tuple(s) for w, s in x.items()} for size, x in found.items()}
        self.hashes = {size: np.unique(_hash(np.array(list(x), np.int64).T)) for size, x in self.items.items()}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Whether each word is hit, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(gaps[size:] == gaps[:-size]) if len(words) >= size else ()
            if len(at):
                own = _hash([ids[at + k] for k in range(size)])
                place = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                for i in at[hashes[place] == own].tolist():
                    if (what := self.items[size].get(tuple(ids[i : i + size].tolist()))) is not None:
                        hit[i : i + size] = True
                        items.update(what)
        return hit, items


def _hash(columns) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h + c.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _blocks(benchmark: DataFrame, n: int, block_windows: int) -> list[list[tuple]]:
    """Yields the benchmark's rows in blocks of bounded size; one block at a time is on the driver."""
    spaces = F.size(F.split(F.regexp_replace("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "))
    rows = benchmark.select("item_id", F.col("text").cast("binary").alias("body"), spaces.cast("long").alias("n")).where("body is not null")
    n_blocks = int((rows.agg(F.sum("n")).first()[0] or 0) // block_windows) + 1
    for k in range(n_blocks):
        part = rows if n_blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n_blocks)) == k)
        yield n_blocks, [(r.item_id, bytes(r.body)) for r in part.select("item_id", "body").collect()]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_windows: int = BLOCK_WINDOWS, row: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, hit_words (array of [first, end) word numbers), spans (the same in code points), items (ids, sorted).

    row: a further column that is passed through.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *([row] if row else []))
    more = f", {row} {docs.schema[row].dataType.simpleString()}" if row else ""
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}{more}, n_words bigint, hit_words array<struct<first:bigint,end:bigint>>, spans array<struct<first:bigint,end:bigint>>, items array<{item_kind}>"
    parts = []
    for n_blocks, items in _blocks(benchmark, n, block_windows):
        if n_blocks > 1 and not parts:
            own = keep(own.withColumn("__row", F.monotonically_increasing_id()), "documents")
            schema = f"__row bigint, {schema}"
        windows = spark.sparkContext.broadcast(Windows(items, n))
        extra = ([row] if row else []) + (["__row"] if n_blocks > 1 else [])

        def one(batch: pa.RecordBatch, windows=windows, extra=extra) -> dict:
            out = {"doc_id": batch["doc_id"], "n_words": [], "hit_words": [], "spans": [], "items": []} | {c: batch[c] for c in extra}
            for text in batch["text"].to_pylist():
                words = words_of(text)
                hit, found = windows.value.hits(words)
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist() if found or hit.any() else []
                ranges = [{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                at = [m.span() for m in _WORD.finditer(text.decode("utf-8", "replace"))] if ranges else []
                out["n_words"].append(len(words))
                out["hit_words"].append(ranges)
                out["spans"].append([{"first": at[r["first"]][0], "end": at[r["end"] - 1][1]} for r in ranges])
                out["items"].append(sorted(found))
            return out

        parts.append(scan(own, one, schema))
    if len(parts) == 1:
        return parts[0]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    union = union.groupBy("__row").agg(*(F.first(c).alias(c) for c in ["doc_id", *([row] if row else []), "n_words"]), *(F.flatten(F.collect_list(c)).alias(c) for c in ("hit_words", "spans", "items")))
    return union.select("doc_id", *([row] if row else []), "n_words", _merged("hit_words"), _merged("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _merged(ranges: str):
    """Overlapping or touching ranges of one document, joined. At most one range per block and occurrence is in the array."""
    joined = f"""aggregate(array_sort({ranges}), cast(array() as array<struct<first:bigint,end:bigint>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).end >= x.first
        then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).first as first, greatest(element_at(acc, -1).end, x.end) as end)))
        else concat(acc, array(x)) end)"""
    return F.expr(joined).alias(ranges)


def clean(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, drop_documents: bool = False, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """docs without the hit spans (n_chars follows where there is such a column), or, on request, without the hit documents.

    A document of which nothing but hit words is left goes too; all others keep their columns.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    names = [f"c{k}" for k in range(len(docs.columns))]
    body = names[docs.columns.index("text")]
    size = names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True)) + ", cut boolean"

    def cleaned(docs: DataFrame, items: list[tuple]) -> DataFrame:
        windows = spark.sparkContext.broadcast(Windows(items, n))

        def one(batch: pa.RecordBatch) -> dict:
            old = batch[body].to_pylist()
            keep_rows, new = [], []
            for text in old:
                stays = True
                while stays:  # words that a cut brings together may make another window
                    hit = windows.value.hits(words_of(text.encode() if text is not None else None))[0]
                    if not hit.any():
                        break
                    stays, text = not (drop_documents or hit.all()), _without(text, hit)
                keep_rows.append(stays)
                new.append(text)
            out = {name: batch[name] for name in names} | {body: pa.array(new, pa.string()), "cut": pa.array([x != y for x, y in zip(old, new, strict=True)], pa.bool_())}
            if size:
                out[size] = pa.array([k if x == y else len(x) for x, y, k in zip(new, old, batch[size].to_pylist(), strict=True)], batch[size].type)
            mask = pa.array(keep_rows, pa.bool_())
            return {name: c.filter(mask) for name, c in out.items()}

        return scan(docs, one, schema)

    out, again = docs.toDF(*names), True
    while again:
        again = False
        # One block is on the executors at a time: with several, the documents are kept after each.
        for n_blocks, items in _blocks(benchmark, n, block_windows):
            if n_blocks == 1:
                return cleaned(out, items).drop("cut").toDF(*docs.columns)
            done = keep(cleaned(out, items), "cleaned")
            if hasattr(out, "kept_at"):
                forget(out)
            again, out = again or not done.where("cut").isEmpty(), done.drop("cut")
            out.kept_at = done.kept_at
    return out.toDF(*docs.columns)


def _without(text: str, hit: np.ndarray) -> str:
    """Cuts from the first hit word's start to the last one's end, for each run of hit words."""
    out, at, inside = [], 0, False
    for m, h in zip(_WORD.finditer(text), hit.tolist(), strict=True):
        if h and not inside:
            out.append(text[at : m.start()])
        if h:
            at = m.end()
        inside = h
    return "".join([*out, text[at:]])
