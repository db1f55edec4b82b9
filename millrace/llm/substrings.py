"""Substring deduplication by content-defined chunks.

A gear rolling hash over the text's bytes (16-bit register, so it depends on the last 16 bytes) marks where chunks end; since only
content decides, text inserted before a passage shifts its chunks without changing them. Chunks of equal digest (128 bits) are the
same text. Of the places of a chunk, the one in the document of the smallest doc_id, and there the foremost, is the first; all
others, in other documents or the same, are repeats, and adjoining repeats of MIN_WORDS words or more make a span.

Texts are chunked twice, so no text is shuffled or kept. The first scan sends half a digest and a hash of the place, combined by
task, so a chunk that is in a third of all documents sends one row per task; the second sends the whole digests and places to the
halves found twice, by a join that Spark splits where a digest is frequent. Only the repeats that are left are compared in full.

Defined cases: null and empty texts have no chunk; rows that repeat both doc_id and text are one document; rows of one doc_id with
other texts are documents of their own; rows with a null doc_id are documents by their text, after all others; an empty table gives
no rows; other columns are ignored, and kept by remove(). doc_id is an integer, of either sign.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, keep, scan

#: A boundary is where the register's first BITS bits are 0: once in 32 bytes.
BITS = 5
#: Boundaries closer to the one before than this are none. Longer chunks than LONGEST are cut where the register is least.
SHORTEST, LONGEST = 8, 192
MIN_WORDS = 25
#: Most documents with spans that remove() broadcasts; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
GEAR = np.random.default_rng(7).integers(0, 2**16, 256, dtype=np.uint16)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _register(b: np.ndarray) -> np.ndarray:
    """The gear hash after each byte."""
    h = GEAR[b]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def _apart(at: list[int], start: int, end: int) -> list[int]:
    """Of ascending cuts, those SHORTEST or more behind the one before (start at first) and before end."""
    out = []
    for x in at:
        if x - start >= SHORTEST and end - x >= SHORTEST:
            out.append(x)
            start = x
    return out


def _inside(h: np.ndarray, start: int, end: int) -> list[int]:
    """Cuts of a gap without boundaries, where the register is least; again in what is still longer than LONGEST.

    Text that repeats itself has the least value once in each period, so equal runs fall into equal chunks wherever they begin.
    """
    out, todo = [], [(start, end)]
    while todo:
        a, z = todo.pop()
        own = h[a + SHORTEST - 1 : z - SHORTEST]
        cuts = _apart((np.flatnonzero(own == own.min()) + a + SHORTEST).tolist(), a, z) if len(own) else []
        out += cuts
        edges = [a, *cuts, z]
        todo += [(x, y) for x, y in zip(edges, edges[1:], strict=False) if cuts and y - x > LONGEST]
    return out


def boundaries(b: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text's bytes; the last is its length."""
    h = _register(b)
    at = np.flatnonzero(h[15:] >> np.uint16(16 - BITS) == 0) + 16
    if len(at):
        at = at[np.concatenate(([True], np.diff(at) >= SHORTEST))]
    ends = np.unique(np.concatenate((at[at < len(b)], [len(b)])))
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONGEST).any():
        more = [x for end, gap in zip(ends[gaps > LONGEST].tolist(), gaps[gaps > LONGEST].tolist(), strict=True) for x in _inside(h, end - gap, end)]
        ends = np.unique(np.concatenate((ends, np.array(more, np.int64))))
    for _ in range(3):  # never inside a character
        inside = (ends < len(b)) & ((b[np.minimum(ends, len(b) - 1)] & 0xC0) == 0x80)
        ends = ends + inside
    return np.unique(ends).astype(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, copy (a hash of the text: with doc_id it names a document) and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, copy, hi and lo (the digest), place (start * 2^24 + length * 2^12 + words that start in it, in bytes). docs: as numbered() gives them."""
    bounded_batches(docs.sparkSession)

    def one(batch: pa.RecordBatch) -> dict | None:
        import xxhash

        digest = xxhash.xxh3_128_digest
        rows, places, digests = [], [], []
        for row, text in enumerate(batch["text"].to_pylist()):
            if not text:
                continue
            b = np.frombuffer(text, np.uint8)
            ends = boundaries(b)
            starts = np.concatenate(([0], ends[:-1]))
            space = _SPACE[b]
            first = ~space
            first[1:] &= space[:-1]
            words = np.add.reduceat(first, starts, dtype=np.int64)
            places.append((starts << 24) + ((ends - starts) << 12) + words)
            rows.append(np.full(len(ends), row))
            digests += [digest(text[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
        if not rows:
            return None
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(np.concatenate(rows))
        return {"doc_id": batch["doc_id"].take(at), "copy": batch["copy"].take(at), "hi": pa.array(np.ascontiguousarray(d[:, 0])), "lo": pa.array(np.ascontiguousarray(d[:, 1])), "place": pa.array(np.concatenate(places))}

    return scan(docs, one, "doc_id bigint, copy bigint, hi bigint, lo bigint, place bigint")


def spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated span: doc_id, start and end (bytes of the text), n_words, n_chunks, first_doc_id (of its first chunk), first_doc_ids (of all).

    With doc_id, the column copy joins it to docs, as numbered() gives it.
    """
    every = chunks(numbered(docs))
    # Two places of a chunk differ in their hashes; if they don't, once in 10^19, the pair alone is not seen here.
    where = F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "copy", "place")
    several = every.select("hi", where.alias("at")).groupBy("hi").agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a <> b").select("hi")
    # Tables of their own: a join that is fed by the very shuffle of the sums can't be split where a digest is frequent.
    several = keep(several, "several")
    twice = keep(every.join(several, "hi", "left_semi"), "repeats")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy", "place")
    first = twice.groupBy("hi", "lo").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("hi", "lo", "first")
    first = keep(first, "first")
    later = twice.join(first, ["hi", "lo"]).where(~order.eqNullSafe(F.col("first"))).select("doc_id", "copy", "place", F.col("first.doc_id").alias("first"), F.col("first.none").alias("unnamed")).distinct()
    start, length = F.shiftright("place", 24), F.shiftright("place", 12).bitwiseAND(0xFFF)
    later = later.select("doc_id", "copy", "first", "unnamed", start.alias("start"), (start + length).alias("end"), F.col("place").bitwiseAND(0xFFF).alias("words"))
    order = Window.partitionBy("doc_id", "copy").orderBy("start")
    broken = F.coalesce(F.lag("end").over(order) < F.col("start"), F.lit(True))
    runs = later.withColumn("broken", broken.cast("int")).withColumn("run", F.sum("broken").over(order))
    out = runs.groupBy("doc_id", "copy", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"), F.count(F.lit(1)).alias("n_chunks"), F.min_by("first", "start").alias("first_doc_id"), F.array_sort(F.collect_set("first")).alias("first_doc_ids"))
    return out.where(F.col("n_words") >= min_words).drop("run")


def remove(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs, all rows and columns, with repeated spans cut out at every place but the first (n_chars follows where there is such a column)."""
    found = keep(spans(docs, min_words).groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts")), "cuts")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    # The user's columns get names of their own, so that none clashes with those made here.
    names = {name: f"c{k}" for k, name in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    same = own[names["doc_id"]].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(own[names["text"]]) == found["copy"])
    joined = own.join(found, same, "left").select(*names.values(), "cuts")
    schema = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in docs.schema)
    body, size = names["text"], names.get("n_chars")

    def one(batch: pa.RecordBatch) -> dict:
        old = batch[body].to_pylist()
        new = []
        for text, cuts in zip(old, batch["cuts"].to_pylist(), strict=True):
            if cuts:
                whole, at, out = text.encode(), 0, []
                for c in cuts:
                    out.append(whole[at : c["start"]])
                    at = c["end"]
                text = b"".join([*out, whole[at:]]).decode()
            new.append(text)
        out = {c: batch[c] for c in batch.schema.names if c != "cuts"} | {body: pa.array(new, pa.string())}
        if size:
            out[size] = pa.array([n if a == b else len(a) for a, b, n in zip(new, old, batch[size].to_pylist(), strict=True)], batch[size].type)
        return out

    return scan(joined, one, schema).toDF(*docs.columns)
