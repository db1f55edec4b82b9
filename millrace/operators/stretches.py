"""Stretches of links, or of other things in a row: each learns the first one of its stretch and its place in it, by pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import BLOCK, together
from millrace.plans.storage import keep


def jumped(rows: DataFrame) -> DataFrame:
    """rows: query_id, id, before (the link before it on its stretch; null for the first, or a name that no row has), at. query_id, id, head (the first link, or that name), place.

    What lies together is followed within each task's own rows first, so only what crosses from one task's to another's takes rounds. A link that knows its head takes no part in them but to tell it.
    """
    near = keep(followed(together(rows).select("query_id", "id", "before")), "places")
    told, left, todo = near.where("done"), near.where("not done"), None
    while True:
        n = left.count()
        # If as many are left as before, they lie on closed rings.
        if n == 0 or n == todo:
            return told.drop("done")
        todo = n
        ahead = told.unionByName(left).select("query_id", F.col("id").alias("head"), F.col("head").alias("next"), F.col("place").alias("more"), F.col("done").alias("known"))
        # Few are left after the first round, so only what they ask for is joined.
        ahead = ahead.join(left.select("query_id", "head").distinct(), ["query_id", "head"], "left_semi")
        new = left.join(ahead, ["query_id", "head"], "left")
        new = keep(new.select("query_id", "id", F.coalesce("next", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.coalesce("known", F.lit(True)).alias("done")), "places")
        told, left = told.unionByName(new.where("done")), new.where("not done")


def followed(rows: DataFrame) -> DataFrame:
    """rows: query_id, id, before. query_id, id, head, place, done: as far back as BLOCK rows of a task lead. Where they lead out of them, the head is the link there, and it is not done."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, head {kinds['id']}, place int, done boolean"

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        query, id_, before = (pa.concat_arrays(t[c].chunks) for c in ("query_id", "id", "before"))
        key = lambda c: pc.binary_join_element_wise(query.cast(pa.string()), c.cast(pa.string()), "\x00")
        own = np.arange(len(id_))
        found = pc.index_in(key(before), value_set=key(id_)).fill_null(-1).to_numpy(zero_copy_only=False)
        last = found < 0
        at, place = np.where(last, own, found), (~last).astype(np.int64)
        for _ in range(len(own).bit_length() + 1):
            place, at = place + place[at], at[at]
        # What lies on a ring gets nowhere: it stays as it was.
        ring = ~last[at]
        at, place = np.where(ring, own, at), np.where(ring, 0, place)
        first = before.is_null().to_numpy(zero_copy_only=False)[at]
        head = pc.if_else(pa.array(first), id_.take(pa.array(at)), before.take(pa.array(at)))
        return pa.RecordBatch.from_arrays([query, id_, head, pa.array(place + ~first, pa.int32()), pa.array(first)], names=["query_id", "id", "head", "place", "done"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield whole(held)
                held, n = [], 0
        if n:
            yield whole(held)

    return rows.mapInArrow(run, schema)
