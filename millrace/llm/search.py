"""Ranked lexical search: the k best documents of each query, by MaxScore in every shard.

One scan counts what the scores need of all documents: how many have a term, how many terms they have, and in how many each query term
occurs. The scan also keeps the index: of each document its length and its query terms with their frequencies, in rows of a few numbers.

A shard is a stretch of a task's index, of about SHARD_POSTINGS postings, as posting lists: for each term its documents, and what it adds to
their scores. Its largest addition is the term's bound. For each query the terms are put in order of their bounds. The first ones,
whose bounds together stay below the score of the query's k-th best document so far, are non-essential: a document with these terms alone can't qualify. So only
the lists of the other, essential terms are read whole; they give the candidates. The non-essential lists are probed from the largest bound
down, for those candidates alone that can still reach the k-th best score. The best so far go from shard to shard of a task. Each
task returns k documents a query at most; the k best of those are the result, the same as by scoring every document.

Queries are broadcast in blocks of bounded size (BLOCK_TERMS terms); each block is a scan of its own.

Scores are integers (see addition()), so they are the same on every machine. The sum of a document's length and other counts has no bound but 64 bits.

Defined cases: null texts, and texts without a term, have no terms: as documents they are never found, as queries they find nothing. Equal scores go by ascending
doc_id, null ids last; repeated rows are documents of their own; rows that repeat item_id and text are one query; equal item_ids with
different texts are ranked apart. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, bounded_batches, keep, record_batch
from millrace.llm.decontamination import words_of

BEST = 10
#: Query terms that one broadcast block holds; 100 MB in a Python worker.
BLOCK_TERMS = 1_000_000
#: Postings that a task holds at once; a document of more makes a shard of its own.
SHARD_POSTINGS = 1_000_000

_INDEX = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_share(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 for a document of mean length; exact beyond 64 bits."""
    return np.array([25 + 75 * x * n_docs // n_terms for x in n.tolist()], np.int64)


def addition(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Shard:
    """Posting lists of a stretch of documents."""

    def __init__(self, ids: list, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.scores = ids, np.zeros(len(ids), np.int64)
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(terms, kind="stable")
        terms, doc, counts = terms[order], doc[order], counts[order].astype(np.int64)
        adds = addition(counts, length_share(n, n_docs, n_terms)[doc], weights[terms])
        own, starts = np.unique(terms, return_index=True)
        ends = np.append(starts[1:], len(terms))
        # term -> (documents ascending, additions, the largest addition)
        self.lists = {t: (doc[a:b], adds[a:b], int(adds[a:b].max())) for t, a, b in zip(own.tolist(), starts.tolist(), ends.tolist(), strict=True)}

    def candidates(self, query: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may have a score of `least` or more, and their whole scores. query: (term, repeats)."""
        lists = sorted(((reps * found[2], reps, found) for term, reps in query if (found := self.lists.get(term)) and found[2]), key=lambda x: x[0])
        bounds = np.cumsum([x[0] for x in lists], dtype=np.int64)
        first = int(np.searchsorted(bounds, least))  # all terms before it are non-essential
        for _, reps, (docs, adds, _) in lists[first:]:
            self.scores[docs] += reps * adds
        docs = np.unique(np.concatenate([x[2][0] for x in lists[first:]])) if first < len(lists) else np.empty(0, np.int64)
        scores = self.scores[docs]
        self.scores[docs] = 0
        for k in range(first - 1, -1, -1):
            able = scores + bounds[k] >= least
            docs, scores = docs[able], scores[able]
            if not len(docs):
                break
            _, reps, (own, adds, _) = lists[k]
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            scores += np.where(own[at] == docs, reps * adds[at], 0)
        able = (scores >= least) & (scores > 0)
        return docs[able], scores[able]


class Best:
    """The k best documents of one query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def least(self) -> int:
        """What a document needs at least; with as much, its id decides."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows = heapq.nsmallest(self.k, [*self.rows, *zip(scores, ids, strict=True)], key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The queries in blocks of bounded size, as (item_id, text); one block at a time is on the driver."""
    rows = items.select("item_id", F.col("text").cast("binary").alias("body")).where("body is not null").distinct()
    n_blocks = int((rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // (4 * most)) + 1
    for k in range(n_blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n_blocks)) == k) if n_blocks > 1 else rows
        yield [(r.item_id, bytes(r.body)) for r in part.collect()]


def _index(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """Of each document with a term: doc_id, n, and its query terms with their counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = {"doc_id": [], "n": [], "terms": [], "counts": []}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    own = Counter(known[w] for w in words if w in known)
                    for column, value in zip(out.values(), (doc_id, len(words), list(own), list(own.values())), strict=True):
                        column.append(value)
            yield record_batch(out, kinds)

    kinds = arrow_schema(spark, _INDEX)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("text is not null").mapInArrow(run, _INDEX)


def search(docs: DataFrame, items: DataFrame, k: int = BEST, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """docs: doc_id, text. items: item_id, text. Returns item_id, rank (from 1), doc_id, score: up to k rows for each item."""
    spark = docs.sparkSession
    bounded_batches(spark)
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"query int, item_id {item_kind}, doc_id bigint, score bigint"
    kinds = arrow_schema(spark, schema)
    parts = []
    for block in _blocks(items, block_terms):
        number: dict[bytes, int] = {}
        queries = [(item, Counter(number.setdefault(w, len(number)) for w in words_of(text))) for item, text in block]
        index = keep(_index(docs, number), "index")
        totals = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        n_docs, n_terms = totals[0], int(totals[1] or 0)
        # One row per query term.
        df = {r.term: r.n for r in index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
        weights = np.array([weight(n_docs, df[t]) if t in df else 0 for t in range(len(number))], np.int64)
        shared = spark.sparkContext.broadcast((weights, [(item, list(terms.items())) for item, terms in queries]))

        def best(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            weights, queries = shared.value
            found = [Best(k) for _ in queries]
            for table in _stretches(batches, shard_postings):
                lists = table.column("terms").combine_chunks()
                sizes = np.diff(lists.offsets.to_numpy())
                shard = Shard(table.column("doc_id").to_pylist(), table.column("n").to_numpy(), sizes, lists.flatten().to_numpy(), table.column("counts").combine_chunks().flatten().to_numpy(), weights, n_docs, n_terms)
                for own, (_, query) in zip(found, queries, strict=True):
                    docs, scores = shard.candidates(query, own.least)
                    if len(docs):
                        own.add([shard.ids[d] for d in docs.tolist()], scores.tolist())
            rows = [(q, queries[q][0], doc, score) for q, own in enumerate(found) for score, doc in own.rows]
            yield record_batch(dict(zip(("query", "item_id", "doc_id", "score"), zip(*rows, strict=True) if rows else [[]] * 4, strict=True)), kinds)

        every = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        # Ranks are cut in each task before the shuffle; it moves k rows for each query and task at most.
        ranked = index.where(F.size("terms") > 0).mapInArrow(best, schema).withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)
        parts.append(ranked.select("item_id", "rank", "doc_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _stretches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += len(batch.column("terms").flatten())
        if n >= most:
            yield pa.Table.from_batches(waiting)
            waiting, n = [], 0
    if waiting:
        yield pa.Table.from_batches(waiting)
