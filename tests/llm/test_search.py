"""The ranking against scoring every document in plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import search
from tests.llm.helpers import AWKWARD, documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [] if text is None else TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def plain(docs, items, k=10):
    texts = [(i, own) for i, t in docs if (own := terms(t))]
    n_docs, n_terms = len(texts), sum(len(own) for _, own in texts)
    df = Counter(t for _, own in texts for t in set(own))
    counted = [(i, len(own), Counter(own)) for i, own in texts]
    out = []
    for item, text in dict.fromkeys(items):
        query = Counter(terms(text))
        scored = []
        for i, n, tf in counted:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(reps * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, reps in query.items() if tf[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **more):
    found = search.search(documents(spark, docs, clash=True).repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumn("score", search.F.lit(1)), **more)
    return sorted(map(tuple, found.collect()), key=str)


def corpus(seed, n):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda most: " ".join(draw.choices(words, weights, k=draw.randint(1, most)))
    docs = [(i, text(80)) for i in range(n)]
    return docs + docs[:5] + [(n + 1, docs[0][1]), (n + 2, docs[0][1])], [(i, text(12)) for i in range(12)]


@pytest.mark.parametrize(("seed", "shard", "block"), [(1, 10**6, 10**6), (2, 200, 10**6), (3, 500, 10)])
def test_against_scoring_all(spark, seed, shard, block, monkeypatch):
    docs, items = corpus(seed, 250)
    monkeypatch.setattr("millrace.llm.common.ROWS_PER_BATCH", 20)
    assert run(spark, docs, items, shard_postings=shard, block_terms=block) == plain(docs, items)


def test_awkward_rows(spark):
    docs = [*AWKWARD, (8, "a b c"), (9, "a b c"), (10, "!!! ---"), (11, "dup"), (12, "C D")]
    items = [(1, "a b"), (1, "dup DUP"), (2, None), (3, ""), (4, "nowhere"), (None, "c d"), (5, "word é"), (5, "word é"), (6, "x" * 50_000), (7, "a " * 3000)]
    assert run(spark, docs, items) == plain(docs, items)
    assert run(spark, docs, items, k=1) == plain(docs, items, 1)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == []


def test_only_documents_that_can_qualify_are_probed():
    """A common term's list is not read whole once the best so far are good."""
    n = 10_000
    terms = np.concatenate([np.zeros(n, np.int32), np.ones(5, np.int32)])
    order = np.argsort(np.concatenate([np.arange(n), np.arange(5)]), kind="stable")
    sizes = np.ones(n, np.int64)
    sizes[:5] = 2
    shard = search.Shard(list(range(n)), np.full(n, 10), sizes, terms[order], np.ones(n + 5, np.int32), np.array([10, 5000]), n, n * 10)
    low = shard.lists[0][2]
    docs, scores = shard.candidates([(0, 1), (1, 1)], low + 1)
    assert docs.tolist() == [0, 1, 2, 3, 4] and scores.tolist() == [low + shard.lists[1][2]] * 5
    assert len(shard.candidates([(0, 1), (1, 1)], 1)[0]) == n and len(shard.candidates([(0, 1)], low + 1)[0]) == 0
    assert len(shard.candidates([(0, 1)], low)[0]) == n  # as good as the least: the id decides


def test_lengths_beyond_64_bits():
    assert search.length_share(np.array([10**9]), 10**12, 10**15).tolist() == [25 + 75 * 10**6]
