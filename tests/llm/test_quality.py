import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import quality as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_statistics_against_plain_counts(spark):
    rng = random.Random(2)
    rows = AWKWARD + [(100 + i, "".join(rng.choice(["a", "b", "é", " ", " ", "\n", "#", "a b c\n", "|<"]) for _ in range(rng.randint(0, 200)))) for i in range(200)]
    got = q.statistics(documents(spark, rows, clash=True)).collect()
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((d, *plain(t)) for d, t in rows), key=key)


def test_forest_and_threshold_on_held_out_rows(spark):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(5000)]
    rows, labels, bad = [], [], set()
    for i in range(600):
        words = [rng.choice(names) for _ in range(80)]
        if i % 8 == 0:
            words, bad = [w + "%%%" for w in words], bad | {i}
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(i % 8 != 0), 0))
    rows.append((1000, "short"))
    table = spark.createDataFrame(labels + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in q.judge(documents(spark, rows), table).collect()}
    assert out[1000].base_failed and not out[1000].kept
    held = [i for i in range(400, 600)]
    assert all(out[i].kept == (i not in bad) for i in held)


def walk(forest, tree, row):
    """A row's path through one tree, branch by branch; what is left at the leaf counts as the mean path among so many rows."""
    k, steps = 1, 0
    while forest.column[tree, k] >= 0:
        k = 2 * k + int(row[forest.column[tree, k]] > forest.cut[tree, k])
        steps += 1
    return forest.path[tree, k], steps


def test_path_lengths_against_single_walks():
    rng = np.random.default_rng(3)
    rows = np.vstack([rng.normal(size=(500, 10)), rng.normal(6, 3, (5, 10))])
    rows[:, 4] = 0
    forest = q.IsolationForest(rows, trees=20, subsample=64)
    paths = np.array([[walk(forest, t, r)[0] for t in range(20)] for r in rows])
    steps = np.array([[walk(forest, t, r)[1] for t in range(20)] for r in rows])
    assert (paths >= steps).all() and (steps <= forest.depth).all()
    n = np.arange(2, 65)
    usual = 2 * (np.log(63) + 0.5772156649) - 2 * 63 / 64
    assert np.allclose(forest.scores(rows), 2 ** (-paths.mean(1) / usual))
    assert forest.scores(rows)[-5:].min() > np.quantile(forest.scores(rows)[:500], 0.99)
    # Leaves count every row of the sample once: growing a tree again by the same draws gives leaf sizes that sum to it.
    sizes = {round(float(q._expected(k)), 9): int(k) for k in n} | {0.0: 1}
    for t in range(20):
        leaves, todo = [], [(1, 0)]
        while todo:
            k, d = todo.pop()
            if forest.column[t, k] < 0:
                leaves.append(sizes[round(float(forest.path[t, k]) - d, 9)])
            else:
                todo += [(2 * k, d + 1), (2 * k + 1, d + 1)]
        assert sum(leaves) == 64


def test_all_statistics_reach_the_forest(spark):
    """Documents that are odd in one statistic alone, labelled in part, are told apart on held-out rows."""
    rng = random.Random(6)
    names = [f"word{i}" for i in range(3000)]
    make = {
        "digits": lambda w: [x[:2] + "12345678" for x in w], "upper": lambda w: [x.upper() for x in w], "long": lambda w: [x * 9 for x in w],
        "lines": lambda w: [x + "\n" for x in w], "repeats": lambda w: w[:60] + w[:22] + w[60:78],
    }
    for kind, change in make.items():
        rows, labels = [], []
        for i in range(400):
            words = [rng.choice(names) for _ in range(100)]
            rows.append((i, " ".join(change(words) if i % 10 == 0 else words)))
            if i < 250:
                labels.append((i, int(i % 10 != 0), 0))
        out = {r.doc_id: r.kept for r in q.judge(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
        caught = sum(not out[i] for i in range(250, 400) if i % 10 == 0) / 15
        kept = sum(out[i] for i in range(250, 400) if i % 10) / 135
        assert caught >= 0.8 and kept >= 0.95, (kind, caught, kept)


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, " ".join(f"w{i}" for i in range(60))), (2, None)]
    out = {r.doc_id: r.kept for r in q.judge(documents(spark, rows), none).collect()}
    assert out == {1: True, 2: False}
    assert q.judge(documents(spark, []), none).count() == 0


def test_calibration_keeps_the_good():
    s, good = np.array([0.1, 0.2, 0.3, 0.9, 0.95]), np.array([True, True, True, False, False])
    assert q.calibrated(s, good) == 0.3
    assert q.calibrated(s, ~good, 0.99) == np.inf


def test_every_labelled_document_is_learned_from(spark):
    """Each labelled row grows a tree, whatever the share of bad ones, and a tree never gets a row twice."""
    rng = np.random.default_rng(8)
    rows = [(int(k), *map(int, rng.integers(60, 900, len(q.COUNTS)))) for k in rng.integers(0, 2**60, 3000)]
    docs = [(h, *c, int(i % 3 > 0)) for i, (h, *c) in enumerate(rows)]
    table = spark.createDataFrame(docs, "h long, " + ", ".join(f"{c} long" for c in q.COUNTS) + ", quality int")
    x = q.features({c: np.array([r[1 + k] for r in docs]) for k, c in enumerate(q.COUNTS)})
    scale = q.Scale([np.unique(x[:, k], return_counts=True) for k in range(x.shape[1])])
    bad, good = q.copies_of(2000, 1000, 20, 64)
    assert (bad, good) == (1, 17)
    forest = q._forest(table, scale, (bad, good), 20, 64)
    assert len(forest.column) == 20
    assert forest.sizes.sum() == 1000 * bad + 2000 * good and forest.sizes.max() <= 3000


def test_no_label_is_left_out_beyond_the_former_limit(spark):
    """22,000 labelled documents: the threshold and the counts are those of all of them."""
    n = 22_000
    good = " ".join(f"w{i}" for i in range(60))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(good), F.repeat(F.lit(" %%%"), F.when(F.col("id") % 11 == 0, 30).otherwise((F.col("id") % 5).cast("int")))).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 11 != 0).cast("int").alias("quality"))
    counted = []
    whole = q._counted
    try:
        q._counted = lambda rows, one: counted.append(whole(rows, one)) or counted[-1]
        out = q.judge(docs, labels, trees=20).groupBy((F.col("doc_id") % 11 == 0).alias("bad"), "kept").count().collect()
    finally:
        q._counted = whole
    assert [int(c[c["at"].isin((-1,) if k == 0 else (0, 1))]["n"].sum()) for k, c in enumerate(counted)] == [n, n]
    assert {(r.bad, r.kept, r["count"]) for r in out} == {(True, False, 2000), (False, True, 20000)}


def test_quartiles_and_cuts_from_counts():
    rng = np.random.default_rng(9)
    x = np.exp(rng.normal(size=5000))
    values, n = np.unique(q.stepped(x), return_counts=True)
    scale = q.Scale([(values, n)])
    low, middle, high = np.quantile(x, (0.25, 0.5, 0.75))
    assert abs(scale.middle[0] / middle - 1) < 2e-3 and abs(scale.spread[0] / (high - low) - 1) < 5e-3
    assert len(values) < 2048 * 12
