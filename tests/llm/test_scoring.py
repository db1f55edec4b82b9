import math
import random
import re
import zlib
from collections import Counter
from functools import cache

import pytest
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import scoring
from millrace.llm.queries import op3_scoring, tokenizer_path


def plain_probability(lattice, word):
    """Sums over every segmentation, one by one."""
    s = scoring.MARK + word
    pieces = dict(zip(lattice.names, lattice.pieces, strict=True))

    @cache
    def rest(i):
        if i == len(s):
            return 1.0
        total = sum(math.exp(p) * rest(j) for j in range(i + 1, len(s) + 1) if (p := pieces.get(s[i:j])) is not None)
        if s[i] not in pieces:
            total += math.prod(math.exp(lattice.byte[b]) for b in s[i].encode()) * rest(i + 1)
        return total

    return rest(0)


LATTICE = scoring.Lattice.of_vocabulary([(p, math.log(w)) for p, w in {"▁": 0.1, "a": 0.2, "b": 0.1, "ab": 0.2, "▁a": 0.1, "▁ab": 0.05, "ba": 0.1}.items()])


def test_forward_sums_all_segmentations(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abé\U0001f600") for _ in range(rng.randint(0, 9))) for _ in range(200)]
    for cells in (1, scoring.CELLS):
        monkeypatch.setattr(scoring, "CELLS", cells)
        for w, p in zip(words, LATTICE.log_probabilities(words).tolist(), strict=True):
            assert math.isclose(math.exp(p), plain_probability(LATTICE, w), rel_tol=1e-9)


def test_a_whole_vocabulary_is_found():
    pieces = scoring.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    x = scoring.Lattice.of_vocabulary(pieces)
    import numpy as np

    hashes = np.array([x._hash(scoring._codes([n]))[-1, -1] for n in x.names], np.uint64)
    assert x._find(hashes).tolist() == list(range(len(x.names)))
    words = ["the", "qué", "xyzzy" * 9, ""]
    assert all(math.isclose(math.exp(p), plain_probability(x, w), rel_tol=1e-9) for p, w in zip(x.log_probabilities(words).tolist(), words, strict=True))


def test_expected_counts_against_a_difference_quotient():
    """The derivative of a word's log probability by a piece's is how often the piece is expected."""
    import numpy as np

    words, times = ["abab", "é", "ba", ""], np.array([3.0, 2.0, 5.0, 1.0])
    pieces, byte = LATTICE.expected(words, times)
    value = lambda x: float((x.log_probabilities(words) * times).sum())
    for k in range(len(pieces)):
        moved = LATTICE.pieces.copy()
        moved[k] += 1e-6
        other = scoring.Lattice(LATTICE.names, moved, LATTICE.byte, LATTICE.end)
        assert math.isclose((value(other) - value(LATTICE)) / 1e-6, pieces[k], abs_tol=1e-4)
    assert byte[list("é".encode())].tolist() == [2.0, 2.0] and byte.sum() == 4


def test_expectation_raises_the_likelihood(spark):
    words = {b"ab": 50, b"abab": 20, b"ba": 3, "é".encode(): 2}
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in words.items()] + [(None, 10)], "word binary, n long")
    like = lambda x: sum(n * p for n, p in zip(words.values(), x.log_probabilities([w.decode() for w in words]), strict=True)) + 10 * x.end
    one = scoring.fit(LATTICE, counts, 10, 75, 1)
    two = scoring.fit(LATTICE, counts, 10, 75, 2)
    assert like(LATTICE) < like(one) <= like(two) + 1e-6
    total = sum(map(math.exp, one.pieces)) + sum(map(math.exp, one.byte)) + math.exp(one.end)
    assert math.isclose(total, 1, rel_tol=1e-3)


def plain_base(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    end = object()
    train = Counter(w for d, t in rows if not held(d) for w in [*words(t), end])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in rows:
        toks = [*words(t), end]
        out.append((d, held(d), len(toks), sum(train[w] > 0 for w in toks), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks), 4)))
    return sorted(out, key=str)


@pytest.mark.parametrize("common", [3, scoring.COMMON])
def test_base_against_plain_counts(spark, tmp_path, monkeypatch, common):
    rng = random.Random(7)
    names = ["the", "The", "é", "x", "ABC", *(f"w{i}" for i in range(300))]
    rows = AWKWARD + [(100 + i, " ".join(rng.choice(names[: rng.choice([5, 300])]) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    documents(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(scoring.score, "__defaults__", (common, 1))
    got = op3_scoring(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == plain_base(rows)
    assert all(r.score < 0 for r in got)


def test_held_out_text_is_less_surprising_after_fitting(spark):
    rng = random.Random(9)
    make = lambda: " ".join("".join(rng.choice(["tion", "er", "ou", "qu"]) for _ in range(3)) for _ in range(40))
    rows = [(i, make()) for i in range(80)]
    pieces = scoring.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    from pyspark.sql import functions as F

    score = lambda passes: sum(r.score for r in scoring.score(documents(spark, rows), pieces, F.col("doc_id") < 60, passes=passes).collect() if r.doc_id >= 60)
    assert score(2) > score(0)


def test_empty(spark):
    from pyspark.sql import functions as F

    assert scoring.score(documents(spark, []), [("▁", -1.0)], F.lit(True)).count() == 0
    none_learned = scoring.score(documents(spark, [(1, "a b")]), [("▁", -1.0), ("a", -2.0)], F.lit(False)).collect()
    assert none_learned[0].n_known == 0 and none_learned[0].train_tokens == 0 and none_learned[0].score < 0
