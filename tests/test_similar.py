"""Names that are nearly alike, against a comparison of all pairs."""

import random
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from millrace.operators import resolve, similar


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def varied(rng, name, letters):
    """name with one to three characters put in, taken out or changed."""
    out = list(name)
    for _ in range(rng.randint(1, 3)):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.4:
            out.insert(at, rng.choice(letters))
        elif out[at : at + 1]:
            out[at : at + 1] = [] if rng.random() < 0.5 and len(out) > 1 else [rng.choice(letters)]
    return "".join(out)


def tables(spark, seed, letters, sizes, n=150):
    rng = random.Random(seed)
    keys = ["".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(n)]
    forms = [varied(rng, rng.choice(keys), letters) for _ in range(n // 2)] + keys[:5]
    return forms, keys


@pytest.mark.parametrize(("letters", "sizes"), [("ab01", (1, 9)), ("abcdefghij0123456789", (1, 12)), ("abcde0123", (15, 40)), ("a0", (1, 30))])
def test_no_pair_is_lost(spark, letters, sizes):
    forms, keys = tables(spark, 5, letters, sizes)
    f, k = (spark.createDataFrame([(x,) for x in sorted(set(rows))], f"{name} string") for name, rows in (("form", forms), ("key", keys)))
    for least in (0.75, 0.9):
        want = {(a, b): ratio(a, b) for a in forms for b in keys if ratio(a, b) >= least}
        got = similar.compare(similar.candidates(f, k, least), least).collect()
        assert len(got) == len(want) and {(r.form, r.key): r.score for r in got} == want


def test_few_pairs_meet(spark):
    rng = random.Random(6)
    letters = similar.ALPHABET
    keys = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(8, 16))) for _ in range(2000)})
    forms = sorted({varied(rng, rng.choice(keys), letters) for _ in range(400)})
    f, k = spark.createDataFrame([(x,) for x in forms], "form string"), spark.createDataFrame([(x,) for x in keys], "key string")
    met = [similar.candidates(f, k, least).count() / (len(forms) * len(keys)) for least in (0.75, 0.9)]
    print("share of pairs that meet:", met)
    assert met[0] < 0.1 and met[1] < 0.01


def test_nearest_against_all_pairs(spark):
    rng = random.Random(7)
    forms, keys = tables(spark, 8, "abc012", (3, 12), 120)
    # One key that very many entities have, entities with several keys, ties.
    names = [(f"e{i:03d}", keys[i % len(keys)]) for i in range(300)] + [(f"h{i:03d}", keys[0]) for i in range(200)] + [("n", None), ("z", "")]
    wanted = [(f"q{i % 40}", f) for i, f in enumerate([*forms, keys[0]])] + [("none", None), ("blank", "")]
    rng.shuffle(names)
    got = {}
    for r in similar.nearest(spark.createDataFrame(wanted, "query string, form string"), spark.createDataFrame(names, "entity_id string, key string"), 5, 0.75).orderBy("query", "nth").collect():
        got.setdefault(r["query"], []).append((r.entity_id, r.score))
    for q in {q for q, _ in wanted}:
        best = {}
        for e, k in names:
            score = max((ratio(f, k) for x, f in wanted if x == q and f and k), default=0)
            if score >= 0.75:
                best[e] = max(best.get(e, 0), score)
        assert got.get(q, []) == [(e, round(s, 3)) for e, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]], q


def test_suggestions_by_join_are_those_of_the_scan(spark):
    forms, keys = tables(spark, 9, "ab12", (2, 8), 60)
    known = spark.createDataFrame([(f"e{i % 50}", "tag", k.upper()) for i, k in enumerate(keys)], "entity_id string, field string, value string")
    q = spark.createDataFrame([(f"pump {f}",) for f in forms], "query string")
    scan, join = (sorted(map(tuple, resolve.suggestions(q, known, join=by).collect())) for by in (False, True))
    assert scan and join == scan


def test_empty(spark):
    none, some = spark.createDataFrame([], "query string, form string"), spark.createDataFrame([("q", "abc")], "query string, form string")
    names = spark.createDataFrame([("e", "abc")], "entity_id string, key string")
    assert similar.nearest(none, names, 5, 0.75).count() == 0
    assert similar.nearest(some, names.where("1 = 0"), 5, 0.75).count() == 0


def test_a_name_is_compared_once_however_many_have_it_and_few_in_full(spark, monkeypatch):
    """All names alike: the common subsequence leaves few pairs, and ties go to the smallest entities."""
    from difflib import SequenceMatcher

    names = [f"customer{k:06d}" for k in range(0, 40000, 13)] + ["customer" + "9" * 90]
    queries = [(f"Custmer#{k:06d}", [f"custmer{k:06d}"]) for k in (7, 1300, 39999)] + [("long", ["custmer" + "9" * 89])]
    calls, ratio = [], SequenceMatcher.ratio
    monkeypatch.setattr(SequenceMatcher, "ratio", lambda self: calls.append(1) or ratio(self))
    batch = pa.RecordBatch.from_pydict({"key": names, "entities": [[f"c{k}", f"d{k}"] for k in range(len(names))]})
    got = [r for out in resolve._nearest([batch], queries, 5) for r in out.to_pylist()]
    assert len(calls) < 100 * len(queries)
    monkeypatch.undo()
    for query, (form,) in queries:
        every = sorted((-s, e) for k, n in enumerate(names) if (s := SequenceMatcher(None, form, n).ratio()) >= 0.75 for e in (f"c{k}", f"d{k}"))[:5]
        assert [(-r["score"], r["entity_id"]) for r in got if r["query"] == query] == every
