import random
import re

import pytest
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import neardup
from millrace.llm.components import components
from millrace.llm.queries import op2_neardup


def sets_of(rows, n):
    out = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def plain(rows, n=4):
    """(doc_id, set size, smallest doc_id reachable) by comparing all pairs."""
    sets, top = sets_of(rows, n), list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            ids[find(i)] = min(ids.get(find(i), doc), doc)
    return sorted(((doc, len(s), ids.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def changed(rng, words, share):
    return [rng.choice("pqrstuv") * 3 + str(rng.random()) if rng.random() < share else w for w in words]


def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, k = list(AWKWARD), 100
    for size in (2, 3, 8, 120):
        base = [word() for _ in range(rng.randint(60, 150))]
        for _ in range(size):
            rows.append((k, " ".join(changed(rng, base, rng.choice([0, 0.01, 0.03, 0.05])))))
            k += 1
    for _ in range(60):  # a chain: neighbours are linked, the ends are not
        base = [word() for _ in range(80)] if k % 20 == 0 else base[2:] + [word(), word()]
        rows.append((k, " ".join(base).upper()))
        k += 1
    shared = " ".join(word() for _ in range(12))
    rows += [(k + i, shared + " " + " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(spark, tmp_path):
    rows = corpus()
    documents(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_neardup(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("hubs", [1, 2])
def test_few_hubs_lose_no_link(spark, hubs, monkeypatch):
    monkeypatch.setattr(neardup, "HUBS", hubs)
    rng = random.Random(hubs)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(changed(rng, base, 0.04))) for i in range(90)]
    got = neardup.groups(neardup.numbered(documents(spark, rows)), 4).collect()
    assert sorted(((r.doc_id, r.n, r.component) for r in got), key=str) == plain(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = documents(spark, rows, clash=True)
    out = neardup.deduplicate(docs, 5)
    assert out.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    want = plain(rows, 5)
    assert len(left) == len(set(left)) and set(left) <= set(rows)
    named = [r for r in want if r[1] and r[2] is not None]
    empty = {r for r, s in zip(rows, sets_of(rows, 5), strict=True) if not s}
    nulls = {t for d, t in rows if d is None and t}
    assert len(left) == len({r[2] for r in named}) + len(empty) + len(nulls)


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)} | {200 + i: 200 for i in range(7)}


def test_empty(spark):
    assert neardup.groups(neardup.numbered(documents(spark, []))).count() == 0
    assert neardup.deduplicate(documents(spark, [])).count() == 0
