import hashlib
import random
import re

import pytest
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import decontamination as dc
from millrace.llm.queries import op7_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = WORD.findall(lower(text))
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if (x := windows.get(tuple(w[i : i + size]))) is not None:
                    hit |= set(range(i, i + size))
                    found |= x
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables(spark):
    rng = random.Random(5)
    words = ["the", "of", "And", "é", "ñu", "x1", "42", "zü"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)]
    items = [(i, t) for i, t in items if len(t.split()) != 1] + [(31, None), (None, "null item here it is"), (32, "uniqueword"), (33, "uniqueword")]
    docs = list(AWKWARD)
    for i in range(200):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))]
        for _ in range(rng.randint(0, 2)):
            parts.append((rng.choice(items)[1] or "").upper().replace(" ", rng.choice([" ", ", ", "\n", "--"])))
        docs.append((100 + i, " ".join(parts)))
    return docs, items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [dc.BLOCK_WINDOWS, 60])
def test_against_plain_search(spark, tmp_path, block, monkeypatch):
    docs, items, bench = tables(spark)
    documents(spark, docs, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(dc.hits, "__defaults__", (dc.WINDOW, block, None))
    got = op7_decontamination(spark, str(tmp_path))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str) == plain(docs, items)


def test_clean_removes_spans_only(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = [(1, "Start, ONE two three four five six seven eight nine ten eleven. End"), (2, "one two three four five six seven eight nine"), (3, None), (4, "one two three four five six seven eight nine ten")]
    out = {r.doc_id: r for r in dc.clean(documents(spark, docs, clash=True), bench).collect()}
    assert out[1].text == "Start, . End" and out[1].n_chars == len("Start, . End")
    assert out[2].text == docs[1][1] and out[3].text is None and 4 not in out
    assert {r.doc_id for r in dc.clean(documents(spark, docs), bench, drop_documents=True).collect()} == {2, 3}


def test_clean_in_blocks(spark):
    _, items, bench = tables(spark)
    docs, _, _ = tables(spark)
    own = documents(spark, docs, clash=True)
    # Where a cut brings words together the order of the blocks decides which go first; what is left holds no window.
    for out in (dc.clean(own, bench), dc.clean(own, bench, block_windows=60)):
        assert out.columns == own.columns and dc.hits(out, bench).where("size(hit_words) > 0").count() == 0
        untouched = dc.hits(own, bench).where("size(hit_words) = 0").count()
        assert out.join(own, [out["doc_id"].eqNullSafe(own["doc_id"]), out["text"].eqNullSafe(own["text"])], "left_semi").count() >= untouched


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.hits(documents(spark, []), bench).count() == 0
    assert [r.n_words for r in dc.hits(documents(spark, [(1, "a b")]), bench).collect()] == [2]
