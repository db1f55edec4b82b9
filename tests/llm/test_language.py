import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import language as lg

SYLLABLES = {"en": "th er on an re he in ed nd ha", "de": "ung ver sch ein lich heit ich ge ü ß", "fr": "eau tion qu oi é è ou ment aux le"}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(60)), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy(spark):
    rows = corpus(400, 1) + [(1000 + k, t, "en") for k, (_, t) in enumerate(AWKWARD)] + [(2000, "1234 !!", "en"), (2001, "some text", None)]
    docs = documents(spark, rows, clash=True)
    filters = lg.learn(docs, F.col("doc_id") % 4 != 2)
    out = {r.doc_id: r for r in lg.identify(docs, filters).collect()}
    assert all(out[i].lang_pred == lang for i, _, lang in rows[:400] if i % 4 == 2)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[1000].lang_pred == out[1001].lang_pred == out[2000].lang_pred == "und" and out[2000].score == 0
    assert len(out) == len(rows)


def plain_words(text):
    """Runs of letters and marks of the lower-cased text, one space around each."""
    s = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    return f" {re.sub(' +', ' ', s).strip()} ".replace("  ", " ") if any(c.isalpha() for c in s) else ""


def plain_grams(text):
    s = plain_words(text)
    return [s[i : i + n] for n in (2, 3, 4) for i in range(len(s) - n + 1)]


def test_against_plain_sets(spark):
    """Sets of n-grams instead of filters; each document's hits counted one by one."""
    rows = corpus(300, 5) + [(1000 + k, t, "en") for k, (_, t) in enumerate(AWKWARD)] + [(2000, "e\u0301te\u0301 naïve x²", "fr"), (2001, "नमस्ते दुनिया", None), (2002, "a" * 400_000, None), (2003, "th er", None)]
    docs = documents(spark, rows, clash=True)
    least = 1e-3
    filters = lg.learn(docs, F.col("doc_id") % 4 != 2, least)
    count = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and i % 4 != 2:
            count.setdefault(lang, Counter()).update(plain_grams(t))
    total = {x: sum(c.values()) for x, c in count.items()}
    sets = {x: {g for g, n in c.items() if n >= least * total[x]} for x, c in count.items()}
    assert filters.languages == sorted(total, key=lambda x: (-total[x], x))
    out = {r.doc_id: r for r in lg.identify(docs, filters).collect()}
    for i, t, _ in rows:
        g = plain_grams(t)
        if not g:
            assert (out[i].lang_pred, out[i].score, out[i].cover) == ("und", 0.0, 0.0)
            continue
        hits = {x: sum(y in sets[x] for y in g) for x in filters.languages}
        best = max(hits.values())
        told = sum(any(y in s for s in sets.values()) for y in g)
        assert hits[out[i].lang_pred] >= best - 0.01 * len(g) - 1
        if told > 50:
            assert abs(out[i].score - best / told) < 0.02
            held = sum(count[out[i].lang_pred][y] for y in sets[out[i].lang_pred]) / total[out[i].lang_pred]
            assert abs(out[i].cover - best / len(g) / held) < 0.02


def test_letters_by_category():
    for text in ("² ½ ①", "12 — !?", "\u0301", "_", "\U0001f600"):
        assert not len(lg.codes(text.encode())), text
    for text in ("नमस्ते", "ª", "x²", "ǅ", "漢"):
        assert len(lg.codes(text.encode())), text
    assert len(lg.codes("नमस्ते".encode())) == len("नमस्ते") + 2


def test_what_a_language_holds_does_not_hang_on_how_many_there_are(spark, monkeypatch):
    """The same documents are predicted alike whether three or a hundred other languages are learned beside; filters are filled a few languages at a time."""
    rows = [(i, t, lang) for i, t, lang in corpus(160, 7) if lang]
    alone = lg.learn(documents(spark, rows))
    rng = np.random.default_rng(3)
    word = lambda k: "".join(chr(0x4E00 + 97 * k + int(x)) for x in rng.integers(0, 90, 5))
    others = [(1000 + k, " ".join(word(k) for _ in range(40)), f"x{k}") for k in range(100)]
    monkeypatch.setattr(lg, "WORD", 16)
    many = lg.learn(documents(spark, rows + others))
    assert len(many.languages) == 100 + len(alone.languages) and many.cells.shape[1] == -(-len(many.languages) // 16)
    told = [(lang, alone.measure(t.encode())[0], many.measure(t.encode())[0]) for _, t, lang in rows]
    assert sum(a == b for _, a, b in told) >= 0.99 * len(told)
    assert np.mean([many.measure(t.encode())[0] == lang for _, t, lang in others]) == 1.0
    monkeypatch.setattr(lg, "MOST_LANGUAGES", 50)
    with pytest.raises(ValueError, match="at most 50"):
        lg.learn(documents(spark, others))


def test_filters_hold_every_learned_gram():
    rng = np.random.default_rng(1)
    sets = {f"l{k}": rng.integers(0, 2**63, 500).astype(np.uint64) for k in range(70)}
    f = lg.Filters.of(sets)
    assert f.cells.shape[1] == 2
    for k, s in enumerate(sets.values()):
        hits, told = f.hits(s)
        assert np.argmax(hits) == k and told == 500 and hits[k] >= 500 * (1 - 1e-9)
    assert f.hits(rng.integers(0, 2**63, 20000).astype(np.uint64))[0].max() < 400


def test_rejects_only_what_is_unknown(spark):
    docs = documents(spark, corpus(200, 2))
    filters = lg.learn(docs)
    mixed = documents(spark, corpus(50, 3) + [(900, None), (901, "12 34"), (902, "Съешь же ещё этих мягких французских булок"), (903, "½ ²"), (904, "sdkfj wzxcv qmnbp " * 9)], clash=True)
    out = lg.reject_unknown(mixed, filters)
    assert out.columns == mixed.columns and {r.doc_id for r in out.collect()} == set(range(50))


def test_empty(spark):
    none = documents(spark, [])
    f = lg.learn(none)
    assert lg.identify(none, f).count() == 0
    assert [tuple(r) for r in lg.identify(documents(spark, [(1, "abc")]), f).collect()] == [(1, "und", 0.0, 0.0)]
