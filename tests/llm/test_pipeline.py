import random
import re

import numpy as np
from tests.llm.helpers import documents
from tests.llm.test_decontamination import WORD, lower
from tests.llm.test_language import SYLLABLES
from tests.llm.test_neardup import changed, plain as plain_groups
from tests.llm.test_secrets import plain as plain_secrets

import corpus_pipeline
from millrace.llm.queries import tokenizer_json


def plain_clean(text, items, n=10):
    """Cuts every run of words that lie in a benchmark window."""
    windows = {tuple(w[i : i + n]) for t in items for w in [WORD.findall(lower(t))] for i in range(len(w) - n + 1)}
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    words = [lower(text[a:b]) for a, b in spans]
    hit = set()
    for i in range(len(words) - n + 1):
        if tuple(words[i : i + n]) in windows:
            hit |= set(range(i, i + n))
    if not hit:
        return text
    if len(hit) == len(words):
        return None
    cut, out, at = sorted(hit), "", 0
    runs = [(a, b) for a, b in zip([i for i in cut if i - 1 not in hit], [i for i in cut if i + 1 not in hit], strict=True)]
    for a, b in runs:
        out += text[at : spans[a][0]]
        at = spans[b][1]
    return out + text[at:]


def plain_redact(text):
    out, at = "", 0
    for s, _, e in plain_secrets(text):
        if s >= at:
            out += text[at:s] + "[SECRET]"
        at = max(at, e)
    return out + text[at:]


def corpus():
    rng = random.Random(12)
    say = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    items = [say("en", 30) for _ in range(5)]
    rows = []
    for i in range(120):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, say(lang, rng.randint(60, 140)), lang))
    for i in range(120, 150):  # near and exact copies
        doc, text, lang = rng.choice(rows[:100])
        rows.append((i, " ".join(changed(rng, text.split(), rng.choice([0, 0.01]))), lang))
    for i in range(150, 160):
        rows.append((i, say("en", 40) + ". " + rng.choice(items) + ", " + say("en", 30), "en"))
    for i in range(160, 170):
        rows.append((i, say("en", 40) + f' token = "{rng.getrandbits(160):040x}" ' + say("en", 30), "en"))
    rows += [(170, None, "en"), (171, "1234 5678 !!", "en"), (172, "", None), (173, items[0], "en")]
    return rows, items


def test_against_stages_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus()
    rng = random.Random(13)
    say = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows += [(None, say("fr", 90), "fr"), (180, say("de", 9000), None), (181, "x" * 50_000, None), (None, None, None), (-3, say("en", 70), "en"), *rows[3:6], *rows[3:4]]
    documents(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    # What has no letter goes, and the one text in no language.
    left = [(d, t) for d, t, _ in rows if t and re.search(r"[^\W\d_]", t) and d != 181]
    left = [(d, t) for d, t in left if d in {c for _, _, c in plain_groups(left, 5)}]
    left = [(d, c) for d, t in left if (c := plain_clean(t, items)) is not None]
    t = Tokenizer.from_str(tokenizer_json())
    want = {d: t.encode(plain_redact(x), add_special_tokens=False).ids + [1] for d, x in left}
    assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in got.items()} == want


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    docs = documents(spark, rows[:40], clash=True)
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.select("doc_id", "n_chars", "text").where("n_chars <> length(text)").count() == 0, name


def test_without_languages_and_ids(spark, tmp_path):
    rows, items = corpus()
    docs = spark.createDataFrame([(None, t, None, None, None) for _, t, _ in rows[:30]] * 2, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(None, items[0]), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("start = 0").count() == 30


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
