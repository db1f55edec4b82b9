import random
import re

import pytest
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import licenses as lc


def words(text):
    return re.findall(r"[a-z0-9]+", (text or "").lower())


def grams(w):
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def plain(rows, templates, contained=80):
    """Every place of twice a template's length, wherever it begins, one by one."""
    out = set()
    for doc, text in rows:
        g = grams(words(text))
        for k, (name, t) in enumerate(templates):
            want = set(grams(words(t)))
            n, best = len(want), 0
            for i in [i for i, x in enumerate(g) if x in want]:
                best = max(best, len(want & set(g[i : i + 2 * n])))
            if 100 * best >= contained * n:
                out.add((doc, name, k, round(best / n, 6)))
    return out


def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    rows = [r for r in AWKWARD if r[0] != 7]
    for i in range(200):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            t = rng.choice(lc.NOTICES)[1].split()
            if rng.random() < 0.5:
                t[rng.randrange(len(t))] = word()
            parts += [" ".join(t).upper() if rng.random() < 0.2 else " \n".join(t), " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((100 + i, " ".join(parts)))
    # Words put into the middle, at every offset.
    for k in range(60):
        name, notice = rng.choice([x for x in lc.NOTICES if len(x[1].split()) > 20])
        t = notice.split()
        at = rng.randrange(3, len(t) - 3)
        t[at:at] = [word() for _ in range(rng.choice([1, 4, 10, 15, 60]))]
        rows.append((1000 + k, " ".join([word() for _ in range(k)] + t)))
    rows += [(2000 + k, t) for k, (_, t) in enumerate(lc.NOTICES)]
    return rows


@pytest.mark.parametrize("block", [lc.BLOCK, 700])
def test_against_plain_search(spark, block, monkeypatch):
    monkeypatch.setattr(lc, "BLOCK", block)
    rows = corpus()
    got = lc.scan(documents(spark, rows, clash=True)).collect()
    assert {(r.doc_id, r.license, r.template, round(r.containment, 6)) for r in got} == plain(rows, lc.NOTICES)
    text = dict(rows)
    for r in got:
        w = words(text[r.doc_id])[r.start_word : r.end_word]
        want = set(grams(words(lc.NOTICES[r.template][1])))
        assert len(want & set(grams(w))) / len(want) >= 0.8


def test_no_match_in_clean_text_and_empty(spark):
    assert lc.scan(documents(spark, [(1, "licensed under the other terms of a shop"), (2, None)])).count() == 0
    assert lc.scan(documents(spark, [])).count() == 0


def test_every_notice_is_found_as_itself(spark):
    found = {(r.doc_id, r.template): r.containment for r in lc.scan(documents(spark, [(k, t) for k, (_, t) in enumerate(lc.NOTICES)])).collect()}
    assert all(found[k, k] == 1.0 for k in range(len(lc.NOTICES)))


def test_a_catalogue_from_a_folder(spark, tmp_path):
    rng = random.Random(8)
    texts = {f"L{k}": " ".join(rng.choice("shall may license work copy terms grant of the to".split()) + str(rng.randrange(40)) for _ in range(900)) for k in range(6)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    templates = lc.read_templates(spark, str(tmp_path))
    assert templates == sorted(texts.items())
    rows = [(k, "before " + t + " after") for k, (_, t) in enumerate(templates)] + [(50, " ".join(templates[0][1].split()[:500]))]
    assert {(r.doc_id, r.license) for r in lc.scan(documents(spark, rows), templates).collect()} == {(k, f"L{k}") for k in range(6)}


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        lc.scan(documents(spark, []), [("x", "only four words here")])
