import random
from collections import defaultdict

import numpy as np
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import substrings as ss


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def slow_boundaries(text):
    """The gear hash byte by byte; gaps that are too long are cut at the register's least values, again and again."""
    ends, h, last, register = [], 0, None, []
    for i, b in enumerate(text):
        h = ((h << 1) + int(ss.GEAR[b])) & 0xFFFF
        register.append(h)
        if i >= 15 and h >> (16 - ss.BITS) == 0:
            if last is None or i + 1 - last >= ss.SHORTEST:
                ends.append(i + 1)
            last = i + 1
    ends = sorted({e for e in ends if e < len(text)} | {len(text)})

    def cut(a, z):
        own = range(a + ss.SHORTEST, z - ss.SHORTEST + 1)
        least, cuts = min((register[x - 1] for x in own), default=None), [a]
        for x in own:
            if register[x - 1] == least and x - cuts[-1] >= ss.SHORTEST:
                cuts.append(x)
        cuts.append(z)
        return cuts[1:-1] + [x for p, q in zip(cuts, cuts[1:]) if len(cuts) > 2 and q - p > ss.LONGEST for x in cut(p, q)]

    ends += [x for a, z in zip([0, *ends], list(ends)) if z - a > ss.LONGEST for x in cut(a, z)]
    out = set()
    for e in ends:
        while e < len(text) and text[e] & 0xC0 == 0x80:
            e += 1
        out.add(e)
    return sorted(out)


def test_rolling_hash_against_a_loop():
    rng = random.Random(1)
    texts = [words(rng, n) for n in (1, 2, 10, 200)] + ["ab " * 700 + words(rng, 30) + "é" * 900 + "x" * 2000 + words(rng, 5), words(rng, 3) + "".join(words(rng, 4) * 40)]
    for text in texts:
        assert ss.boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == slow_boundaries(text.encode())


def test_long_chunks_are_cut_between_characters():
    text = "é".encode() * 5000
    ends = ss.boundaries(np.frombuffer(text, np.uint8)).tolist()
    assert max(np.diff([0, *ends])) <= ss.LONGEST + 3 and all(e % 2 == 0 for e in ends)


def plain(rows, min_words):
    """Spans by comparing every chunk with every place of it."""
    docs = {}
    for doc, text in set(rows):
        if text:
            b = text.encode()
            ends = ss.boundaries(np.frombuffer(b, np.uint8)).tolist()
            docs[doc, text] = [(i, j, b[i:j]) for i, j in zip([0, *ends], ends, strict=False)]
    where = defaultdict(list)
    for (doc, text), cs in docs.items():
        for i, _, c in cs:
            where[c].append(((doc is None, doc or 0), text, i))
    out = []
    for (doc, text), cs in docs.items():
        b, run = text.encode(), None
        me = (doc is None, doc or 0)
        for i, j, c in [*cs, (len(b), len(b), None)]:
            # Which of two texts under one doc_id is the first is a matter of their hashes: such a chunk may be first here or there.
            before = c is not None and any(d < me or (d == me and t == text and k < i) for d, t, k in where[c])
            if before:
                run = (run[0] if run else i, j)
            else:
                if run:
                    starts = sum(b[k : k + 1].strip() != b"" and (k == 0 or b[k - 1 : k].strip() == b"") for k in range(*run))
                    if starts >= min_words:
                        out.append((doc, *run, starts))
                run = None
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    passages = [words(rng, 60) for _ in range(6)]
    rows = [*AWKWARD]
    for k in range(100, 180):
        parts = [words(rng, rng.randint(5, 60)) for _ in range(2)]
        if k % 3 == 0:
            parts.insert(1, rng.choice(passages))
        if k % 10 == 0:
            parts += [parts[0], words(rng, 5), parts[0]]
        rows.append((k if k % 7 else -k, rng.choice([" ", "\n", ""]).join(parts)))
    rows += [(300, rows[-1][1]), (301, rows[-1][1]), (-5, "q " * 600), (None, words(rng, 40) + passages[0])]
    return rows


def test_against_plain_comparison(spark):
    rows = corpus()
    got = ss.spans(documents(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id, r.start, r.end, r.n_words) for r in got), key=str) == plain(rows, ss.MIN_WORDS)
    assert all(r.doc_id is None or r.first_doc_id <= r.doc_id and r.first_doc_id in r.first_doc_ids for r in got)
    assert {r.doc_id for r in got} >= {None, -5}


def test_two_texts_under_one_id(spark):
    rng = random.Random(6)
    shared, alone = words(rng, 90), "é" + words(rng, 120)
    rows = [(1, shared), (7, "ü " + shared), (7, alone), (7, alone), (8, "one letter " + "q w e r t " * 120), (9, "x " + "q w e r t " * 120)]
    left = ss.remove(documents(spark, rows, clash=True))
    assert left.columns == documents(spark, rows, clash=True).columns
    out = sorted((r.doc_id, r.text) for r in left.collect())
    assert [t for d, t in out if d == 1] == [shared] and [t for d, t in out if d == 7].count(alone) == 2
    assert min(len(t) for d, t in out if d == 7) < 60
    n = {r.doc_id: r.n_words for r in ss.spans(documents(spark, rows)).collect()}
    assert n[9] > 500


def test_repeats_inside_one_document(spark):
    text = words(random.Random(7), 80)
    found = ss.spans(documents(spark, [(3, f"{text} and {text}"), (4, words(random.Random(8), 90))])).collect()
    assert [(r.doc_id, r.first_doc_ids, r.n_words > 60, r.start > len(text) - 1) for r in found] == [(3, [3], True, True)]
    assert len(ss.remove(documents(spark, [(3, f"{text} and {text}")])).first().text) < len(text) + 130


def test_planted_passages_are_found_after_insertions(spark):
    rng = random.Random(9)
    passages = [words(rng, 55) for _ in range(40)]
    rows = [(i, words(rng, 20 + i) + " " + p) for i, p in enumerate(passages)] + [(1000 + i, words(rng, 7 * i) + "; " + p + " " + words(rng, 9)) for i, p in enumerate(passages)]
    rows += [(2000 + i, words(rng, 100)) for i in range(40)]
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in ss.spans(docs).collect()}
    assert set(found) == {1000 + i for i in range(40)} and all(found[1000 + i].first_doc_id == i for i in range(40))
    left = {r.doc_id: r for r in ss.remove(docs).collect()}
    assert len(left) == len(rows) and all(left[i].text == t for i, t in rows if i not in found)
    assert all(len(left[1000 + i].text) < len(rows[40 + i][1]) and left[1000 + i].n_chars == len(left[1000 + i].text) for i in range(40))


def test_null_ids_repeats_and_empty(spark):
    text = words(random.Random(2), 80)
    found = ss.spans(documents(spark, [(None, text), (5, text), (5, text), (6, "x " + text), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.first_doc_id) for r in found) == [(0, 5), (6, 5)]
    assert ss.spans(documents(spark, [])).count() == 0
    assert ss.remove(documents(spark, [(1, None)])).collect()[0].text is None
