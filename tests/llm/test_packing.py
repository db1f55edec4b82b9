import random
from collections import defaultdict

import numpy as np
from tests.llm.helpers import AWKWARD, documents

from millrace.llm import packing
from millrace.llm.queries import tokenizer_json


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda k: rooms[k])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_the_tree_places_as_a_plain_search_does():
    rng = random.Random(1)
    for capacity in (1, 2, 7, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(300)]
        window, offset, n = packing.best_fit_decreasing(lengths, capacity)
        used = defaultdict(list)
        for w, o, k in zip(window, offset, lengths, strict=True):
            used[w].append((o, k))
        for spans in used.values():
            at = 0
            for o, k in sorted(spans):
                assert o == at
                at += k
            assert at <= capacity
        assert n == len(used) and sorted(capacity - sum(k for _, k in s) for s in used.values()) == plain_best_fit(lengths, capacity)


def whole(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer_json())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for _, x in rows]


def test_pieces_hold_each_id_once(spark):
    rows = AWKWARD + [(100 + i, " ".join(f"Wörd{i % 7}'s x{j}" for j in range(i * 9))) for i in range(60)] + [(300, "It's <|endoftext|> 12,5 é   \x1cz")]
    out = packing.pack(documents(spark, rows, clash=True), tokenizer_json()).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
        assert len(r.ids) == 4 * r.length
    want = defaultdict(list)
    for (doc, _), ids in zip(rows, whole(rows), strict=True):
        want[doc].append(ids)
    for doc, texts in want.items():
        if len(texts) == 1:
            at, got = 0, []
            for r in sorted(by[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0])
                at += r.length
                got += np.frombuffer(r.ids, "<u4").tolist()
            assert got == texts[0]
        else:
            assert sum(r.length for r in by[doc]) == sum(map(len, texts))
    for rs in seqs.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_sequences_are_padded(spark):
    pieces = packing.pack(documents(spark, AWKWARD), tokenizer_json())
    for r in packing.sequences(pieces, pad_id=5).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 2048 and (ids[r.n_tokens :] == 5).all() and sum(d.length for d in r.documents) == r.n_tokens


def test_empty_table(spark):
    assert packing.pack(documents(spark, []), tokenizer_json()).count() == 0


def test_words_encode_as_the_whole_text_does():
    import random

    from tokenizers import Tokenizer

    t, mine, rng = Tokenizer.from_str(tokenizer_json()), packing.Tokens(tokenizer_json()), random.Random(3)
    assert mine.words is not None
    alphabet = list("abzABZ09''.,-_!<|>éÉñßİıǅſ ́̈ΣσςÅK一ب\U0001f600 ­") + [" ", "\t", "\x1c", "\x85", " ", "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for _ in range(3000):
        x = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(mine.of(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_other_vocabularies_encode_whole_texts():
    from millrace.llm.queries import tokenizer_path

    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        t = packing.Tokens(f.read())
    assert t.words is None
    x = "Two  spaces, and\nlines."
    assert np.frombuffer(t.of(x.encode()), "<u4").tolist() == t.tokenizer.encode(x).ids
