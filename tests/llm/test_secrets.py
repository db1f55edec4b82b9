import hashlib
import random
import re

from tests.llm.helpers import AWKWARD, documents

from millrace.llm import secrets
from millrace.llm.queries import op5_secrets

KEYED = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def plain(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in KEYED.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def corpus():
    rng = random.Random(3)
    parts = ["token=", "TOKEN = '", "secret: token: abcdefgh ", "api_key\"='Zz9", "apikey:", " passwd = ", "AKIA", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 9, "deadbeef" * 3, "ab12" * 7, "g", " ", "\n", "é\U0001f600", "x.y_z-1/2+3=", "Password", "secret", "the Word and other text ", "0123456789abcdef"]
    return [(100 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]


def test_base_spans_against_plain_search(spark, tmp_path):
    rows = AWKWARD + corpus() + [(900, "token = abcdef " * 1500), (901, "f" * 100_000)]
    documents(spark, rows, clash=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_secrets(spark, str(tmp_path)).collect()
    want = []
    for doc, text in rows:
        p = plain(text)
        n = [sum(r == k for _, r, _ in p) for k in range(3)]
        names = ",".join(f"{secrets.KINDS[r]}:{s}:{e}" for s, r, e in p)
        want.append((doc, *n, hashlib.sha256(names.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)
        base = [x for x in spans if x[0] != "markov"]
        assert hashlib.sha256(",".join(map(":".join, base)).encode()).hexdigest() == r.base_sha256
        assert all(int(b[2]) <= int(m[1]) or int(m[2]) <= int(b[1]) for m in spans if m[0] == "markov" for b in base)


WORDS = "alpha river configuration settings window network average thinking ordinary banana paper holder matching language".split()


def test_chains_tell_held_out_strings_apart(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, text(60)) for i in range(60)]
    chains = secrets.Chains.train(secrets.samples(documents(spark, docs)))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(letters) for _ in range(32)) for _ in range(50)]
    rows = [(k, f"{text(5)} {keys[k]}, {text(5)}") for k in range(50)]
    rows += [(1000 + k, f"{text(5)} {'_'.join(rng.sample(WORDS, 4))} {''.join(w.title() for w in rng.sample(WORDS, 4))} {'/'.join(rng.sample(WORDS, 4))}") for k in range(50)]
    out = {r.doc_id: r for r in secrets.scan(documents(spark, rows), chains).collect()}
    for k in range(50):
        at = rows[k][1].index(keys[k])
        assert [(s.start, s.end) for s in out[k].more] == [(at, at + 32)]
    assert not any(out[1000 + k].more for k in range(50))


def test_secrets_among_ordinary_words(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    chains = secrets.Chains.train(secrets.samples(documents(spark, [(i, text(60)) for i in range(60)])))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda n: "".join(rng.choice(letters) for _ in range(n))
    path = lambda n, mark="/": mark.join(rng.choice(WORDS) for _ in range(n))
    rows, keys = [], {}
    for k in range(60):
        a, b, mark = key(32), key(32), rng.choice("/_-")
        rows.append((k, [f"{path(12)}/{a}", f"{a}{mark}{path(12, mark)}", f"{path(8, mark)}{mark}{a}{mark}{path(12, mark)}{mark}{b}", f"é {'0123456789abcdef' * 2}/{a} x", f"{path(20)}.{key(16)} {a}"][k % 5]))
        keys[k] = [a, b] if k % 5 == 2 else [a]
    rows += [(1000 + k, f"{path(24, mark)} {mark.join([path(6, '_'), path(6, '-')])}") for k, mark in enumerate("/_-+=" * 8)]
    found = {r.doc_id: r.more for r in secrets.scan(documents(spark, rows), chains).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(documents(spark, rows), chains).collect()}
    for k, own in keys.items():
        assert all(x not in clean[k] and any(s.start <= rows[k][1].index(x) and rows[k][1].index(x) + 32 <= s.end for s in found[k]) for x in own), (rows[k], found[k])
        assert all(x.end <= y.start for x, y in zip(found[k], found[k][1:]))
        # Of the path at most the words beside a key go.
        assert len(clean[k]) + 34 * len(own) + 2 * 14 * len(own) + 40 >= len(rows[k][1])
    assert not any(found[1000 + k] for k in range(40))


def slow_chain_spans(text, chains):
    """The chains' spans, character by character."""
    ratio = lambda a, b: chains.table[(ord(a) - secrets.FIRST) * secrets.WIDTH + ord(b) - secrets.FIRST]
    alnum = lambda c: c.isascii() and c.isalnum()
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{12,}", text):
        # What is left of the run beside base spans.
        at, pieces = m.start(), []
        for s, _, e in [x for x in plain(text) if x[0] < m.end() and m.start() < x[2]]:
            if s > at:
                pieces.append((at, s))
            at = max(at, e)
        if m.end() > at:
            pieces.append((at, m.end()))
        best = lambda r: max(sum(r[i:j]) for i in range(len(r) + 1) for j in range(i, len(r) + 1))
        if best([ratio(a, b) for a, b in zip(m.group(), m.group()[1:])]) < min(chains.least, (secrets.WHOLE - 1) * chains.threshold) - 1e-9:
            continue
        for a, z in pieces:
            own = text[a:z]
            r = [ratio(x, y) for x, y in zip(own, own[1:])]
            if len(own) >= secrets.WHOLE and sum(r) / len(r) > chains.threshold:
                out.append((a, z))
                continue
            found, total, begin, top, peak = [], 0.0, 0, 0.0, 0
            for k, x in [*enumerate(r, 1), (None, None)]:
                over = k is None or total + x <= 0 or top - (total + x) > chains.least
                if over:
                    if top >= chains.least:
                        found.append((begin, peak + 1))
                    total, begin, top, peak = 0.0, k, 0.0, k
                else:
                    total += x
                    if total > top:
                        top, peak = total, k
            moved = []
            for b, e in found:
                before = len(re.search(r"[A-Za-z0-9]*$", own[:b]).group())
                head, tail = len(re.match(r"[A-Za-z0-9]*", own[b:e]).group()), len(re.search(r"[A-Za-z0-9]*$", own[b:e]).group())
                after, padded = len(re.match(r"[A-Za-z0-9]*", own[e:]).group()), len(re.match(r"[A-Za-z0-9]*=*", own[e:]).group())
                moved.append((b - before if head >= before or head == e - b else b + head, e + padded if tail >= after or tail == e - b else e - tail))
            joined = []
            for b, e in sorted(moved):
                if joined and joined[-1][1] > b:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], e))
                else:
                    joined.append((b, e))
            out += [(a + b, a + e) for b, e in joined]
    return sorted(out)


def test_chain_spans_against_a_plain_model(spark):
    rng = random.Random(21)
    chains = secrets.Chains.train(secrets.samples(documents(spark, [(i, " ".join(rng.choice(WORDS) for _ in range(60))) for i in range(60)])))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    part = lambda: rng.choice([rng.choice(WORDS), "".join(rng.choice(letters) for _ in range(rng.randint(4, 30))), "0123456789abcdef" * 2, "token=Zz9Zz9x", "A" * 5, "=="])
    rows = [(i, "é " + " ".join(rng.choice(["/", "_", "-", "+", ".", "", " "]).join(part() for _ in range(rng.randint(1, 5))) for _ in range(4))) for i in range(250)]
    got = {r.doc_id: sorted((s.start, s.end) for s in r.more) for r in secrets.scan(documents(spark, rows), chains).collect()}
    want = {i: slow_chain_spans(t, chains) for i, t in rows}
    assert got == want and sum(map(len, want.values())) > 100


def test_ordinary_samples_hold_no_secret(spark):
    rng = random.Random(2)
    key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(40))
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(30)) + f" password = Hunter{i}abc " + (key if i == 3 else "")) for i in range(40)]
    strings = {r.string for r in secrets.samples(documents(spark, rows)).where("not random").collect()}
    assert strings and not any(key in x or "Hunter" in x or "password" in x for x in strings)


def test_redaction(spark):
    rows = [(1, "a token = deadbeefdeadbeefdeadbeef! é b password:hunter22"), (2, "clean"), (3, None), (4, "")]
    docs = documents(spark, rows, clash=True)
    out = {r.doc_id: r for r in secrets.redact(docs, secrets.Chains([0.0] * secrets.WIDTH**2, 1.0)).collect()}
    assert out[1].text == "a [SECRET]! é b [SECRET]" and out[1].n_chars == len(out[1].text)
    assert [out[k].text for k in (2, 3, 4)] == ["clean", None, ""]
    assert secrets.redact(docs, None).columns == docs.columns


def test_empty(spark):
    assert secrets.scan(documents(spark, [])).count() == 0


def test_redaction_of_many_spans_is_linear(spark):
    """400,000 spans in one text, and texts whose spans overlap, touch, begin and end the text and stand far apart."""
    import time

    many = "token = abcdef " * 400_000
    rows = [(1, many), (2, "password=" + "a" * 24 + ".bbbb"), (3, "x " + "é\U0001f600" * 2000 + "token=" + "0123456789abcdef" * 3 + " y"), (4, "secret: " + "AKIA" + "A" * 30), (5, "token=abcdef" + " z" * 3000 + " token=ghijkl")]
    start = time.time()
    got = {r.doc_id: r.text for r in secrets.redact(documents(spark, rows), secrets.Chains([0.0] * (secrets.WIDTH * secrets.WIDTH), 1e9)).collect()}
    assert time.time() - start < 60
    assert got[1] == "[SECRET] " * 400_000
    found = {r.doc_id: r.base for r in secrets.scan(documents(spark, rows[1:]), secrets.Chains([0.0] * (secrets.WIDTH * secrets.WIDTH), 1e9)).collect()}
    for i, text in rows[1:]:
        want, at = "", 0
        for s in found[i]:
            if s.start > at or not want and not at:
                want += text[at : s.start] + "[SECRET]"
            at = max(at, s.end)
        assert got[i] == want + text[at:], i
