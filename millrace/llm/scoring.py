"""Language-model scores of whole texts by a subword lattice.

The vocabulary is an existing one. Its pieces weight every way of cutting a word into pieces; the probability of a word is
the sum over all of them, by a forward recursion in log space, and a text's is the product over its words and its end. The
pieces' scores start from the vocabulary's own and are then fitted to the training documents by expectation maximisation
over the table of distinct training words: each pass adds up, for every piece, how often it is expected in them.

Pieces never cross a word's start (the mark U+2581 stands there), so a text's marginal probability is exactly the product of
its words', and each distinct word is worked out once per task. Characters outside the vocabulary are spelled in byte pieces.

What grows with the corpus is the table of training words. It is counted by tasks first and then shuffled by word. Scoring
needs each word's count: the COMMON most frequent words are sent to every task (a bounded table); the other words of a
document, counted once per document, are joined to the table by a digest of 128 bits, so that no frequent word is ever a join key.

Defined cases: a null text scores as an empty one (its end alone); repeated rows are learned from and scored once each; a
null doc_id is learned from and not held out; an empty table gives no rows; without any training word the vocabulary's own
scores remain; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, bounded_batches, keep, record_batch, texts

#: Most words whose counts and scores every task gets; at about 200 bytes each, 20 MB in a Python worker.
COMMON = 100_000
#: Distinct words that a counting task holds before it passes their counts on.
HELD_WORDS = 400_000
#: Scores of other words that a task keeps.
HELD_SCORES = 300_000
#: Passes of expectation maximisation.
PASSES = 2
#: Words that a fitting task works on at once.
FIT_WORDS = 20_000
#: Added to each piece's expected count.
SMOOTHING = 0.1
MARK = "▁"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case."""
    return text.translate(_LOWER).split() if text else []


_P = np.uint64(0x9E3779B97F4A7C15)
#: Cells of (word, start, length) that are worked on at once.
CELLS = 1_000_000


class Lattice:
    """Natural log probabilities of pieces, of the 256 byte pieces and of a text's end; words are worked on many at a time."""

    def __init__(self, names: list[str], pieces: np.ndarray, byte: np.ndarray, end: float):
        self.names, self.pieces, self.byte, self.end = names, pieces, byte, end
        self.longest = max(map(len, names), default=1)
        bits = max(4, (8 * len(names)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at, self.probes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 1
        for k, name in enumerate(names):
            h = self._hash(_codes([name]))[-1]
            place, n = int(self._place(h)[0]), 1
            while self.keys[place]:
                place, n = (place + 1) & self.mask, n + 1
            self.keys[place], self.at[place], self.probes = h[0], k, max(self.probes, n)

    @classmethod
    def of_vocabulary(cls, pieces: list[tuple[str, float]]) -> Lattice:
        """pieces: (piece, score), byte pieces as <0xNN>. Scores that are ranks (no log probabilities) weight as 1 / (rank + 100)."""
        ranks = min((s for _, s in pieces), default=0) < -100
        weight = {p: 1 / (100 - s) if ranks else math.exp(s) for p, s in pieces}
        total = sum(weight.values()) + 256e-6
        byte = np.array([weight.pop(f"<0x{b:02X}>", 0) + 1e-6 for b in range(256)]) / total
        return cls(list(weight), np.log(np.array(list(weight.values())) / total), np.log(byte), math.log(0.01))

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Row j: of the first j characters of each word; wraps at 64 bits."""
        out = np.zeros((codes.shape[1] + 1, codes.shape[0]), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                out[j + 1] = out[j] * _P + codes[:, j] + np.uint64(1)
        return out

    def _place(self, h: np.ndarray) -> np.ndarray:
        h = np.asarray(h ^ (h >> np.uint64(29)))
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        place = self._place(h)
        key = self.keys[place]
        out = np.where(key == h, self.at[place], -1)
        todo = np.flatnonzero((key != h) & (key != 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            place[todo] = (place[todo] + 1) & self.mask
            key = self.keys[place[todo]]
            good = key == h[todo]
            out[todo[good]] = self.at[place[todo[good]]]
            todo = todo[~good & (key != 0)]
        return out

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length n: piece numbers and log probabilities, by end - 1, length - 1 and word; -1 and -inf where no piece is. A character without a piece of its own is -2 and spelled in bytes."""
        codes = _codes(words)
        n, longest = codes.shape[1], min(self.longest, codes.shape[1])
        prefix = self._hash(codes)
        number = np.full((n, longest, len(words)), -1, np.int64)
        with np.errstate(over="ignore"):
            power = np.uint64(1)
            for k in range(1, longest + 1):
                power = power * _P
                number[k - 1 :, k - 1] = self._find((prefix[k:] - prefix[:-k] * power).ravel()).reshape(n - k + 1, -1)
        value = np.where(number >= 0, self.pieces[np.maximum(number, 0)] if len(self.pieces) else 0.0, -np.inf)
        spelled = np.argwhere(number[:, 0] < 0)
        for j, w in spelled.tolist():
            value[j, 0, w] = self.byte[_spelling(words[w][j])].sum()
            number[j, 0, w] = -2
        return number, value

    @staticmethod
    def _forward(value: np.ndarray) -> np.ndarray:
        n, longest, m = value.shape
        f = np.full((n + 1, m), -np.inf)
        f[0] = 0
        for j in range(1, n + 1):
            k = min(longest, j)
            f[j] = np.logaddexp.reduce(f[j - k : j][::-1] + value[j - 1, :k])
        return f

    def _groups(self, words: list[str]):
        """Numbers of words of one length, few enough to work on at once."""
        lengths = np.array(list(map(len, words)))
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            n = int(lengths[order[a]])
            step = max(1, CELLS // ((n + 1) * min(self.longest, n + 1)))
            for i in range(a, b, step):
                yield order[i : min(i + step, b)]

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Of each word, over all its segmentations."""
        out = np.zeros(len(words))
        for group in self._groups(words) if words else ():
            out[group] = self._forward(self._edges([MARK + words[k] for k in group.tolist()])[1])[-1]
        return out

    def expected(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each piece and each byte is expected in these words, each taken so many times."""
        pieces, byte = np.zeros(len(self.names)), np.zeros(256)
        for group in self._groups(words) if words else ():
            own = [MARK + words[k] for k in group.tolist()]
            number, value = self._edges(own)
            n, longest, _ = value.shape
            f = self._forward(value)
            back = np.full_like(f, -np.inf)
            back[n] = 0
            for i in range(n - 1, -1, -1):
                k = np.arange(min(longest, n - i))
                back[i] = np.logaddexp.reduce(value[i + k, k] + back[i + k + 1])
            for k in range(longest):
                share = np.exp(f[: n - k] + value[k:, k] + back[k + 1 :] - f[n]) * times[group]
                at = number[k:, k]
                found = at >= 0
                pieces += np.bincount(at[found], share[found], len(pieces))
                if k == 0:
                    for j, w in np.argwhere(at == -2).tolist():
                        byte[_spelling(own[w][j])] += share[j, w]
        return pieces, byte


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _spelling(character: str) -> list[int]:
    return list(character.encode("utf-8", "surrogatepass"))


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model; unknown and control pieces are left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    # A mark inside a piece would cross words; white space runs never occur in words.
    return [(m.id_to_piece(k), m.get_score(k)) for k in range(m.get_piece_size()) if not m.is_unknown(k) and not m.is_control(k) and MARK not in m.id_to_piece(k)[1:]]


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary, lower-cased A-Z), n and docs' number of texts: one row per distinct word; the word null counts texts."""
    bounded_batches(docs.sparkSession)
    kinds = arrow_schema(docs.sparkSession, "word binary, n bigint")

    def run(batches):
        held, n_texts = Counter(), 0

        def out():
            names = list(held)
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield record_batch({"word": part, "n": [held[w] for w in part]}, kinds)
            held.clear()

        for batch in batches:
            for text in batch["text"].to_pylist():
                held.update(words_of(text))
                n_texts += 1
            if len(held) > HELD_WORDS:
                yield from out()
        yield from out()
        yield record_batch({"word": [None], "n": [n_texts]}, kinds)

    return texts(docs).mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _text(word: bytes) -> str:
    return word.decode("utf-8", "surrogateescape")


def fit(lattice: Lattice, counts: DataFrame, n_texts: int, n_words: int, passes: int = PASSES) -> Lattice:
    """The lattice with probabilities fitted to the word counts: one job over the distinct words for each pass."""
    spark = counts.sparkSession
    for _ in range(passes if n_words else 0):
        held = spark.sparkContext.broadcast(lattice)

        def run(batches, held=held):
            pieces, byte = np.zeros(len(held.value.names)), np.zeros(256)
            words, times = [], []
            for batch in itertools.chain(batches, [None]):
                if batch is not None:
                    words += batch["word"].to_pylist()
                    times.append(batch["n"].to_numpy().astype(float))
                # Many words at a time: the work on one length costs little more for thousands than for one.
                if words and (batch is None or len(words) >= FIT_WORDS):
                    p, b = held.value.expected(list(map(_text, words)), np.concatenate(times))
                    pieces, byte, words, times = pieces + p, byte + b, [], []
            every = np.concatenate((pieces, byte))
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at])], ["piece", "n"])

        # One row per piece of the vocabulary and byte at most.
        rows = counts.where("word is not null").mapInArrow(run, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        expected = np.full(len(lattice.names) + 256, SMOOTHING)
        expected[rows["piece"].to_numpy(np.int64)] += rows["n"].to_numpy(float)
        total = expected.sum() + n_texts + SMOOTHING
        log = np.log(expected / total)
        lattice = Lattice(lattice.names, log[:-256], log[-256:], math.log((n_texts + SMOOTHING) / total))
    return lattice


class Numbers(dict):
    """Each new word gets the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Memo:
    """Number, count and log probability of the common words, and log probabilities of as many more as there is room for."""

    def __init__(self, lattice: Lattice, common: dict[bytes, int]):
        self.lattice, self.common = lattice, common
        self.known = dict(zip(common, lattice.log_probabilities(list(map(_text, common))).tolist(), strict=True))

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.known.get, words))
        if missing := [k for k, v in enumerate(out) if v is None]:
            new = [words[k] for k in missing]
            found = self.lattice.log_probabilities(list(map(_text, new))).tolist()
            for k, v in zip(missing, found, strict=True):
                out[k] = v
            if len(self.known) < len(self.common) + HELD_SCORES:
                self.known.update(zip(new, found, strict=True))
        return np.array(out, float)


def score(docs: DataFrame, pieces: list[tuple[str, float]], train: Column, common: int = COMMON, passes: int = PASSES) -> DataFrame:
    """One row per document: doc_id, train (whether it was learned from), n_tokens, n_known, train_tokens, base_score, score (both log10)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    train = F.coalesce(train, F.lit(True))
    counts = keep(word_counts(docs.where(train)), "words")
    totals = counts.agg(F.sum("n").alias("all"), F.count("word").alias("distinct"), F.sum(F.when(F.col("word").isNull(), F.col("n"))).alias("texts")).first()
    n_texts, n_all, distinct = totals.texts or 0, totals.all or 0, totals.distinct + (1 if totals.texts else 0)
    lattice = fit(Lattice.of_vocabulary(pieces), counts, n_texts, n_all - n_texts, passes)
    # The most frequent words by steps of the count's logarithm: as many whole steps as hold no more than `common` words. The histogram has
    # at most 1,024 rows; the words of the lower steps never reach the driver.
    step = F.floor(F.log2("n") * 16).cast("int")
    words = counts.where("word is not null")
    cut, many = -1, 0
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r.step):
        many += r.k
        if many > common:
            cut = r.step
            break
    top = words.where(step > cut).toPandas()
    held = spark.sparkContext.broadcast((lattice, dict(zip(map(bytes, top["word"]), top["n"].tolist(), strict=True))))
    unit = math.log10(n_all + distinct + 1)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row bigint, doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double, word bigint, more bigint, times bigint"
    kinds = arrow_schema(spark, schema)

    def run(batches):
        """A row per document with what the common words give, and one per other distinct word of it."""
        import xxhash

        memo = Memo(*held.value)
        digest, common = xxhash.xxh3_128_digest, memo.common
        for batch in batches:
            number = Numbers()
            parts = [words_of(t) for t in batch["text"].to_pylist()]
            size = np.array(list(map(len, parts)), np.int64)
            ids = np.array([k for p in parts for k in map(number.__getitem__, p)], np.int64)
            names = list(number)
            log_p = memo.log_probabilities(names) / math.log(10)
            c = np.array([common.get(w, 0) for w in names], np.int64)
            doc = np.repeat(np.arange(len(parts)), size)
            base = np.where(c > 0, np.log10(c + 1.0) - unit, 0.0)
            by_doc = lambda x: np.bincount(doc, x, len(parts)) if len(doc) else np.zeros(len(parts))  # noqa: E731, B023
            own = {"row": batch["row"], "doc_id": batch["doc_id"], "train": batch["train"], "n_tokens": size + 1}
            own |= {"n_known": by_doc((c > 0)[ids].astype(float)).astype(np.int64) + (n_texts > 0), "base_score": by_doc(base[ids]) + math.log10(n_texts + 1) - unit, "score": by_doc(log_p[ids]) + lattice_end}
            yield record_batch(own | {x: pa.nulls(len(parts), pa.int64()) for x in ("word", "more", "times")}, kinds)
            rare = c[ids] == 0
            if rare.any():
                pair, times = np.unique(doc[rare] * len(names) + ids[rare], return_counts=True)
                used = np.unique(pair % len(names))
                hashes = np.zeros((len(names), 2), np.int64)
                hashes[used] = np.frombuffer(b"".join(digest(names[k]) for k in used.tolist()), np.int64).reshape(-1, 2)
                rows = batch["row"].take(pa.array(pair // len(names)))
                empty = {f.name: pa.nulls(len(pair), f.type) for f in kinds}
                yield record_batch(empty | {"row": rows, "word": pa.array(hashes[pair % len(names), 0]), "more": pa.array(hashes[pair % len(names), 1]), "times": times.astype(np.int64)}, kinds)

    lattice_end = lattice.end / math.log(10)
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary").alias("text"), train.alias("train"))
    # Kept, because two branches read it and must agree on the row numbers.
    parts = keep(own.mapInArrow(run, schema), "scores")
    # The hash is made in Python for both sides.
    rare_counts = words.where(step <= cut).mapInArrow(_hashed, "word bigint, more bigint, n bigint")
    rest = parts.where("word is not null").select("row", "word", "more", "times").join(rare_counts, ["word", "more"], "left")
    c = F.coalesce("n", F.lit(0))
    rest = rest.groupBy("row").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * (F.log10(c + 1) - F.lit(unit))).alias("more_base"))
    out = parts.where("word is null").join(rest, "row", "left")
    return out.select("doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score")


def _hashed(batches):
    import xxhash

    digest = xxhash.xxh3_128_digest
    for batch in batches:
        h = np.frombuffer(b"".join(map(digest, batch["word"].to_pylist())), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), batch["n"]], ["word", "more", "n"])
