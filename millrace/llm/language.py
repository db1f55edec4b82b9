"""Language identification by bit-sliced Bloom filters over character n-grams.

Training counts the n-grams of every labelled document, language by language; each task counts what it scans before
anything is shuffled, and only sums per (language, n-gram) are. A language contains an n-gram that makes up MIN_SHARE or more of
that language's n-grams, which holds at every size of the corpus and keeps passages in other languages out; there are at most
1 / MIN_SHARE of those to a language, whatever the number of languages; the filters of WORD languages at a time are filled on the driver, and MOST_LANGUAGES are the most.

The filters of all languages lie over each other: a cell of the table is a bitmask with one bit per language, so the AND of
an n-gram's few cells is the set of all languages that contain it. A document's hits are counted for each language,
corrected for the filter's rate of false positives, and the language with most wins. The score is the winner's share of the
n-grams that at least one language contains; the cover is its share of all n-grams, as a part of the share that it has in the
language's own training texts.

Letters are characters of the Unicode categories L, with the marks (M) behind them.

Defined cases: `und` with score 0 if a text is null or has no letter, or if nothing was learned; a letter-bearing text
without any known n-gram gets the most frequent language with score 0; rows with null lang or text are not learned from;
repeated rows count once each; an empty table gives no rows; other columns are ignored, and kept by reject_unknown().
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, forget, keep, scan, texts

SIZES = (2, 3, 4)
MIN_SHARE = 2e-5
#: Languages to a word of a cell; the most that are learned (of cells of 64 KB to a language, 256 MB).
WORD, MOST_LANGUAGES = 64, 4096
HASHES = 3
#: Least cover of a document that reject_unknown() keeps.
MIN_COVER = 0.4
#: Bits of the table's index; 2^20 cells of a 64-bit mask are 8 MB for up to 64 languages.
MIN_BITS = 16
LOAD = 8

UNKNOWN = "und"


@functools.cache
def _not_letters() -> re.Pattern:
    """Runs of characters that are neither letters nor marks, by their Unicode categories."""
    kinds = np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(kinds.astype(np.int8), prepend=0, append=0)).tolist()
    return re.compile(f"[^{''.join(f'\\U{a:08x}-\\U{b - 1:08x}' for a, b in zip(edges[::2], edges[1::2], strict=True))}]+")


def codes(text: bytes) -> np.ndarray:
    """Code points of the lower-cased letters and marks, words apart by one space."""
    s = _not_letters().sub(" ", text.decode("utf-8", "replace").lower())
    return np.frombuffer(f" {s} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64) if any(map(str.isalpha, s)) else np.zeros(0, np.uint64)


def grams(c: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of SIZES; those of equal text are equal."""
    out = []
    for n in SIZES:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass
class Filters:
    languages: list[str]
    bits: int
    cells: np.ndarray  # (languages + 63) // 64 words for each cell
    false_rate: np.ndarray
    mass: np.ndarray  # the part of each language's n-grams, as often as they occur, that its filter holds

    @classmethod
    def of(cls, sets: dict[str, np.ndarray], mass: dict[str, float] | None = None) -> Filters:
        """sets: the n-gram hashes of each language, the most frequent language first."""
        return cls.filled(list(sets), max((len(s) for s in sets.values()), default=0), iter(sets.values()), mass or {})

    @classmethod
    def filled(cls, languages: list[str], most: int, sets: Iterator[np.ndarray], mass: dict[str, float]) -> Filters:
        """most: the size of the largest set. sets: one after the other, in the languages' order."""
        bits = max(MIN_BITS, int(most * HASHES * LOAD).bit_length())
        cells = np.zeros((1 << bits, max(1, -(-len(languages) // WORD))), np.uint64)
        fill = []
        for k, s in enumerate(sets):
            for place in _places(s, bits):
                np.bitwise_or.at(cells[:, k // WORD], place, np.uint64(1) << np.uint64(k % WORD))
            fill.append(((cells[:, k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).mean())
        return cls(languages, bits, cells, np.array(fill) ** HASHES, np.array([mass.get(x, 1.0) for x in languages]))

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, float]:
        """N-grams of each language, without the false positives to be expected, and how many n-grams told languages apart."""
        mask = np.full((len(hashes), self.cells.shape[1]), ~np.uint64(0), np.uint64)
        for place in _places(hashes, self.bits):
            mask &= self.cells[place]
        found = np.array([int(((mask[:, k // WORD] >> np.uint64(k % WORD)) & np.uint64(1)).sum()) for k in range(len(self.languages))], float)
        return np.maximum(0, (found - self.false_rate * len(hashes)) / (1 - self.false_rate)), float(mask.any(1).sum())

    def measure(self, text: bytes | None) -> tuple[str, float, float]:
        """Language, score and cover."""
        c = codes(text) if text else ()
        if not len(c) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        # Long texts in parts, so memory is bounded; a part overlaps the next by the longest n-gram.
        hits, told, n = np.zeros(len(self.languages)), 0.0, 0
        size = max(1 << 12, (1 << 18) // self.cells.shape[1])
        for i in range(0, len(c), size):
            g = grams(c[i : i + size + SIZES[-1] - 1])
            h, t = self.hits(g)
            hits, told, n = hits + h, told + t, n + len(g)
        k = int(np.argmax(hits))
        return self.languages[k], float(min(1.0, hits[k] / told)) if told else 0.0, float(hits[k] / (n * self.mass[k]))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """HASHES cells of each n-gram, from two halves of its hash."""
    a, b = hashes >> np.uint64(32), (hashes & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return [(((a + np.uint64(k) * b) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).astype(np.int64) for k in range(HASHES)]


def learn(docs: DataFrame, train: Column | None = None, min_share: float = MIN_SHARE) -> Filters:
    """Filters from all rows with text and lang for which train holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (train if train is not None else F.lit(True)))

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size: dict[str, int] = {}

        def count(lang: str) -> None:
            found = [np.unique(np.concatenate(waiting.pop(lang)), return_counts=True), *held.get(lang, [])]
            names, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            held[lang] = [(names, np.bincount(at, np.concatenate([f[1] for f in found]).astype(float)).astype(np.int64))]
            size[lang] = 0

        def out():
            for lang in list(waiting):
                count(lang)
            for lang, [(names, counts)] in held.items():
                for i in range(0, len(names), 100_000):
                    part = names[i : i + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(counts[i : i + 100_000])], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                c = codes(text)
                for i in range(0, len(c), 1 << 18):
                    waiting.setdefault(lang, []).append(g := grams(c[i : i + (1 << 18) + SIZES[-1] - 1]))
                    size[lang] = size.get(lang, 0) + len(g)
                    if size[lang] > 1_000_000:
                        count(lang)
            if sum(len(x[0][0]) for x in held.values()) > 2_000_000:
                yield from out()
        yield from out()

    # Kept, because two jobs read it.
    counts = keep(texts(rows, "lang").mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r.lang: r.total for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    if not totals:
        return Filters.of({})
    order = sorted(totals, key=lambda x: (-totals[x], x))
    if len(order) > MOST_LANGUAGES:
        raise ValueError(f"lang has {len(order)} values; at most {MOST_LANGUAGES} are learned")
    number = spark.createDataFrame([(x, k, min_share * totals[x]) for k, x in enumerate(order)], "lang string, k int, least double")
    often = keep(counts.join(F.broadcast(number), "lang").where("n >= least").select("k", "gram", "n"), "often")
    forget(counts)
    held = {r.k: (r.size, r.n) for r in often.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n")).collect()}

    def sets():
        # At most 1 / min_share n-grams of a language reach the driver, and WORD languages' at once.
        for first in range(0, len(order), WORD):
            part = often.where(F.col("k").between(first, first + WORD - 1)).toPandas()
            for k in range(first, min(first + WORD, len(order))):
                yield np.sort(part["gram"][part["k"] == k].to_numpy(np.int64)).view(np.uint64)

    mass = {x: max(1e-9, float(held.get(k, (0, 0))[1]) / totals[x]) for k, x in enumerate(order)}
    out = Filters.filled(order, max((size for size, _ in held.values()), default=0), sets(), mass)
    forget(often)
    return out


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score, cover."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(filters)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        found = [held.value.measure(x) for x in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found], "cover": [f[2] for f in found]}

    return scan(texts(docs), one, f"doc_id {kind}, lang_pred string, score double, cover double")


def reject_unknown(docs: DataFrame, filters: Filters, min_cover: float = MIN_COVER) -> DataFrame:
    """docs, all columns, without the documents whose language is unknown or whose n-grams are mostly those of no learned language.

    Where nothing was learned, only documents without a letter go.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(filters)
    body = docs.columns.index("text")
    schema = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))

    def one(batch: pa.RecordBatch) -> dict:
        found = [held.value.measure(x.encode() if x is not None else None) for x in batch[f"c{body}"].to_pylist()]
        known = [lang != UNKNOWN and cover >= min_cover for lang, _, cover in found]
        mask = pa.array(known if held.value.languages else [bool(x and len(codes(x.encode()))) for x in batch[f"c{body}"].to_pylist()], pa.bool_())
        return {name: batch[name].filter(mask) for name in batch.schema.names}

    return scan(docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), one, schema).toDF(*docs.columns)
