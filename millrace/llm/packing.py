"""Best-fit decreasing packing of tokenised documents into windows of equal length.

A document's ids are cut into full windows first; what is left (shorter than a window) is placed by best-fit
decreasing: longest piece first, each into the open window with the least room that still holds it. Open windows are
counted in a segment tree indexed by remaining capacity, so the tightest one is found in log(capacity) steps.

Each task packs what it scans, in rounds of a bounded number of tokens: one pass, no shuffle, and a lost executor costs
only its own tasks. A round of ROUND_TOKENS fills about 2,000 windows, of which best-fit decreasing leaves a few
partly empty.

Defined cases: null and empty texts are documents of the end id alone; repeated rows and repeated doc_ids are packed once
for each row; a null doc_id stays null; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, bounded_batches, record_batch, texts

CAPACITY = 2048
END_ID = 1
#: Tokens that one round of packing holds in memory (4 bytes each).
ROUND_TOKENS = 4_000_000
#: Words, and parts of words, that a worker remembers, and the longest of them.
MEMO_WORDS = 250_000
MEMO_LONGEST = 64
#: The pattern of the one family of vocabularies that words are remembered for, and the last letter of Latin Extended-B.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LAST_LATIN = "\u024f"


class Tokens:
    """Ids of whole texts, as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.words = Words(self.tokenizer) if Words.fits(tokenizer_json) else None

    def of(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        if self.words is None:
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    def encode(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


class Words(dict):
    """Ids of words, worked out once per worker while there is room, for a vocabulary that drops white space and ignores case.

    Such a vocabulary never joins characters across white space. A word in Latin letters is lower-cased and cut by the
    tokenizer's own pattern, and its parts go to the tokenizer's merges; any other word is encoded whole.
    """

    def __init__(self, tokenizer):
        import regex

        super().__init__()
        self.tokenizer, self.parts, self.merge = tokenizer, {}, tokenizer.model.tokenize
        self.cut = regex.compile(SPLIT_PATTERN).findall
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = (b for b in range(256) if b not in shown)
        self.symbols = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(hidden)}

    @staticmethod
    def fits(tokenizer_json: str) -> bool:
        t = json.loads(tokenizer_json)
        steps = [x["type"] for x in (t["normalizer"] or {}).get("normalizers", [])]
        before = (t["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return steps == ["NFC", "Replace", "Lowercase"] and before[0].get("pattern") == {"Regex": SPLIT_PATTERN} and before[0].get("invert") and before[0].get("behavior") == "Removed" and before[-1]["type"] == "ByteLevel" and not before[-1]["add_prefix_space"] and t["model"]["type"] == "BPE"

    def __missing__(self, word: bytes) -> bytes:
        w = word.decode("utf-8", "replace")
        if max(w) <= LAST_LATIN and not any(s in w for s in self.specials):
            get = self.parts.get
            ids = b"".join([get(p) or self._part(p) for p in self.cut(w.lower())])
        else:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) < MEMO_WORDS and len(word) <= MEMO_LONGEST:
            self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        text = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.symbols)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.merge(text)])
        if len(self.parts) < MEMO_WORDS and len(part) <= MEMO_LONGEST:
            self.parts[part] = ids
        return ids


class OpenWindows:
    """Windows by remaining capacity; the segment tree counts the open ones below each node."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._count(room, 1)

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """The open window with the least room of at least need, and that room; it is no longer open."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._count(room, -1)
        return self.at[room].pop(), room

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece, and the number of windows."""
    windows, window, offset, opened = OpenWindows(capacity), [0] * len(lengths), [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if found := windows.take_tightest(lengths[k]):
            window[k], room = found
        else:
            window[k], room, opened = opened, capacity, opened + 1
        offset[k] = capacity - room
        if room > lengths[k]:
            windows.add(window[k], room - lengths[k])
    return window, offset, opened


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    kinds, end = arrow_schema(spark, schema), np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, sequence = Tokens(tokenizer_json), TaskContext.get().partitionId() << 40
        pieces, held = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = tokens.of(text) + end
                n = len(ids) // 4
                pieces += [(doc, i, ids[4 * i : 4 * (i + capacity)], n) for i in range(0, n, capacity)]
                held += n
            if held >= ROUND_TOKENS:
                yield from placed(pieces, sequence)
                sequence, pieces, held = sequence + len(pieces), [], 0
        yield from placed(pieces, sequence)

    def placed(pieces: list[tuple], sequence: int) -> Iterator[pa.RecordBatch]:
        lengths = [len(p[2]) // 4 for p in pieces]
        window, offset, _ = best_fit_decreasing(lengths, capacity)
        for i in range(0, len(pieces), 4000):
            part = pieces[i : i + 4000]
            yield record_batch({"doc_id": [p[0] for p in part], "start": [p[1] for p in part], "length": lengths[i : i + 4000], "ids": [p[2] for p in part], "doc_tokens": [p[3] for p in part], "sequence_id": [sequence + w for w in window[i : i + 4000]], "offset": offset[i : i + 4000]}, kinds)

    return texts(docs).mapInArrow(run, schema)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """One row per window: sequence_id, ids padded to capacity, n_tokens, and the documents in it with their places. A window holds at most capacity pieces."""
    word = F.lpad(F.hex(F.lit(pad_id)), 8, "0")
    pad = F.unhex(F.concat(*(F.substring(word, k, 2) for k in (7, 5, 3, 1))))
    whole = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    out = pieces.groupBy("sequence_id").agg(whole.alias("pieces"), F.sum("length").alias("n_tokens"))
    body = F.unhex(F.concat(F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), ""), F.repeat(F.hex(pad), F.lit(capacity).cast("int") - F.col("n_tokens").cast("int"))))
    return out.select("sequence_id", "n_tokens", body.alias("ids"), F.transform("pieces", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))
