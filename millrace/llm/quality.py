"""Quality rules and an isolation forest on rule statistics.

One narrow pass over whole texts yields a row of statistics per document, which is kept in the shared folder; all that
follows reads those few numbers, never a text. The forest isolates documents by random splits of all ten statistics, as shares
and means, so unusual ones have short paths. Each statistic is put in the same scale first: its distance from the median of the
documents labelled good, in their interquartile ranges, as an inverse hyperbolic sine, so that long tails don't draw all splits.

All labelled documents are learned from. They are dealt to the trees by hash, each to one tree at least, and to as many as
give every tree SUBSAMPLE of them; those labelled bad go to fewer trees, so that they stay rare in each. Quartiles and the
path length below which a document is rejected follow from counts of all labelled rows, by values in steps of 2^-11 of
themselves and by scores in steps of 2^-16: the cut with the best balanced accuracy among those that keep at least KEEP_GOOD
of the documents labelled good. Only those counts and the finished trees reach the driver. Without labels of both kinds
nothing is rejected but by the base rules.

Defined cases: a null or empty text has no words and fails the base rules; a null doc_id has no label; repeated rows are
each judged, and each learned from; labels with a null doc_id or quality are not used; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import arrow_schema, bounded_batches, keep, record_batch, scan, texts

TREES = 300
#: Labelled documents that a tree holds at least, if there are so many; its height is the logarithm of it.
SUBSAMPLE = 256
KEEP_GOOD = 0.99
#: Rows labelled bad in what the trees are grown on, as a share of those labelled good: anomalies stand out while they are rare.
RARE = 0.03
SEED = 20
#: Least interquartile range: a statistic that most good documents have alike.
LEAST_SPREAD = 1e-5
#: Steps between 0 and 1 in which scores are counted.
SCORES = 1 << 16
#: Batches that are counted at once.
BATCHES = 100

_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(0x80, 0x100)])
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_nonletters")


def _less(text: bytes, drop: bytes) -> int:
    return len(text.translate(None, drop))


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows that are found twice or more, and the number of distinct words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(words) < 4:
        return 0, len(number)
    pairs = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    triples = pairs[:-1] * np.int64(len(number)) + ids[2:]
    _, inverse, count = np.unique(triples, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum()), len(number)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS of every whole text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(batch: pa.RecordBatch) -> dict:
        out = {"doc_id": batch["doc_id"]} | {c: [] for c in COUNTS}
        for text in batch["text"].to_pylist():
            text = text or b""
            words, lines = text.split(), [x for x in text.split(b"\n") if x.strip(_SPACE)]
            repeat, distinct = repeated_words(words)
            letters = _less(text, _SPACE)
            values = (len(words), _less(text, _SPACE + _CONTINUATION), len(text) - _less(text, _SYMBOLS), len(lines) - len(set(lines)), repeat, len(lines), distinct, len(text) - _less(text, _UPPER), len(text) - _less(text, _DIGITS), letters - (len(text) - _less(text, _LETTERS)))
            for c, v in zip(COUNTS, values, strict=True):
                out[c].append(v)
        return out

    return scan(texts(docs), one, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row per document, one column per statistic: logarithms of sizes, means, and shares."""
    n = {k: np.asarray(counts[k], float) for k in COUNTS}
    words, chars, lines = (np.maximum(n[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    per_word, per_char = ("n_repeat_words", "n_distinct"), ("n_symbols", "n_upper", "n_digits")
    columns = [np.log(words), chars / words, np.log(words / lines), n["n_dup_lines"] / lines, *(n[k] / words for k in per_word), *(n[k] / chars for k in per_char), (n["n_nonletters"] - n["n_digits"]) / chars]
    return np.column_stack(columns)


def stepped(values: np.ndarray) -> np.ndarray:
    """Values in steps of 2^-11 of themselves, so that there are few different ones, however many rows there are."""
    return (np.ascontiguousarray(values, np.float32).view(np.uint32) & np.uint32(0xFFFFF000)).view(np.float32).astype(float) + 0.0


class Scale:
    """Columns in interquartile ranges from the median, as inverse hyperbolic sines. Each column is given as its ascending values and how often each is found."""

    def __init__(self, columns: list[tuple[np.ndarray, np.ndarray]]):
        quartiles = [values[np.searchsorted(np.cumsum(n), np.array((0.25, 0.5, 0.75)) * n.sum())] for values, n in columns]
        low, self.middle, high = np.array(quartiles).T
        self.spread = np.maximum(high - low, LEAST_SPREAD)

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.arcsinh((rows - self.middle) / self.spread)


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grown(rows: np.ndarray, height: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree of rows: the column and the cut of each node, and at a leaf (column -1) the path length. Node k has the children 2k and 2k + 1."""
    nodes = 2 ** (height + 1)
    column, cut, path = np.full(nodes, -1, np.int16), np.zeros(nodes), np.zeros(nodes)
    todo = [(1, rows, 0)]
    while todo:
        k, x, depth = todo.pop()
        low, high = x.min(0), x.max(0)
        open_columns = np.flatnonzero(high > low)
        if depth == height or not len(open_columns):
            path[k] = depth + _expected(len(x))
            continue
        c = int(rng.choice(open_columns))
        at = rng.uniform(low[c], high[c])
        left = x[:, c] <= at
        if left.all():  # two values next to each other
            path[k] = depth + _expected(len(x))
            continue
        column[k], cut[k] = c, at
        todo += [(2 * k, x[left], depth + 1), (2 * k + 1, x[~left], depth + 1)]
    return column, cut, path


def height_of(size: int) -> int:
    return max(1, int(np.ceil(np.log2(max(size, 2)))))


class IsolationForest:
    """Trees as arrays of the same size: column, cut, and at a leaf (column -1) the path length."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(subsample, len(rows))
        height = height_of(size)
        self._set([grown(rows[rng.choice(len(rows), size, replace=False)], height, rng) for _ in range(trees)], height, [size])

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], height: int, sizes: list[int]) -> IsolationForest:
        """Trees that were grown elsewhere, of so many rows each."""
        out = cls.__new__(cls)
        out._set(trees, height, sizes)
        return out

    def _set(self, trees, height: int, sizes: list[int]) -> None:
        self.depth, self.sizes = height, np.array(sizes)
        self.column, self.cut, self.path = (np.array(x) for x in zip(*trees, strict=True))
        self.usual = float(_expected(self.sizes).mean()) or 1.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2^(-mean path / usual path): near 1 for anomalies, about 0.5 or less for ordinary rows."""
        trees = np.arange(len(self.column))
        at = np.ones((len(rows), len(trees)), np.int64)
        for _ in range(self.depth):
            column = self.column[trees, at]
            right = np.take_along_axis(rows, np.maximum(column, 0), 1) > self.cut[trees, at]
            at = np.where(column < 0, at, 2 * at + right)
        return 2 ** (-self.path[trees, at].mean(1) / self.usual)


def calibrated(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score above which documents are rejected."""
    cuts, at = np.unique(scores, return_inverse=True)
    return best_cut(cuts, np.bincount(at[good], minlength=len(cuts)), np.bincount(at[~good], minlength=len(cuts)), keep_good)


def best_cut(cuts: np.ndarray, n_good: np.ndarray, n_bad: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The same from ascending scores and how many good and bad documents have each."""
    if not n_good.sum() or not n_bad.sum():
        return np.inf
    kept_good, kept_bad = np.cumsum(n_good) / n_good.sum(), np.cumsum(n_bad) / n_bad.sum()
    gain = np.where(kept_good >= keep_good, kept_good - kept_bad, -np.inf)
    return float(cuts[int(np.argmax(gain))]) if gain.max() > 0 else np.inf


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _counts(batch: pa.RecordBatch | pa.Table) -> dict[str, np.ndarray]:
    return {c: batch[c].to_numpy() if isinstance(batch, pa.Table) else batch[c].to_numpy(zero_copy_only=False) for c in COUNTS}


def _counted(rows: DataFrame, one: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]):
    """What one(rows) gives, a number and a value for each, counted over all rows: at, value, n, ascending, on the driver."""
    schema = "at int, value double, n bigint"
    kinds = arrow_schema(rows.sparkSession, schema)

    def count(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        at, value = one(pa.Table.from_batches(batches))
        pairs, n = np.unique(np.column_stack((at, value)), axis=0, return_counts=True)
        return record_batch({"at": pairs[:, 0].astype(np.int32), "value": pairs[:, 1], "n": n}, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if len(held) == BATCHES:
                yield count(held)
                held = []
        if held:
            yield count(held)

    return rows.mapInArrow(run, schema).groupBy("at", "value").agg(F.sum("n").alias("n")).toPandas().sort_values(["at", "value"], ignore_index=True)


def _forest(rows: DataFrame, scale: Scale, copies: tuple[int, int], trees: int, subsample: int) -> IsolationForest:
    """A forest of all rows: a bad one goes to copies[0] different trees, a good one to copies[1], which its hash names."""
    steps = np.array([k for k in range(1, trees + 1) if math.gcd(k, trees) == 1])
    height = height_of(subsample)
    values = [f"x{k}" for k in range(len(COUNTS))]

    def deal(batch: pa.RecordBatch) -> dict | None:
        if not batch.num_rows:
            return None
        h = batch["h"].to_numpy()
        times = np.where(batch["quality"].to_numpy() > 0, copies[1], copies[0])
        row = np.repeat(np.arange(len(h)), times)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        tree = (h[row] % trees + steps[h[row] // trees % len(steps)] * nth) % trees
        return {"tree": tree.astype(np.int32)} | dict(zip(values, scale(features(_counts(batch)))[row].T, strict=True))

    def grow(key: tuple, own: pa.Table) -> pa.Table:
        x = np.column_stack([own[c].to_numpy() for c in values])
        tree = key[0].as_py()
        column, cut, path = grown(x[np.lexsort(x.T)], height, np.random.default_rng((SEED, tree)))
        return pa.table({"tree": pa.array([tree], pa.int32()), "size": pa.array([len(x)], pa.int64()), "split": pa.array([column.tolist()], pa.list_(pa.int16())), "cut": pa.array([cut.tolist()], pa.list_(pa.float64())), "path": pa.array([path.tolist()], pa.list_(pa.float64()))})

    dealt = scan(rows, deal, "tree int, " + ", ".join(f"{c} double" for c in values))
    got = dealt.groupBy("tree").applyInArrow(grow, "tree int, size bigint, split array<smallint>, cut array<double>, path array<double>").toPandas().sort_values("tree")
    return IsolationForest.of([(np.array(c, np.int16), np.array(t, float), np.array(p, float)) for c, t, p in zip(got["split"], got["cut"], got["path"], strict=True)], height, got["size"].to_numpy())


def copies_of(n_good: int, n_bad: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> tuple[int, int]:
    """How many trees a bad row and a good row go to: every row to one at least, SUBSAMPLE rows to a tree if there are so many, bad ones a share of RARE of the good, as far as that can be."""
    good = min(trees, max(math.ceil(trees * subsample / (n_good + n_bad)), math.ceil(n_bad / (RARE * n_good))))
    return (min(trees, max(1, round(RARE * good * n_good / n_bad))) if n_bad else 1), good


def judge(docs: DataFrame, labels: DataFrame, keep_good: float = KEEP_GOOD, trees: int = TREES, subsample: int = SUBSAMPLE) -> DataFrame:
    """doc_id, COUNTS, base_failed, anomaly (the forest's score), threshold, kept.

    labels may have several rows for a document: the best quality of them counts.
    """
    stats = keep(statistics(docs), "statistics")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    h = F.shiftrightunsigned(F.xxhash64("doc_id", *COUNTS), 1).alias("h")
    rows = keep(stats.where(~base_failed()).join(known, "doc_id").select(*COUNTS, "quality", h), "labelled")
    out = stats.withColumn("base_failed", base_failed())

    def values(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Each statistic of the good rows by its number, and each row's label by -1."""
        is_good = batch["quality"].to_numpy() > 0
        x = features(_counts(batch))[is_good]
        return np.concatenate((np.full(len(is_good), -1), np.repeat(np.arange(x.shape[1]), len(x)))), np.concatenate((is_good.astype(float), stepped(x.T.ravel())))

    found = _counted(rows, values)
    n_bad, n_good = (int(found["n"][(found["at"] == -1) & (found["value"] == k)].sum()) for k in (0, 1))
    if not n_good:
        return out.withColumns({"anomaly": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "kept": ~F.col("base_failed")})
    scale = Scale([(own["value"].to_numpy(), own["n"].to_numpy()) for k, own in found.groupby("at") if k >= 0])
    forest = _forest(rows, scale, copies_of(n_good, n_bad, trees, subsample), trees, subsample)
    held = docs.sparkSession.sparkContext.broadcast((scale, forest))

    def anomaly(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        scale, forest = held.value
        return forest.scores(scale(features(_counts(batch))))

    scores = _counted(rows, lambda batch: ((batch["quality"].to_numpy() > 0).astype(int), np.ceil(anomaly(batch) * SCORES))).pivot_table(index="value", columns="at", values="n", fill_value=0, aggfunc="sum")
    limit = best_cut(scores.index.to_numpy() / SCORES, *(scores[k].to_numpy() if k in scores else np.zeros(len(scores)) for k in (1, 0)), keep_good)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.schema) + ", anomaly double"

    def one(batch: pa.RecordBatch) -> dict:
        return {n: batch[n] for n in batch.schema.names} | {"anomaly": pa.array(anomaly(batch) if batch.num_rows else [], pa.float64())}

    out = scan(out, one, schema).withColumn("threshold", F.lit(limit))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= F.col("threshold")))
