"""Secret scans in DataFrame operations alone: fixed patterns, and two character Markov models.

The patterns give the base spans. Beside them, every run of SHORTEST or more key characters is scored, pair by pair, by the
log-likelihood ratio of two first-order character chains, one for random strings and one for ordinary identifiers. The base
spans are cut out of a run, and each piece that is left is judged alone: a piece of WHOLE or more characters whose mean ratio
passes the threshold is a further span as a whole; of any other, each segment whose ratios sum to the least evidence is one,
brought to the ends of its words. The chains, the threshold and the least evidence are trained from labelled samples of
strings: by default random strings made from digests, labelled random, against words (alone and joined as identifiers are) of at
most SAMPLE_DOCUMENTS documents, those whose hashed ids are smallest, labelled ordinary: words outside the base spans that
two or more of these documents have. All texts are scanned whole, in one pass without
a shuffle; the model is a table of fixed size inside the expression.

Positions come from lazily captured prefixes: each match is extracted with the text before it, and the lengths are summed.

Defined cases: a null text is empty and has no span; repeated rows are each scanned; an empty table gives no rows; other
columns are ignored, and kept by redact(); without samples of both labels the models add nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import keep, smallest_hashed

#: Patterns of the base spans, as the contract gives them.
KEYED = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "markov")

SHORTEST, WHOLE = 12, 20
RUN = rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}"
#: Key characters lie between these two code points.
FIRST, WIDTH = 43, 80
SAMPLE_DOCUMENTS = 200
SAMPLE_RANDOM = 2000
BLOCK = 256
#: Code points of a piece of text.
PIECE = 512

SPAN = "struct<start:bigint,rank:int,end:bigint>"
NONE = f"cast(array() as array<{SPAN}>)"


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once; a column named many times would be worked out as often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _found(text: Column, pattern: str, kind: str, value_group: int = 2) -> Column:
    """Spans of the pattern's leftmost, non-overlapping matches whose value is long enough."""
    whole = rf"\G((?s:.*?))({pattern})"
    before, match, value = (F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2, value_group))
    sizes = F.zip_with(F.zip_with(before, match, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("own"))), value, lambda s, v: F.struct(s["gap"].alias("gap"), s["own"].alias("own"), F.length(v).alias("value")))
    return F.filter(_spans(sizes, kind), lambda s: s["value"] >= LEAST[kind])


def _spans(sizes: Column, kind: str) -> Column:
    """Running sums of gap + own, block by block, so that the work stays near linear in the number of matches."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x)

    def blocks(steps: Column) -> Column:
        last = F.floor((F.size(steps) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))
        return F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def placed(sizes: Column, steps: Column, starts: Column) -> Column:
        def place(s: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = F.element_at(starts, block + 1) + total(F.slice(steps, block * BLOCK + 1, i % BLOCK)) + s["gap"]
            return _let(start, lambda at: F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at + s["own"]).alias("end"), s["value"].alias("value")))

        return F.when(F.size(sizes) > 0, F.transform(sizes, place)).otherwise(F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,value:int>>)"))

    return _let(sizes, lambda z: _let(F.transform(z, lambda s: s["gap"] + s["own"]), lambda steps: _let(blocks(steps), lambda starts: placed(z, steps, starts))))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def samples(docs: DataFrame, n_documents: int = SAMPLE_DOCUMENTS, n_random: int = SAMPLE_RANDOM) -> DataFrame:
    """string, random (boolean): labelled strings of key characters."""
    spark: SparkSession = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    raw = F.regexp_replace(F.base64(F.unhex(digest)), "[=]+$", "")
    forms = F.array(raw, F.translate(raw, "+/", "-_"), digest, F.upper(digest), F.substring(F.regexp_replace(raw, "[+/]", ""), 1, 24), F.upper(F.regexp_replace(raw, "[+/]", "")))
    random = spark.range(n_random).select(F.explode(forms).alias("string"), F.lit(True).alias("random"))
    some = smallest_hashed(docs.select("doc_id", "text"), "doc_id", n_documents).where("text is not null").select(F.monotonically_increasing_id().alias("n"), "text")
    # What the base patterns find is no ordinary string, nor is what no second document has: random strings don't recur.
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", KEYED, " "), ACCESS, " "), rf"{HEX[:-1]}{{{LEAST['hex']},}}", " ")
    words = F.filter(F.split(F.regexp_replace(plain, "[^A-Za-z]+", " "), " "), lambda w: F.length(w) >= 2)
    each = keep(some.select("n", F.posexplode(words).alias("pos", "word")), "words")
    usual = each.select("n", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("word")
    words = each.join(usual, "word").groupBy("n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("w")).where("size(w) > 1")
    after = F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1)))
    link = lambda mark: F.zip_with("w", after, lambda a, b: F.concat_ws(mark, a, F.initcap(b) if mark == "" else b))
    joined = [link(mark) for mark in ("", "_", "-", "/", "=", "+")]
    numbered = F.transform("w", lambda w, i: F.concat(w, (i % 100).cast("string")))
    ordinary = words.select(F.explode(F.concat("w", *joined, numbered)).alias("string"), F.lit(False).alias("random"))
    return random.unionByName(ordinary.where(F.col("string").rlike("^[A-Za-z0-9+/_=-]+$")))


class Chains:
    """The two chains as one table of log-likelihood ratios by pair of key characters, the mean ratio for a whole piece to pass, and the sum for a segment."""

    def __init__(self, table: list[float], threshold: float, least: float = math.inf):
        self.table, self.threshold, self.least = table, threshold, least

    @classmethod
    def train(cls, labelled: DataFrame, smoothing: float = 0.5) -> Chains | None:
        """Pair counts by label (at most 2 * WIDTH^2 rows reach the driver); the threshold and the least evidence lie midway between what ordinary and random strings of WHOLE or more characters score."""
        chars = F.split("string", "")
        pairs = F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: F.struct(F.ascii(F.element_at(chars, i)).alias("a"), F.ascii(F.element_at(chars, i + 1)).alias("b")))
        usable = labelled.where(f"string rlike '^[A-Za-z0-9+/_=-]{{2,}}$' and random is not null")
        rows = usable.select("random", F.explode(pairs).alias("p")).groupBy("random", "p.a", "p.b").count().collect()
        counts = {True: {}, False: {}}
        for r in rows:
            counts[r["random"]][r.a, r.b] = r["count"]
        if not all(counts.values()):
            return None
        symbols = sorted({*map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")})
        ratio = [0.0] * (WIDTH * WIDTH)
        for a in symbols:
            sums = {k: sum(c.get((a, b), 0) for b in symbols) for k, c in counts.items()}
            for b in symbols:
                p = {k: (c.get((a, b), 0) + smoothing) / (sums[k] + smoothing * len(symbols)) for k, c in counts.items()}
                ratio[(a - FIRST) * WIDTH + b - FIRST] = round(math.log(p[True] / p[False]), 3)
        own = cls(ratio, 0.0)
        long = usable.where(f"length(string) >= {WHOLE}").select("random", own.mean(F.col("string")).alias("m"), own.most(F.col("string")).alias("e")).groupBy("random")
        low, high = (lambda c: F.percentile_approx(c, 0.01, 10_000).alias(f"low_{c}")), (lambda c: F.percentile_approx(c, 0.999, 10_000).alias(f"high_{c}"))
        edges = {r["random"]: r for r in long.agg(low("m"), high("m"), low("e"), high("e")).collect()}
        midway = lambda c: max(0.0, (edges[True][f"low_{c}"] + (edges[False][f"high_{c}"] if False in edges else 0.0)) / 2)
        if True in edges:
            own.threshold, own.least = midway("m"), midway("e") or math.inf
        else:
            own.threshold = max(0.0, edges[False].high_m if False in edges else 0.0)
        return own

    def ratios(self, run: Column) -> Column:
        """Log-likelihood ratios of the run's pairs of characters."""
        table = F.split(F.lit(",".join(f"{x:g}" for x in self.table)), ",").cast("array<double>")
        codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - FIRST)
        return _let(codes, lambda c: F.transform(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.get(table, F.get(c, i) * WIDTH + x)))

    def mean(self, run: Column) -> Column:
        """Mean log-likelihood ratio over the run's pairs of characters."""
        return F.aggregate(self.ratios(run), F.lit(0.0), lambda n, r: n + r) / F.greatest(F.length(run) - 1, F.lit(1))

    def most(self, run: Column) -> Column:
        """The greatest sum of ratios of any segment of the run."""
        first = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"))
        add = lambda acc, s: F.struct(s.alias("sum"), F.greatest(acc["top"], s).alias("top"))
        return F.aggregate(self.ratios(run), first, lambda acc, r: add(acc, F.greatest(acc["sum"] + r, F.lit(0.0))), lambda acc: acc["top"])

    def segments(self, run: Column) -> Column:
        """(start, end) of the run's segments with the least evidence: each begins where the sum last was 0 and ends at its peak; it closes when the sum is back at 0, or as far below the peak as the least evidence."""
        state = lambda at, sum_, begin, top, peak, out: F.struct(at.alias("at"), sum_.alias("sum"), begin.alias("begin"), top.alias("top"), peak.alias("peak"), out.alias("out"))
        zero, nil = F.lit(0).cast("int"), F.lit(0.0)
        first = state(zero, nil, zero, nil, zero, F.expr("cast(array() as array<struct<start:int,end:int>>)"))
        closed = lambda acc: F.when(acc["top"] >= self.least, F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("start"), (acc["peak"] + 1).alias("end"))))).otherwise(acc["out"])

        def step(acc: Column, r: Column) -> Column:
            # at: the pair's second character.
            s, at = acc["sum"] + r, acc["at"] + 1
            over = (s <= 0) | (acc["top"] - s > self.least)
            higher = s > acc["top"]
            return F.when(over, state(at, nil, at, nil, at, closed(acc))).otherwise(state(at, s, acc["begin"], F.when(higher, s).otherwise(acc["top"]), F.when(higher, at).otherwise(acc["peak"]), acc["out"]))

        return F.aggregate(self.ratios(run), first, step, closed)


def _merged(spans: Column) -> Column:
    """Spans in order of start, those that overlap made one."""
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    join = lambda acc, s: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
    return F.aggregate(spans, none, lambda acc, s: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > s["start"]), join(acc, s)).otherwise(F.concat(acc, F.array(s))))


def _to_words(piece: Column, s: Column) -> Column:
    """The segment with the rest of the words it ends in; a word of which less than half is inside is left out, unless it is all there is."""
    own = piece.substr(s["start"] + 1, s["end"] - s["start"])
    size = lambda text, pattern: F.length(F.regexp_extract(text, pattern, 0))
    parts = F.struct(
        size(F.reverse(piece.substr(F.lit(1), s["start"])), "^[A-Za-z0-9]*").alias("before"), size(own, "^[A-Za-z0-9]*").alias("head"), size(F.reverse(own), "^[A-Za-z0-9]*").alias("tail"),
        size(piece.substr(s["end"] + 1, F.length(piece)), "^[A-Za-z0-9]*").alias("after"), size(piece.substr(s["end"] + 1, F.length(piece)), "^[A-Za-z0-9]*=*").alias("padded"), F.length(own).alias("all"),
    )
    return _let(parts, lambda p: F.struct(
        F.when((p["head"] >= p["before"]) | (p["head"] == p["all"]), s["start"] - p["before"]).otherwise(s["start"] + p["head"]).alias("start"),
        F.when((p["tail"] >= p["after"]) | (p["tail"] == p["all"]), s["end"] + p["padded"]).otherwise(s["end"] - p["tail"]).alias("end"),
    ))


def _judged(piece: Column, chains: Chains) -> Column:
    """(start, end) of what the chains call random in a piece of a run."""
    whole = F.array(F.struct(F.lit(0).cast("int").alias("start"), F.length(piece).alias("end")))
    inside = _merged(F.array_sort(F.transform(chains.segments(piece), lambda s: _to_words(piece, s))))
    return F.when((F.length(piece) >= WHOLE) & (chains.mean(piece) > chains.threshold), whole).otherwise(inside)


def _method(text: Column, chains: Chains, base: Column) -> Column:
    """Spans outside the base spans that the chains call random."""
    whole = rf"\G((?s:.*?))({RUN})"
    before, match = (F.regexp_extract_all(text, F.lit(whole), F.lit(k)) for k in (1, 2))
    # No piece of a run with less evidence than this can pass, alone or as a whole.
    floor = min(chains.least, (WHOLE - 1) * chains.threshold)
    sizes = F.zip_with(before, match, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("own"), (chains.most(b) >= floor).cast("int").alias("value")))
    runs = F.filter(_spans(sizes, "markov"), lambda s: s["value"] == 1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("out"))

    def left(run: Column) -> Column:
        """The run's pieces outside the base spans."""
        upto = lambda acc, end: F.when(end > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["out"])
        own = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
        first = start.withField("at", run["start"])
        return F.aggregate(own, first, lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), upto(acc, b["start"]).alias("out")), lambda acc: upto(acc, run["end"]))

    def found(piece: Column) -> Column:
        own = text.substr((piece["start"] + 1).cast("int"), (piece["end"] - piece["start"]).cast("int"))
        return _let(own, lambda p: F.transform(_judged(p, chains), lambda s: F.struct((piece["start"] + s["start"]).alias("start"), F.lit(KINDS.index("markov")).alias("rank"), (piece["start"] + s["end"]).alias("end"))))

    return F.flatten(F.transform(F.flatten(F.transform(runs, left)), found))


def with_spans(docs: DataFrame, chains: Chains | None, base: str, method: str) -> DataFrame:
    """docs with two more columns: the base spans and the chains' spans, each an array of (start, rank of KINDS, end), by start."""
    text = F.coalesce("text", F.lit(""))
    none = F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,value:int>>)")
    # A quick scan first; positions are worked out for texts with a match only.
    found = [F.when(text.rlike(p), _found(text, p, kind, group)).otherwise(none) for p, kind, group in ((KEYED, "assign", 4),)]
    found += [F.when(text.rlike(quick), _found(text, p, kind)).otherwise(none) for p, quick, kind in ((ACCESS, "AKIA[A-Z0-9]{16}", "access"), (rf"{HEX[:-1]}{{{LEAST['hex']},}}", rf"{HEX[:-1]}{{{LEAST['hex']}}}", "hex"))]
    out = docs.withColumn(base, F.array_sort(_bare(F.concat(*found))))
    if chains is None:
        return out.withColumn(method, F.expr(NONE))
    return out.withColumn(method, F.when(text.rlike(RUN), _method(text, chains, F.col(f"`{base}`"))).otherwise(F.expr(NONE)))


def scan(docs: DataFrame, chains: Chains | None = None) -> DataFrame:
    """One row per document: doc_id, base and more (arrays of (start, rank, end)); chains are trained on docs' samples unless given."""
    chains = chains or Chains.train(samples(docs))
    return with_spans(docs.select("doc_id", "text"), chains, "base", "more").select("doc_id", "base", "more")


def named(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points), out of its pieces of PIECE code points; a place in a long text is found without reading what is before it."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    at = (start - first * PIECE + 1).cast("int")
    inside = F.get(pieces, first).substr(at, (end - start).cast("int"))
    middle = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.get(pieces, first).substr(at, F.lit(PIECE)), middle, F.get(pieces, last).substr(F.lit(1), (end - last * PIECE).cast("int")))
    return F.when(end <= start, "").when(first == last, inside).otherwise(across)


def _upto(ends: Column) -> Column:
    """For each place the greatest of the ends up to it, block by block as in _spans()."""
    last = F.floor((F.size(ends) - 1) / BLOCK).cast("int")
    most = F.transform(F.sequence(F.lit(0), last), lambda b: F.array_max(F.slice(ends, b * BLOCK + 1, F.lit(BLOCK))))
    before = F.aggregate(most, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), x))))

    def place(i: Column, before: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.greatest(F.element_at(before, block + 1), F.array_max(F.slice(ends, block * BLOCK + 1, i % BLOCK + 1)))

    return _let(before, lambda m: F.transform(ends, lambda _, i: place(i, m)))


def _marked(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of its spans (in order of start); of those that overlap or touch, one mark."""
    def filled(pieces: Column, upto: Column) -> Column:
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0).cast("long"))
        kept = F.transform(spans, lambda s, i: F.when((i == 0) | (s["start"] > before(i)), F.concat(_cut(pieces, before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), _cut(pieces, F.element_at(upto, -1), F.length(text).cast("long")))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(pieces, lambda p: _let(_let(F.transform(spans, lambda s: s["end"]), _upto), lambda e: filled(p, e)))


def redact(docs: DataFrame, chains: Chains | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with mark in place of every span (n_chars follows where there is such a column)."""
    chains = chains or Chains.train(samples(docs))
    free = lambda name: name if name not in docs.columns else free(f"{name}_")
    base, method, redacted = map(free, ("base_spans", "more_spans", "redacted_text"))
    out = with_spans(docs, chains, base, method)
    spans = F.array_sort(F.concat(base, method))
    text = F.when(F.size(base) + F.size(method) > 0, _let(spans, lambda j: _marked(F.col("text"), j, mark))).otherwise(F.col("text"))
    out = out.withColumn(redacted, text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(base) + F.size(method) > 0, F.length(redacted)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col(redacted)).drop(base, method, redacted)
