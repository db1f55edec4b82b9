"""License scans in DataFrame operations alone: MinHash bands over overlapping text windows, then exact containment.

A text's words give shingles of five; each window is WINDOW shingles in a row, and every shingle stands in WINDOW of them (fillers
stand before the first and behind the last). A window's minima of BANDS hash functions, one to a band, are looked up among those
of the templates' windows. A shingle is its window's minimum of one function with probability 1/WINDOW at least, so no window that holds
a template's shingle meets the template's minimum with a probability of (1 - 1/WINDOW)^(BANDS * WINDOW), 5 in 10 million; longer matches
are surer.

Windows that meet a template are all that leaves the scan. Their shingles are then
compared exactly: a match is a place no longer than twice the template that holds CONTAINED of the template's distinct shingles,
wherever it begins. A shingle counts in the places that begin behind its last occurrence and reach it; so the count of all places is a
running sum over the ends of those stretches, and no place is counted one by one.

Templates are given as a list. Their minima, of BLOCK template words at a time, are a broadcast table of some 12 rows a word at most, and every window
looks its own up in it: one scan for hundreds of whole licenses. Nothing grows with the documents but the scan itself.

Defined cases: null texts and texts of fewer than five words match nothing; templates of fewer than five words are one shorter shingle
and are refused; rows that repeat doc_id and text count once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import keep
from millrace.llm.notices import NOTICES

SHINGLE = 5
WINDOW = 3
BANDS = 12
CONTAINED = 80
#: Template words in one scan: at most 2.4 million minima, some 100 MB, in the broadcast table.
BLOCK = 200_000


def read_templates(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, text) of every file in a folder of license texts, to be scanned for beside or instead of NOTICES."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value").collect()
    return sorted((r.name, r.value) for r in rows)


def _shingles(text: Column) -> Column:
    """Hashes of all shingles of the text's words (runs of ASCII letters and digits, lower-cased)."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    bound = F.transform(F.array(hashes), lambda h: F.when(F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))))
    return F.get(bound, F.lit(0))


def _windows(df: DataFrame, shingles: str, *own: str, filler=None) -> DataFrame:
    """A row per window: own columns, pos, s0 to s2. Outside the text stands 0, which is no template's shingle, or else one that the window has."""
    s = F.col(shingles)
    inside = lambda i: F.get(s, F.greatest(F.lit(0), F.least(i, F.size(s) - 1)))
    part = lambda i, k: F.coalesce(F.get(s, i + k) if filler == 0 else inside(i + k), F.lit(0).cast("long")).alias(f"s{k}")
    rows = F.transform(F.sequence(F.lit(1 - WINDOW), F.size(s) - 1), lambda i: F.struct(i.alias("pos"), *(part(i, k) for k in range(WINDOW))))
    # inline() gives plain columns that are never null, so the many hashes of them compile to short code.
    return df.select(*own, F.inline(rows))


def _minimum(band: int) -> Column:
    return F.least(*(F.xxhash64(f"s{k}", F.lit(band)) for k in range(WINDOW)))


def _template_tables(spark: SparkSession, templates: list[tuple[int, str, str]]) -> tuple[DataFrame, DataFrame]:
    """The minima m0, m1 and so on of each of the templates' windows, and (shingle, template, license, size): distinct shingles of each template."""
    df = spark.createDataFrame(templates, "template int, license string, text string").withColumn("s", F.array_distinct(_shingles(F.col("text"))))
    whole = df.select("template", _shingles(F.col("text")).alias("s"))
    minima = _windows(whole, "s", "template").select(*(_minimum(b).alias(f"m{b}") for b in range(BANDS)))
    return minima, df.select("template", "license", F.size("s").alias("size"), F.explode("s").alias("shingle"))


def _met(windows: DataFrame, minima: DataFrame) -> DataFrame:
    """The windows that share a minimum with a template, once for each that they share. A band is part of what is hashed, so minima of all bands are one set."""
    known = keep(minima.select(F.explode(F.array(*minima.columns)).alias("minimum")).distinct(), "minima")
    each = windows.select("*", F.explode(F.array(*(_minimum(b) for b in range(BANDS)))).alias("minimum"))
    return each.join(F.broadcast(known), "minimum", "left_semi").drop("minimum")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = NOTICES, contained: int = CONTAINED) -> DataFrame:
    """One row per document and template found: doc_id, license, template (its number), containment (0 to 1), start_word and end_word of the first best place, n_shingles (of the template)."""
    n_words = [len("".join(c if c.isascii() and c.isalnum() else " " for c in t).split()) for _, t in templates]
    short = [t for (_, t), n in zip(templates, n_words, strict=True) if n < SHINGLE]
    if short:
        raise ValueError(f"a template needs {SHINGLE} words: {short[0]!r}")
    numbered = [(k, name, text) for k, (name, text) in enumerate(templates)]
    blocks, size = [[]], 0
    for t, n in zip(numbered, n_words, strict=True):
        if blocks[-1] and size + n > BLOCK:
            blocks, size = [*blocks, []], 0
        blocks[-1].append(t)
        size += n
    found = [_scan(docs, block, contained) for block in blocks]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _scan(docs: DataFrame, templates: list[tuple[int, str, str]], contained: int) -> DataFrame:
    minima, shingles = _template_tables(docs.sparkSession, templates)
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), _shingles(F.col("text")).alias("s")).where("s is not null")
    near = _met(_windows(own, "s", "doc_id", "row", filler=0), minima)
    each = near.select("doc_id", "row", F.explode(F.array(*(F.struct((F.col("pos") + k).alias("pos"), F.col(f"s{k}").alias("shingle")) for k in range(WINDOW)))).alias("e")).select("doc_id", "row", "e.*")
    # A shingle leaves the scan in up to WINDOW windows. Kept, because what follows reads the few hits again and again, and the texts once.
    hits = keep(each.join(F.broadcast(shingles), "shingle").select("doc_id", "row", "license", "template", "size", "shingle", F.col("pos").cast("long").alias("pos")).distinct(), "hits")
    place = ["doc_id", "row", "license", "template", "size"]
    # Only texts with enough of a template's shingles anywhere: the rest can't have them in one place.
    enough = hits.groupBy(*place).agg(F.count_distinct("shingle").alias("n")).where(100 * F.col("n") >= contained * F.col("size")).select("row", "template")
    hits = hits.join(enough, ["row", "template"], "left_semi")
    last = F.coalesce(F.lag("pos").over(Window.partitionBy("row", "template", "shingle").orderBy("pos")), F.lit(-1 << 40))
    entry = lambda pos, add, begins: F.struct(pos.alias("pos"), F.lit(add).alias("add"), F.lit(begins).alias("begins"))
    ends = F.array(entry(F.greatest(last, F.col("pos") - 2 * F.col("size")) + 1, 1, False), entry(F.col("pos") + 1, -1, False), entry(F.col("pos"), 0, True))
    events = hits.select(*place, ends.alias("ends")).select(*place, F.explode("ends").alias("e")).select(*place, "e.*")
    upto = Window.partitionBy("row", "template").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    good = events.withColumn("n", F.sum("add").over(upto)).where(F.col("begins") & (100 * F.col("n") >= contained * F.col("size")))
    best = good.groupBy(*place).agg(F.max(F.struct("n", (-F.col("pos")).alias("back"))).alias("b")).select(*place, F.col("b.n").alias("n"), (-F.col("b.back")).alias("start"))
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + 2 * F.col("size"))
    out = best.join(hits.select("row", "template", "pos"), ["row", "template"]).where(inside).groupBy(*place, "n", "start").agg(F.max("pos").alias("end"))
    return out.select("doc_id", "license", "template", (F.col("n") / F.col("size")).alias("containment"), F.col("start").alias("start_word"), (F.col("end") + SHINGLE).alias("end_word"), F.col("size").cast("long").alias("n_shingles"))
