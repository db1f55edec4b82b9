"""Names that are nearly alike, as a similarity join: two names meet only if they share a rare part early enough.

Names are runs of a-z and 0-9. The ratio of two names is 2 * m / (a + b), for m characters in matching blocks and lengths a and b. A ratio of
r or more thus needs

- lengths that differ by (2 - r) / r times at most,
- m = r * (a + b) / 2 characters in common, counted with repeats, and
- 3 * m - (a + b) - 1 pairs of neighbours in common: every gap between two blocks holds a character that matches nothing, so blocks are one more than
  those characters at most, and each block has one pair less than characters.

Each name's parts (pairs; single characters where no pair must be shared) are put in one order, the rarest first. Where n of a name's parts must be
shared, the first shared one stands so early that n - 1 parts are left behind it, in either name. Only those early parts are join keys, together with a class
of length, and what meets by them is compared in full.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.storage import keep

ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Ratios that are tried before the least one: a query that has its fill of names above one of them is done.
LEVELS = (0.9, 0.8)
#: Lengths that differ by less than this factor are of one class.
CLASS = 1.2
TINY = 1e-9


def nearest(wanted: DataFrame, names: DataFrame, most: int, least: float) -> DataFrame:
    """query, entity_id, score, nth: each query's best entities with a ratio of least or more, equal ones by entity_id.

    wanted: query, form (several to a query). names: entity_id, key (several to an entity). Neither side is collected or broadcast by this function; keys that
    many entities have meet the forms once. Null and empty forms and keys match nothing; empty tables give no rows.
    """
    # Of the entities with one key only the first ones can be among the best.
    first = F.row_number().over(Window.partitionBy("key").orderBy("entity_id"))
    owners = keep(names.where("key <> ''").select("entity_id", "key").distinct().withColumn("nth", first).where(F.col("nth") <= most).drop("nth"), "owners")
    keys = owners.select("key").distinct()
    forms = keep(wanted.where("form <> ''").select("query", "form").distinct(), "forms")
    order, out, left = _rarity(keys), None, forms
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entity_id")
    for level in (*(x for x in LEVELS if x > least), least):
        scored = compare(candidates(left.select("form").distinct(), keys, level, order), level)
        rows = left.join(scored, "form").join(owners, "key").groupBy("query", "entity_id").agg(F.max("score").alias("score"))
        found = keep(rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most), "nearest")
        full = found.where(F.col("nth") == most).select("query")
        done = found if level == least else found.join(full, "query", "left_semi")
        out = done if out is None else out.unionByName(done)
        if level > least:
            left = keep(left.join(full, "query", "left_anti"), "forms")
            if left.isEmpty():
                break
    return out.select("query", "entity_id", F.round("score", 3).alias("score"), "nth")


def candidates(forms: DataFrame, keys: DataFrame, least: float, order: dict[int, list[int]] | None = None) -> DataFrame:
    """form, key: all pairs that may have a ratio of least or more, once each. forms: form. keys: key."""
    order = order or _rarity(keys)
    a, b = _early(forms, "form", least, order), _early(keys, "key", least, order)
    widest = (2 - least) / least
    classes = F.sequence(_class(F.greatest(F.lit(1), F.ceil(F.col("form_size") / widest - TINY))), _class(F.floor(F.col("form_size") * widest + TINY)))
    a = a.select("*", F.explode(classes).alias("class"))
    b = b.withColumn("class", _class(F.col("key_size")))
    total = F.col("form_size") + F.col("key_size")
    shared = F.ceil(total * (least / 2) - TINY)
    pairs = 3 * shared - total - 1
    need = F.when(F.col("n") == 2, pairs).otherwise(shared)
    right = (F.col("n") == 2) == (pairs >= 1)
    early = lambda side: F.col(f"{side}_at") <= F.col(f"{side}_size") - F.col("n") + 1 - need
    return a.join(b, ["n", "token", "class"]).where(right & early("form") & early("key")).select("form", "key").distinct()


def compare(pairs: DataFrame, least: float) -> DataFrame:
    """form, key, score of the pairs whose ratio is least or more."""

    def run(batches):
        from difflib import SequenceMatcher

        matcher = SequenceMatcher(None)
        for batch in batches:
            forms, keys, scores = [], [], []
            for form, key in zip(batch["form"].to_pylist(), batch["key"].to_pylist(), strict=True):
                matcher.set_seqs(form, key)
                if matcher.quick_ratio() >= least and (score := matcher.ratio()) >= least:
                    forms.append(form)
                    keys.append(key)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.string()), pa.array(keys, pa.string()), pa.array(scores, pa.float64())], ["form", "key", "score"])

    # Pairs are few bytes and much work, so they are dealt to all cores instead of being put together by their bytes.
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(tasks, "form", "key").mapInArrow(run, "form string, key string, score double")


def _class(size: Column) -> Column:
    return F.floor(F.log(CLASS, size.cast("double")) + TINY)


def _parts(name: str, n: int) -> Column:
    """All stretches of n characters of a column."""
    size = F.length(name)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col(name), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _place(part: Column, n: int) -> Column:
    """A part's number among all that the alphabet allows."""
    out = F.lit(0)
    for i in range(n):
        out = out * len(ALPHABET) + F.call_function("instr", F.lit(ALPHABET), F.substring(part, i + 1, 1)) - 1
    return out


def _rarity(keys: DataFrame) -> dict[int, list[int]]:
    """How often each single character and each pair occurs: 36 and 1296 counts, whatever the number of names."""
    numbered = lambda n: F.transform(_parts("key", n), lambda p: F.struct(F.lit(n).alias("n"), _place(p, n).alias("place")))
    both = F.concat(numbered(1), numbered(2))
    out = {n: [0] * len(ALPHABET) ** n for n in (1, 2)}
    for r in keys.select(F.explode(both).alias("p")).groupBy("p").count().collect():
        out[r.p.n][r.p.place] = r["count"]
    return out


def _tokens(name: str, n: int, order: list[int]) -> Column:
    """A column's parts of n characters, each with the number of its kind, the rarest first."""
    parts = _parts(name, n)
    counts = F.split(F.lit(",".join(map(str, order))), ",").cast("array<bigint>")
    kinds = F.transform(F.array_distinct(parts), lambda p: F.struct(F.get(counts, _place(p, n).cast("int")).alias("count"), p.alias("part"), F.size(F.filter(parts, lambda q: q == p)).alias("times")))
    # Times may differ between two names, so it must not decide the order; count and part do, as they come first.
    return F.flatten(F.transform(F.array_sort(kinds), lambda k: F.transform(F.sequence(k["times"], F.lit(1), F.lit(-1)), lambda i: F.concat(k["part"], F.lit(":"), i.cast("string")))))


def _early(names: DataFrame, name: str, least: float, order: dict[int, list[int]]) -> DataFrame:
    """A row per part that can be a pair's first shared one: the name, its size, n (characters in the part), token (the part and which of its kind), at (from 0)."""
    size = F.length(name)
    # The two lengths together, where the other name is as short as it may be.
    total = size + F.ceil(size * (least / (2 - least)) - TINY)
    rows = []
    for n in (1, 2):
        tokens = _tokens(name, n, order[n])
        need = total * (least / 2) if n == 1 else total * (1.5 * least - 1) - 1
        until = size - n + 2 - F.greatest(F.lit(1), F.ceil(need - TINY))
        # Single characters are asked for only where the two names may be too short to have to share a pair.
        possible = (total * (1.5 * least - 1) < 2 + TINY) if n == 1 else size >= 2
        ok = possible & (until >= 1)
        early = names.where(ok).select(name, size.alias(f"{name}_size"), F.lit(n).alias("n"), F.posexplode(F.slice(tokens, F.lit(1), until.cast("int"))).alias(f"{name}_at", "token"))
        rows.append(early)
    return rows[0].unionByName(rows[1])
