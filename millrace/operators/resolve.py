"""Entity resolution in tiers, in phrases, by type words, and suggestions.

identifiers: entity_id, field, value. phrases: phrase, entity_id, as type_phrases() and category_phrases() give them. places: entity_id,
is_line, line (the line number of the line itself, or of the line that the item is on). Queries are rows, so any number of them is
resolved at once: all tiers are worked out by equi-joins on normalized forms, and the best one per query wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import similar
from millrace.plans.storage import keep

#: Confidence of each tier, best first.
TIERS = {"exact_tag": 1.0, "tag_case_insensitive": 0.98, "proteus_id": 0.98, "identifier": 0.95, "embedded_identifier": 0.9, "type": 0.8}
#: Words that are no identifier by themselves, and those that ask for a set.
STOPWORDS = ("a", "an", "the", "of", "on", "in", "at", "to", "and", "or", "for", "with", "from", "is", "are", "what", "which", "please", "list", "show", "find", "me", "all", "every", "each", "any")
QUANTIFIERS = ("all", "every", "each", "any")
#: Phrases that name a category.
CATEGORY_WORDS = {"equipment": ["equipment"], "piping_component": ["piping component"], "instrumentation": ["instrumentation", "instrument"], "piping_line": ["line"]}
#: Words in a run, letters of an abbreviation, least similarity and number of suggestions.
LONGEST, ABBREVIATION = 3, 4
LEAST_RATIO, MOST_SUGGESTIONS = 0.75, 5
#: Queries that are compared with all identifiers at a time.
QUERY_BLOCK = 2000
#: Names that one step compares with a query; tasks for each core, over all blocks of queries.
NAME_BLOCK, TASKS_A_CORE = 8192, 4
#: Longest name whose common subsequence is worked out in one machine word; longer ones go by the characters in common.
WORD = 64


@dataclass
class Catalogue:
    identifiers: DataFrame
    phrases: DataFrame
    places: DataFrame


def resolve(queries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """queries: query. One row per match of the best tier: query, entity_id, tier, confidence, ambiguous. Tiers from exact tag to normalized identifier."""
    q = queries.select("query").distinct()
    tag, ids = identifiers.where("field = 'tag'"), identifiers.where("field = 'id'")
    norm = text.normalize_identifier
    tiers = [
        ("exact_tag", q.join(tag, q["query"] == tag["value"])),
        ("tag_case_insensitive", q.join(tag, F.lower(q["query"]) == F.lower(tag["value"]))),
        ("proteus_id", q.join(ids, F.lower(q["query"]) == F.lower(ids["value"]))),
        ("identifier", q.join(identifiers, norm(q["query"]) == norm(identifiers["value"])).where(F.length(norm(F.col("query"))) >= 2)),
    ]
    found = None
    for rank, (name, rows) in enumerate(tiers):
        rows = rows.select("query", "entity_id", F.lit(rank).alias("rank"), F.lit(name).alias("tier"), F.lit(TIERS[name]).alias("confidence")).distinct()
        found = rows if found is None else found.unionByName(rows)
    return best(found)


def best(found: DataFrame) -> DataFrame:
    """Keeps each query's best tier and says whether it names several entities."""
    own = Window.partitionBy("query")
    out = found.withColumn("least", F.min("rank").over(own)).where("rank = least")
    return out.withColumn("ambiguous", F.count(F.lit(1)).over(own) > 1).select("query", "entity_id", "tier", "confidence", "ambiguous")


def type_phrases(types: DataFrame) -> DataFrame:
    """types: entity_id, type. phrase, entity_id: every run of words of the type's name, in the singular."""
    words = F.transform(text.camel_tokens(F.col("type")), text.singular)
    each = types.select("entity_id", words.alias("w")).where("size(w) > 0")
    starts = each.select("entity_id", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("entity_id", "w", "i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("i") + 1)).alias("n"))
    return runs.select(F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("phrase"), "entity_id").distinct()


def category_phrases(entities: DataFrame) -> DataFrame:
    """entities: entity_id, category. phrase, entity_id."""
    known = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in CATEGORY_WORDS.items() for x in kv))
    return entities.select(F.explode(F.element_at(known, F.col("category"))).alias("phrase"), "entity_id")


def expanded(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """words: word. word, full: the type word that it abbreviates, if it begins exactly one; else the word itself."""
    known = phrases.select(F.explode(F.split("phrase", " ")).alias("full")).distinct()
    start = lambda c: F.substring(c, 1, ABBREVIATION)
    own = words.select("word").distinct()
    short = own.join(known, own["word"] == known["full"], "left_anti").where(F.length("word") >= ABBREVIATION)
    hits = short.join(known, (start(short["word"]) == start(known["full"])) & known["full"].startswith(short["word"]))
    only = hits.groupBy("word").agg(F.count(F.lit(1)).alias("k"), F.first("full").alias("full")).where("k = 1").drop("k")
    return own.join(only, "word", "left").select("word", F.coalesce("full", "word").alias("full"))


def types_named(names: DataFrame, phrases: DataFrame) -> DataFrame:
    """names: name, a type as anyone writes it (globe valve, GlobeValve, globe_valves). name, phrase (null if there is none such)."""
    words = F.transform(text.camel_tokens(F.replace(F.col("name"), F.lit("_"), F.lit(" "))), text.singular)
    each = names.select("name").distinct().select("name", F.posexplode(words).alias("pos", "word"))
    full = each.join(expanded(each, phrases), "word").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "full"))), lambda x: x["full"]), " ").alias("phrase"))
    known = phrases.select("phrase").distinct()
    hit = full.join(known, "phrase")
    return names.select("name").distinct().join(hit, "name", "left").select("name", "phrase")


def _runs(tokens: DataFrame) -> DataFrame:
    """tokens: query, w (words). query, i (first word, from 1), n (words), run (array)."""
    starts = tokens.where("size(w) > 0").select("query", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    runs = starts.select("query", "w", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size("w") - F.col("i") + 1))).alias("n"))
    return runs.select("query", "i", "n", F.slice("w", F.col("i"), F.col("n")).alias("run"))


def _apart(hits: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """Of runs (query, i, n, name), the longest first and without overlap; taken: runs (query, i, n) that hold their words already."""
    span = F.struct((-F.col("n")).alias("order"), "i", "n", "name")
    spans = hits.groupBy("query").agg(F.array_sort(F.collect_set(span)).alias("spans"))
    none = F.expr("cast(array() as array<struct<order:int,i:int,n:int,name:string>>)")
    if taken is not None:
        held = taken.groupBy("query").agg(F.collect_set(F.struct((-F.col("n")).alias("order"), "i", "n", F.lit("").alias("name"))).alias("held"))
        spans = spans.join(held, "query", "left").withColumn("held", F.coalesce("held", none))
    else:
        spans = spans.withColumn("held", none)
    meets = lambda a, b: (a["i"] < b["i"] + b["n"]) & (b["i"] < a["i"] + a["n"])
    kept = F.aggregate("spans", F.col("held"), lambda acc, s: F.when(F.exists(acc, lambda a: meets(a, s)), acc).otherwise(F.concat(acc, F.array(s))))
    return spans.select("query", F.explode(F.slice(kept, F.size("held") + 1, F.greatest(F.size(kept) - F.size("held"), F.lit(0)))).alias("s")).select("query", "s.i", "s.n", "s.name")


def _words(queries: DataFrame) -> DataFrame:
    return queries.select("query").distinct().select("query", text.identifier_tokens(F.col("query")).alias("w"))


def spot_types(queries: DataFrame, phrases: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """query, i, n, phrase: type phrases among a query's words that are not taken, longest first, without overlap."""
    each = _words(queries).select("query", F.posexplode("w").alias("pos", "raw")).withColumn("word", text.singular(F.lower("raw")))
    full = each.join(expanded(each, phrases), "word").groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "full"))), lambda x: x["full"]).alias("w"))
    runs = _runs(full).select("query", "i", "n", F.array_join("run", " ").alias("name"))
    hits = runs.join(phrases.select(F.col("phrase").alias("name")).distinct(), "name")
    return _apart(hits, taken).withColumnRenamed("name", "phrase")


def embedded(queries: DataFrame, known: Catalogue) -> DataFrame:
    """Identifiers inside a phrase, in the light of its other words: query, entity_id, tier, confidence, ambiguous, warnings.

    Runs of up to three words that are identifiers, longest first, are the query's terms. A line's number beside other terms narrows
    them to the items on it, or, where one has none there, all are returned with a warning. A line's number alone with a type names
    the items of that type on it. Other type words narrow what was found, or are warned of.
    """
    runs = _runs(_words(queries)).where((F.col("n") > 1) | ~F.lower(F.element_at("run", 1)).isin(*STOPWORDS))
    runs = runs.select("query", "i", "n", text.normalize_identifier(F.array_join("run", "")).alias("name")).where("length(name) >= 2")
    names = known.identifiers.select(text.normalize_identifier(F.col("value")).alias("name"), "entity_id").distinct()
    # Each step is written and read again: all that follows reads it several times.
    terms = keep(_apart(runs.join(names.select("name").distinct(), "name")), "terms")
    hits = terms.join(names, "name").join(known.places, "entity_id", "left").withColumn("is_line", F.coalesce("is_line", F.lit(False)))
    term, query = Window.partitionBy("query", "i"), Window.partitionBy("query")
    # Terms of lines only, and of items; whether each term of items has one on the lines that are named.
    hits = hits.withColumn("of_lines", F.min("is_line").over(term))
    hits = hits.withColumns({"lines": F.max("of_lines").over(query), "items": ~F.min("of_lines").over(query), "numbers": F.collect_set(F.when(F.col("of_lines"), F.col("line"))).over(query)})
    hits = hits.withColumns({"both": F.col("lines") & F.col("items"), "on": F.coalesce(F.array_contains("numbers", F.col("line")), F.lit(False))})
    hits = hits.withColumn("some", F.max("on").over(term)).withColumn("narrows", F.col("both") & F.min(F.col("of_lines") | F.col("some")).over(query))
    hits = hits.where(~F.col("narrows") | (~F.col("of_lines") & F.col("on")))
    hits = hits.select("query", "i", "entity_id", "items", "both", "narrows", "numbers").distinct().withColumn("k", F.count(F.lit(1)).over(term))
    mixed = F.when(F.col("both") & ~F.col("narrows"), F.lit("the line and the other identifiers name no common item; all are given"))
    found = hits.withColumn("ambiguous", F.max("k").over(query) > 1).groupBy("query", "entity_id").agg(*(F.first(c).alias(c) for c in ("items", "both", "numbers", "ambiguous")), F.first(mixed).alias("mixed"))
    found = keep(found, "found")

    spare = keep(spot_types(queries, known.phrases, terms).join(terms.select("query").distinct(), "query", "left_semi"), "spare")
    members = known.phrases.join(known.places, "entity_id", "left").withColumn("is_line", F.coalesce("is_line", F.lit(False)))
    # A line's number with a type.
    alone = found.where(~F.col("items")).select("query", F.explode("numbers").alias("line")).distinct()
    items = alone.join(spare, "query").join(members.where(~F.col("is_line")), ["phrase", "line"]).select("query", "entity_id").distinct()
    items = keep(items, "items").withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("query")) > 1).withColumn("warnings", F.expr("cast(array() as array<string>)"))
    rest = keep(found.join(items.select("query").distinct(), "query", "left_anti"), "rest")
    # Other type words, in their order: each keeps the matches that fit it, if any do.
    of_lines = members.groupBy("phrase").agg(F.bool_and("is_line").alias("all_lines"))
    own = rest.groupBy("query").agg(F.sort_array(F.collect_set("entity_id")).alias("matches"), F.first("both").alias("both"), F.first("mixed").alias("mixed"), F.first("ambiguous").alias("ambiguous"))
    words = spare.join(own.select("query", "both"), "query").join(of_lines, "phrase").where(~(F.col("both") & F.col("all_lines")))
    fit = words.join(rest.select("query", "entity_id"), "query").join(known.phrases.withColumn("fits", F.lit(True)), ["phrase", "entity_id"], "left")
    fit = fit.groupBy("query", "i", "phrase").agg(F.sort_array(F.collect_set(F.when(F.col("fits"), F.col("entity_id")))).alias("ids")).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("i", "phrase", "ids"))).alias("steps"))
    state = F.struct(F.col("matches").alias("matches"), F.expr("cast(array() as array<string>)").alias("odd"))

    def narrow(acc: Column, step: Column) -> Column:
        left = F.array_intersect(acc["matches"], step["ids"])
        odd = F.concat(acc["odd"], F.array(F.concat(F.lit("no match is of type "), step["phrase"])))
        return F.when(F.size(left) > 0, F.struct(left.alias("matches"), acc["odd"].alias("odd"))).otherwise(F.struct(acc["matches"].alias("matches"), odd.alias("odd")))

    own = own.join(fit, "query", "left").withColumn("steps", F.coalesce("steps", F.expr("cast(array() as array<struct<i:int,phrase:string,ids:array<string>>>)")))
    own = own.withColumn("end", F.aggregate("steps", state, narrow))
    narrowed = own.select("query", F.explode("end.matches").alias("entity_id"), (F.col("ambiguous") & (F.size("end.matches") > 1)).alias("ambiguous"), F.concat(F.array_compact(F.array("mixed")), "end.odd").alias("warnings"))
    out = narrowed.unionByName(items)
    return out.select("query", "entity_id", F.lit("embedded_identifier").alias("tier"), F.lit(TIERS["embedded_identifier"]).alias("confidence"), "ambiguous", "warnings")


def resolve_types(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """queries: query, phrase (one row per phrase of the query). Entities that fit all phrases, or if there are none, any: query, entity_id, tier, confidence, ambiguous."""
    n = queries.groupBy("query").agg(F.count_distinct("phrase").alias("wanted"))
    hits = queries.distinct().join(phrases, "phrase").groupBy("query", "entity_id").agg(F.count(F.lit(1)).alias("fit")).join(n, "query")
    own = Window.partitionBy("query")
    hits = hits.withColumn("all", F.max(F.col("fit") == F.col("wanted")).over(own)).where(~F.col("all") | (F.col("fit") == F.col("wanted")))
    return hits.select("query", "entity_id", F.lit("type").alias("tier"), F.lit(TIERS["type"]).alias("confidence"), (F.count(F.lit(1)).over(own) > 1).alias("ambiguous"))


def by_type(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """Queries that describe what they ask for by type words: query, entity_id, tier, confidence, ambiguous, warnings.

    A plural type word or a quantifier asks for a set, which is not ambiguous; words that mean nothing here are warned of and leave it so.
    """
    spots = keep(spot_types(queries, phrases), "spots")
    found = resolve_types(spots.select("query", "phrase"), phrases)
    each = _words(queries).select("query", F.posexplode("w").alias("pos", "raw")).withColumn("low", F.lower("raw")).withColumn("one", text.singular(F.col("low")))
    single = phrases.select(F.col("phrase").alias("one")).where("not contains(phrase, ' ')").distinct().withColumn("known", F.lit(True))
    covered = spots.select("query", F.explode(F.sequence(F.col("i") - 1, F.col("i") + F.col("n") - 2)).alias("pos")).withColumn("held", F.lit(True))
    each = each.join(single, "one", "left").join(covered, ["query", "pos"], "left")
    plural = F.coalesce(F.col("known"), F.lit(False)) & (F.col("one") != F.col("low"))
    strange = F.when(F.col("held").isNull() & F.col("known").isNull() & ~F.col("low").isin(*STOPWORDS), F.struct("pos", "raw"))
    told = each.groupBy("query").agg(F.bool_or(F.col("low").isin(*QUANTIFIERS) | plural).alias("set"), F.transform(F.array_sort(F.collect_list(strange)), lambda x: x["raw"]).alias("strange"))
    out = found.join(told, "query", "left")
    warnings = F.when(F.size("strange") > 0, F.array(F.concat(F.lit("words without a meaning here: "), F.array_join("strange", ", ")))).otherwise(F.expr("cast(array() as array<string>)"))
    return out.select("query", "entity_id", "tier", "confidence", (F.col("ambiguous") & (~F.col("set") | (F.size("strange") > 0))).alias("ambiguous"), warnings.alias("warnings"))


def resolve_all(queries: DataFrame, known: Catalogue) -> DataFrame:
    """All tiers of all queries: query, entity_id, tier, confidence, ambiguous, warnings. A query without a match has no row."""
    none = F.expr("cast(array() as array<string>)")
    own = queries.select("query").distinct()
    out = keep(resolve(own, known.identifiers).withColumn("warnings", none), "matches")
    # What one tier resolves, the next ones need not look at.
    for tier in (lambda q: embedded(q, known), lambda q: by_type(q, known.phrases)):
        left = own.join(out.select("query").distinct(), "query", "left_anti")
        if left.isEmpty():
            break
        out = out.unionByName(keep(tier(left), "matches"))
    return out


def suggestions(queries: DataFrame, identifiers: DataFrame, most: int = MOST_SUGGESTIONS, join: bool = False) -> DataFrame:
    """query, entity_id, score, nth: the identifiers nearest to the query, or to a word of it with a digit, by matching-block ratio, LEAST_RATIO or more. They never bind.

    Names of many entities are compared once, for as many of these as can be suggested. The queries, in blocks of QUERY_BLOCK, are sent to all tasks; a task compares
    them with the names that it reads and passes on the best few of each query, so no pairs are shuffled. The longest common subsequence bounds the ratio from above; it is
    worked out for thousands of names at a time, and queries in order share what their beginnings have in common. Only what can still be among the best is compared in
    full. With join, queries and identifiers meet by rare parts instead (similar.nearest), with the same result: for many
    queries and names that differ. Where most names are alike, as numbers behind one word, most pairs meet, and the scan is faster.
    """
    spark = queries.sparkSession
    norm = text.normalize_identifier
    digits = F.regexp_extract_all("query", F.lit(r"(\S*\d\S*)"), F.lit(1))
    wanted = queries.select("query").distinct().select("query", F.array_distinct(F.filter(F.transform(F.concat(F.array("query"), digits), norm), lambda x: x != "")).alias("forms")).where("size(forms) > 0")
    own = identifiers.select("entity_id", norm(F.col("value")).alias("key")).where("key <> ''")
    if join:
        return similar.nearest(wanted.select("query", F.explode("forms").alias("form")), own, most, LEAST_RATIO)
    n_blocks = -(-wanted.count() // QUERY_BLOCK)
    # Entities of one name have one ratio: the first few of each name hold all that it can add to the best.
    first = F.row_number().over(Window.partitionBy("key").orderBy("entity_id"))
    names = own.distinct().withColumn("nth", first).where(F.col("nth") <= most).groupBy("key").agg(F.array_sort(F.collect_list("entity_id")).alias("entities"))
    n_tasks = max(1, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // max(1, n_blocks)))
    names = keep(names, "names").repartition(n_tasks, "key")
    out = None
    for k in range(n_blocks):
        part = wanted.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == k) if n_blocks > 1 else wanted
        block = spark.sparkContext.broadcast([(r["query"], list(r["forms"])) for r in part.collect()])

        def run(batches, block=block):
            yield from _nearest(batches, block.value, most)

        found = names.mapInArrow(run, "query string, entity_id string, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = own.select(F.lit("").alias("query"), "entity_id", F.lit(0.0).alias("score")).where("1 = 0")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "entity_id"))
    return out.groupBy("query", "entity_id").agg(F.max("score").alias("score")).withColumn("nth", nth).where(F.col("nth") <= most).withColumn("score", F.round("score", 3))


class _Names:
    """A block of names as bits: for each character the places where a name has it."""

    def __init__(self, keys: list[str], entities: list[list[str]]):
        import numpy as np

        order = sorted(range(len(keys)), key=lambda j: entities[j][0])
        self.keys, self.entities = [keys[j] for j in order], [entities[j] for j in order]
        self.size = np.array([len(k) for k in self.keys], np.float32)
        self.long, self.alike = bool(self.size.max() > WORD), bool(self.size.max() == self.size.min())
        if self.long:
            self.counts = np.zeros((36, len(self.keys)), np.int16)
            for j, key in enumerate(self.keys):
                for c in key:
                    self.counts[_letter(c), j] += 1
            return
        kind = np.uint32 if self.size.max() <= 32 else np.uint64
        code = np.array(self.keys, "S").view(np.uint8).reshape(len(self.keys), -1)
        letter = np.where(code >= 97, code - 87, code - 48)
        self.at = np.zeros((36, len(self.keys)), kind)
        row = np.arange(len(self.keys))
        for place in range(code.shape[1]):
            there = row[code[:, place] > 0]
            self.at[letter[there, place], there] |= kind(1 << place)
        self.known, self.steps = "", [np.full(len(self.keys), ~kind(0), kind)]
        self.u, self.v = np.empty(len(self.keys), kind), np.empty(len(self.keys), kind)

    def common(self, form: str):
        """For each name, no less than the characters that matching blocks can have: those of the longest common subsequence, or those in common in any order."""
        import numpy as np

        if self.long:
            have = np.zeros(36, np.int16)
            for c in form:
                have[_letter(c)] += 1
            return np.minimum(self.counts, have[:, None]).sum(0)
        same = 0
        while same < min(len(form), len(self.known)) and form[same] == self.known[same]:
            same += 1
        del self.steps[same + 1 :]
        for c in form[same:]:
            s, u, v = self.steps[-1], self.u, self.v
            np.bitwise_and(s, self.at[_letter(c)], out=u)
            np.add(s, u, out=v)
            np.subtract(s, u, out=u)
            self.steps.append(v | u)
        self.known = form
        return np.bitwise_count(~self.steps[-1])


def _letter(c: str) -> int:
    return ord(c) - (87 if c >= "a" else 48)


class _Best:
    """The best entities of one query so far."""

    def __init__(self, most: int):
        self.most, self.score, self.least, self.last = most, {}, LEAST_RATIO, None

    def open(self, bound: float, entity: str) -> bool:
        """Whether an entity of at most this score can be among the best."""
        return bound > self.least + 1e-9 or (bound >= self.least - 1e-9 and (self.last is None or entity <= self.last))

    def add(self, entities: list[str], score: float) -> None:
        if score < LEAST_RATIO:
            return
        for e in entities:
            self.score[e] = max(score, self.score.get(e, 0.0))
        if len(self.score) >= self.most:
            kept = sorted(self.score.items(), key=lambda x: (-x[1], x[0]))[: self.most]
            self.score, (self.last, self.least) = dict(kept), kept[-1]


def _nearest(batches, queries: list[tuple[str, list[str]]], most: int):
    """Each query's best entities among the batches' names."""
    from difflib import SequenceMatcher

    import numpy as np

    forms = sorted((f, i) for i, (_, all_) in enumerate(queries) for f in all_)
    top = [_Best(most) for _ in queries]
    matcher = SequenceMatcher(None)

    def compare(names: _Names) -> None:
        share = {n: np.float32(2) / (names.size + np.float32(n)) for n in {len(f) for f, _ in forms}}
        bound = np.empty(len(names.keys), np.float32)
        for form, i in forms:
            best, per = top[i], share[len(form)]
            np.multiply(names.common(form), per, out=bound, casting="unsafe")
            # Single precision: what rounding may have moved is looked at again.
            at = np.flatnonzero(bound >= best.least - 1e-6)
            if best.last is None and len(at) > 8 * most:
                # The likeliest first, so that few of the others are left.
                at = at[np.argpartition(-bound[at], 4 * most)[: 4 * most]]
                judge(names, form, best, bound, at)
                rest = bound >= best.least - 1e-6
                rest[at] = False
                at = np.flatnonzero(rest)
            if len(at):
                judge(names, form, best, bound, at)

    def judge(names: _Names, form: str, best: _Best, bound, at) -> None:
        """In order of bounds, and of entities where these are the same."""
        for j in at[np.lexsort((at, -bound[at]))].tolist():
            if bound[j] < best.least - 1e-6:
                break
            size = len(names.keys[j]) + len(form)
            if best.open(2 * round(float(bound[j]) * size / 2) / size, names.entities[j][0]):
                matcher.set_seqs(form, names.keys[j])
                best.add(names.entities[j], matcher.ratio())
            elif names.alike:
                break  # all that follow have the same bound and a later entity, or a lower bound

    held: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
    for batch in batches:
        for key, entities in zip(batch["key"].to_pylist(), batch["entities"].to_pylist(), strict=True):
            keys, of = held[len(key) > WORD]
            keys.append(key)
            of.append(entities)
            if len(keys) == NAME_BLOCK:
                compare(_Names(keys, of))
                held[len(key) > WORD] = ([], [])
    for keys, of in held.values():
        if keys:
            compare(_Names(keys, of))
    rows = [(queries[i][0], e, s) for i, best in enumerate(top) for e, s in sorted(best.score.items(), key=lambda x: (-x[1], x[0]))[:most]]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["query", "entity_id", "score"])
