"""Whole answers against the evidence of their runs: terms, roles, attributions, relations, live state, citations, and the level of trust.

Texts are read once (see wording.py); everything that is compared with facts is rows and joins, for any number of answers of any number of runs at once. What
is stated in one run is never held against the facts of another.

Relations are looked up in scopes: all facts of a run, or those that a set of citations names. Sentences with the same citations share a scope, so facts are
copied once for each different set. Only pairs that sentences state are searched for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import claims as cl
from millrace.operators import evidence as ev
from millrace.operators import facts as ft
from millrace.operators import graph, grounding, wording
from millrace.plans.storage import keep

OWN = ["run_id", "id"]
AT = [*OWN, "n"]
SENTENCE = (
    "run_id string, id string, n int, text string, refs array<string>, broken array<string>, terms array<struct<term:string,kind:string,at:int,asserted:boolean,minus:boolean>>, "
    "relations array<struct<kind:string,start:int,end:int,passive:boolean>>, roles array<struct<role:string,name:string>>, words array<string>, related boolean, direct boolean, doubts boolean, about_plant boolean, live string"
)
#: What makes an answer wrong, and what leaves it open.
PROBLEMS = ("unsupported", "pairing", "question_only", "ambiguous_identifier", "bad_reference", "contradicted", "identifier_role", "value_attribution", "operating_state", "prompt_disclosure", "structured_claim")
GAPS = ("uncited", "unclear", "unreferenced", "unchecked")
#: What a word before a name says -> the fields of results that hold names of such things.
ROLE_FIELDS = {
    "line": ("linenumber", "lineid"),
    "segment": ("segmentnumber", "segmentid"),
    "component": ("pipingcomponentnumber", "pipingcomponentname", "linecomponent"),
    "nozzle": ("subtag", "subtagname"),
    "chamber": ("chamberid", "chamber", "enteredchamber", "blockedchamber"),
    "connection": ("connection", "blockedconnection"),
}
#: Words that don't tell one property from another.
COMMON_WORDS = ("design", "upper", "lower", "limit", "nominal", "representation", "numerical", "value", "type", "standard", "number", "code")


@dataclass
class Checked:
    """sentences: as SENTENCE. terms: run_id, id, n, term, status. relations: run_id, id, n, relation, a, b, status. notes: run_id, id, n, claim, kind.
    answers: run_id, id, problems, gaps, level, answer (written out if it was citations alone)."""

    sentences: DataFrame
    terms: DataFrame
    relations: DataFrame
    notes: DataFrame
    answers: DataFrame


def read(answers: DataFrame) -> DataFrame:
    """answers: run_id, id, text. A row per sentence of the prose, as SENTENCE."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(SENTENCE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for own in batch.to_pylist():
                for n, s in enumerate(wording.read(own["text"])):
                    row = vars(s) | {"run_id": own["run_id"], "id": own["id"], "n": n}
                    row |= {"terms": list(map(vars, s.terms)), "relations": list(map(vars, s.relations)), "roles": [{"role": r, "name": x} for r, x in s.roles]}
                    rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return answers.select("run_id", F.col("id").cast("string").alias("id"), "text").mapInArrow(run, SENTENCE)


def cites(ref: Column) -> Column:
    """Whether one of refs is this row's, or that of its whole result."""
    return F.coalesce(F.arrays_overlap("refs", F.array(ref, whole_of(ref))), F.lit(False))


def whole_of(ref: str | Column) -> Column:
    """What stands for all rows of a reference's result."""
    return F.concat(F.lit("R"), F.substring_index(F.substring(ref, 2, 99), ".", 1))


def quantity(c: Column, sign: int = 1) -> Column:
    """A number with its unit in one spelling; null for other texts."""
    v = text.parse_value(c)
    said = F.when(v["kind"].isin("quantity", "number"), F.concat(F.lit("="), (v["number"] * sign).cast("string"), F.lit("|"), F.regexp_replace(v["unit"], r"\s+", "")))
    # What begins with none of these is no number, so it is not looked at further.
    return F.when(c.rlike("^ *[0-9.,+-]"), said)


def check(answers: DataFrame, facts: DataFrame, questions: DataFrame | None = None, postings: DataFrame | None = None, rows: DataFrame | None = None, secret: str | None = None) -> Checked:
    """answers: run_id, id, text. facts: as facts.py makes them, with run_id and ref. questions: run_id, id, text. postings and rows: of evidence.py; without postings those of the
    facts are taken; with rows, answers of citations alone are written out. secret: a text that no answer may repeat.

    A term that names one item is supported if a cited fact is about it; a value if a cited fact that carries it is about an item that the sentence names. Statements without citation
    are held against all facts of the run and count as unreferenced. A relation holds if the pair that it states does: flow along pipes and routes, links by their predicate and way
    round. Claims in a block must be entailed; the facts that do so count as cited. Levels: insufficient_evidence (a problem, or nothing supported), ambiguous (a cited lookup was), limited (a gap), grounded.
    """
    answers = answers.select("run_id", F.col("id").cast("string").alias("id"), "text")
    facts = keep(facts.withColumn("fact_id", F.monotonically_increasing_id()), "facts")
    parts, blocks = cl.read_claims(answers)
    prose = parts.select("run_id", "id", F.col("prose").alias("text"), "has_block")
    s = keep(read(prose), "sentences")
    judged = keep(cl.judge(blocks, facts.drop("fact_id")), "judged").withColumn("id", F.regexp_replace("claim_id", "/[0-9]+$", ""))
    named, pieces = _named(s, facts)
    own = s.select(*AT, F.explode("roles").alias("r")).select(*AT, "r.role", "r.name", text.key(F.col("r.name")).alias("k"), text.key(F.concat("r.role", "r.name")).alias("both")).distinct()
    own = keep(own, "roles")
    # Of the index only what an answer may name is looked at.
    index = postings if postings is not None else ev.postings_of_facts(facts)
    wanted = ft.union(_unnamed(named).select("run_id", F.explode("keys").alias("k")), own.select("run_id", "k"), own.select("run_id", F.col("both").alias("k")))
    posted = keep(index.join(keep(wanted.distinct(), "wanted"), ["run_id", "k"], "left_semi"), "postings")

    terms = keep(_terms(named, pieces, facts, questions, posted), "terms")
    named = terms.select(*AT, "refs", "at", "asserted", "item")
    relations = keep(_relations(s, named, facts), "relations")
    statuses = terms.select(*AT, F.col("term").alias("claim"), F.col("status").alias("kind")).distinct()
    known = facts.select("run_id", "ref").where("ref is not null")
    known = known.unionByName(rows.select("run_id", "ref")) if rows is not None else known
    known = known.unionByName(known.select("run_id", whole_of("ref").alias("ref")).distinct())
    bad = s.select(*AT, F.explode("refs").alias("ref")).join(known, ["run_id", "ref"], "left_anti").select(*AT, F.col("ref").alias("claim"))
    note = lambda df, kind: df.select(*AT, "claim", F.lit(kind).alias("kind"))
    nowhere = lambda df, claim: df.select(*OWN, F.lit(None).cast("int").alias("n"), claim.alias("claim"))
    notes = [
        note(bad, "bad_reference"), note(s.select(*AT, F.explode("broken").alias("claim")), "bad_reference"),
        note(s.where("live is not null and not doubts").select(*AT, F.col("live").alias("claim")), "operating_state"),
        note(_misplaced(own, facts, index, posted, terms), "identifier_role"), note(_misattributed(s, facts, terms), "value_attribution"),
        note(nowhere(judged.where("verdict <> 'supported'"), F.coalesce("reason", "verdict")), "structured_claim"),
        relations.select(*AT, F.concat_ws(" ", "relation", "a", "b").alias("claim"), F.col("status").alias("kind")),
        note(s.where("size(refs) = 0").join(statuses.where("kind = 'supported'"), AT, "left_semi").select(*AT, F.col("text").alias("claim")), "unreferenced"),
        note(s.where("about_plant and size(terms) = 0 and not rtrim(text) like '%:'").select(*AT, F.col("text").alias("claim")), "unchecked"),
    ]
    if secret:
        leaked = grounding.leaks(prose.select(F.struct(*OWN).alias("id"), "text"), secret)
        notes.append(note(leaked.select("id.*", F.lit(None).cast("int").alias("n"), F.lit("(instructions)").alias("claim")), "prompt_disclosure"))
    notes = keep(ft.union(statuses, *notes), "notes")
    return Checked(s, terms.select(*AT, "term", "status"), relations, notes.where(F.col("kind").isin(*PROBLEMS, *GAPS)), _levels(prose, s, notes, judged, facts, known, rows))


def _about() -> Column:
    """The ids of what a fact is about, with nulls among them."""
    first = lambda q: F.get(F.element_at("qualifiers", q), F.lit(0))
    return F.concat(F.array("subject", "object", first("owner"), first("part_of"), first("connection")), F.coalesce(F.element_at("qualifiers", "candidates"), F.expr("cast(array() as array<string>)")))


def _unnamed(named: DataFrame) -> DataFrame:
    """Terms that stand for no item and are no item's name: values."""
    return named.where("item is null and coalesce(how, 'unknown') <> 'ambiguous'")


def _named(s: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per place of a term: AT, refs, doubts, term, kind, at, asserted, minus, k, keys, how, item. And what facts carry of the terms that name no item: run_id, k, fact_id, ref, about, predicate, subject."""
    each = keep(s.select(*AT, "refs", "doubts", F.explode("terms").alias("t")).select(*AT, "refs", "doubts", "t.*"), "terms")
    names = ft.resolve_names(each.select("run_id", F.col("term").alias("name")), facts).withColumnRenamed("name", "term")
    value = F.col("kind").isin("value_with_unit", "number")
    keys = F.array_distinct(F.array_compact(F.array(text.key(F.col("term")), F.when(value, quantity(F.col("term"))), F.when(value & F.col("minus"), quantity(F.col("term"), -1)))))
    resolved = keep(each.withColumns({"k": text.key(F.col("term")), "keys": keys}).join(names, ["run_id", "term"], "left"), "resolved")
    # What a fact carries: its value, whole and in pieces and as a quantity, and the ids of what it is about. A lookup that found nothing carries nothing.
    held = facts.where("predicate <> 'not_found'").select("run_id", "fact_id", "ref", F.array_distinct(F.array_compact(_about())).alias("about"), "value", "qualifiers", "property", "predicate", "subject")
    said = F.concat(F.array("value", "property"), F.flatten(F.map_values(F.map_filter(F.coalesce("qualifiers", F.expr("cast(map() as map<string,array<string>>)")), lambda k, v: ~k.isin("direction", "scope", "field")))))
    forms = F.flatten(F.transform(F.array_compact(said), lambda x: F.concat(F.transform(text.identifier_pieces(x), text.key), F.array(quantity(x)))))
    # Only pieces that a term of the same run may be are looked at further; a term that is an item's whole name is no piece.
    sought = resolved.where("coalesce(how, 'unknown') not in ('entity', 'object')").select("run_id", F.explode(F.array_append("keys", F.col("k"))).alias("k")).distinct()
    pieces = held.select("run_id", "fact_id", "ref", "about", "predicate", "subject", F.explode(F.array_distinct(F.array_compact(forms))).alias("k")).where("k <> ''")
    pieces = keep(pieces.join(keep(sought, "sought"), ["run_id", "k"], "left_semi").distinct(), "pieces")
    # A term that is a part of one item's name only names that item.
    part = pieces.where("predicate = 'identified_as'")
    other = pieces.where("predicate <> 'identified_as'").select("run_id", "k").distinct()
    part = part.groupBy("run_id", "k").agg(F.count_distinct("subject").alias("items"), F.min("subject").alias("part_of")).where("items = 1").join(other, ["run_id", "k"], "left_anti")
    named = resolved.join(part.select("run_id", "k", "part_of"), ["run_id", "k"], "left")
    item = F.when(F.col("how").isin("entity", "object"), F.get("ids", F.lit(0))).when(F.col("how") != "ambiguous", F.col("part_of"))
    return keep(named.withColumn("item", item).drop("ids", "part_of"), "named"), pieces


def _terms(named: DataFrame, pieces: DataFrame, facts: DataFrame, questions: DataFrame | None, posted: DataFrame) -> DataFrame:
    """AT, refs, term, kind, k, keys, at, asserted, item, status: a row per place of a term."""
    items = named.where("item is not null").groupBy(*AT).agg(F.collect_set("item").alias("items"))
    place = [*AT, "term"]

    # Only what is told about named items is looked at, and only as the sentences cite it.
    of_item = named.where("item is not null")
    cited = of_item.where("size(refs) > 0").select("run_id", "item", F.explode("refs").alias("r"), *OWN[1:], "n", "term")
    told = facts.where("ref is not null").select("run_id", "ref", F.explode(_about()).alias("item")).where("item is not null").join(cited.select("run_id", "item").distinct(), ["run_id", "item"], "left_semi")
    told = told.select("run_id", "item", F.explode(F.array("ref", whole_of("ref"))).alias("r"))
    backed = cited.join(told, ["run_id", "item", "r"], "left_semi").select(*place).distinct().withColumn("backed", F.lit(True))
    uncited = F.size("refs") == 0
    by_item = of_item.groupBy(*place).agg(F.bool_or(uncited).alias("free")).join(backed, place, "left")
    by_item = by_item.select(*place, F.when(F.col("free") | F.col("backed"), "supported").otherwise("uncited").alias("status"))

    values = _unnamed(named).join(items, AT, "left").withColumn("k", F.explode("keys"))
    if questions is not None:
        asked = read(questions).select(*OWN, F.explode("terms").alias("t")).select(*OWN, text.key(F.col("t.term")).alias("k")).distinct().withColumn("asked", F.lit(True))
        values = values.join(asked, [*OWN, "k"], "left")
    else:
        values = values.withColumn("asked", F.lit(False))
    # What a result holds without a fact of it, such as a column that facts don't tell, backs a term that stands by no item.
    loose = posted.select("run_id", "k", "ref").join(values.select("run_id", "k").distinct(), ["run_id", "k"], "left_semi").distinct().withColumnRenamed("ref", "posted_ref")
    posted_at = values.join(loose, ["run_id", "k"]).groupBy(*place).agg(F.bool_or(uncited | cites(F.col("posted_ref"))).alias("posted_here"), F.lit(True).alias("posted"))
    carried = values.join(pieces, ["run_id", "k"], "left")
    paired = F.col("fact_id").isNotNull() & (F.col("items").isNull() | F.arrays_overlap("about", "items"))
    yes = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    by_value = carried.groupBy(*place).agg(yes(paired & (uncited | cites(F.col("ref")))).alias("cited"), yes(paired).alias("paired"), yes(F.col("fact_id").isNotNull()).alias("some"), yes(F.col("asked")).alias("asked"), F.first("doubts").alias("doubts"), F.first("items").isNull().alias("alone"))
    by_value = by_value.join(posted_at, place, "left")
    posted_ok = F.coalesce("posted", F.lit(False))
    status = (
        F.when(F.col("cited"), "supported").when(F.col("paired"), "uncited").when(F.col("some"), "pairing")
        .when(posted_ok & F.col("posted_here"), "supported").when(posted_ok, "uncited")
        .when(F.col("asked") & F.col("doubts"), "asked").when(F.col("asked"), "question_only").otherwise("unsupported")
    )
    by_value = by_value.select(*place, status.alias("status"))
    shared = named.where("how = 'ambiguous'").join(items, AT, "left").join(pieces, ["run_id", "k"], "left").groupBy(*place).agg(yes(F.arrays_overlap("about", "items") | (F.col("predicate") == "ambiguous")).alias("yes"))
    shared = shared.select(*place, F.when(F.col("yes"), "supported").otherwise("ambiguous_identifier").alias("status"))
    return named.join(ft.union(by_item, by_value, shared), place, "left").select(*AT, "refs", "term", "kind", "k", "keys", "at", "asserted", "item", "status")


def _misplaced(own: DataFrame, facts: DataFrame, index: DataFrame, posted: DataFrame, terms: DataFrame) -> DataFrame:
    """own: AT, role, name, k, both. posted: what index has of them. AT, claim: names that a result has, but not as what the word before them says."""
    keys = keep(own.select("run_id", "k").distinct(), "keys")
    have = own.join(posted.select("run_id", "k").distinct(), ["run_id", "k"], "left_semi")
    fields = facts.sparkSession.createDataFrame([(role, f) for role, names in ROLE_FIELDS.items() for f in names], "role string, field string")
    # A name of the form line/component establishes both.
    slash = F.split("value", "/")
    pairs = index.where("value like '%/%'").where(F.size(slash) == 2)
    pairs = pairs.select("run_id", F.explode(F.map_from_arrays(F.array(F.lit("line"), F.lit("component")), F.array(text.key(slash[0]), text.key(slash[1])))).alias("role", "k")).join(keys, ["run_id", "k"], "left_semi")
    held = posted.join(F.broadcast(fields), "field").select("run_id", "role", "k").unionByName(pairs)
    # `Chamber 1` as one name, or a name whose item is of such a kind.
    whole = have.join(posted.select("run_id", F.col("k").alias("both")).distinct(), ["run_id", "both"], "left_semi").select("run_id", "role", "k")
    kinds = facts.where("predicate = 'is_a'").select("run_id", F.col("subject").alias("item"), F.explode(F.concat(text.name_tokens(F.col("value")), F.array(F.lower("value")))).alias("role")).distinct()
    items = terms.where("item is not null").select("run_id", "k", "item").join(keys, ["run_id", "k"], "left_semi")
    ids = facts.select("run_id", text.key(F.col("subject")).alias("k"), F.col("subject").alias("item")).join(keys, ["run_id", "k"], "left_semi")
    of_kind = items.unionByName(ids).distinct().join(kinds, ["run_id", "item"])
    fits = ft.union(held, whole, of_kind.select("run_id", "role", "k")).distinct()
    # Of other words than those of ROLE_FIELDS, only items whose kinds are known can be something else.
    judged = have.where(F.col("role").isin(*ROLE_FIELDS)).unionByName(have.where(~F.col("role").isin(*ROLE_FIELDS, "equipment", "item")).join(of_kind.select("run_id", "k").distinct(), ["run_id", "k"], "left_semi"))
    return judged.join(fits, ["run_id", "role", "k"], "left_anti").select(*AT, F.concat_ws(" ", "role", "name").alias("claim"))


def _misattributed(s: DataFrame, facts: DataFrame, terms: DataFrame) -> DataFrame:
    """AT, claim: values of one property in a sentence with the words of another, and not of its own."""
    bags = facts.where("predicate = 'has_property' and property is not null").select("run_id", "property", quantity(F.col("value")).alias("q"))
    words = F.filter(text.name_tokens(F.col("property")), lambda w: ~w.isin(*COMMON_WORDS))
    # A property that a result says is missing can be meant as well.
    every = bags.select("run_id", "property").unionByName(facts.where("predicate = 'lacks_property' and property is not null").select("run_id", "property"))
    names = every.select("run_id", "property", F.array_distinct(words).alias("telling")).distinct().where("size(telling) > 0")
    at = s.select(*AT, F.explode(F.array_distinct("words")).alias("w"))
    spelled = names.select("run_id", "property", F.lower("property").alias("w")).join(at, ["run_id", "w"]).select(*AT, "property")
    told = names.select("run_id", "property", F.size("telling").alias("of"), F.explode("telling").alias("w")).join(at, ["run_id", "w"])
    told = told.groupBy(*AT, "property", "of").agg(F.count(F.lit(1)).alias("have")).where("have = of").select(*AT, "property").unionByName(spelled).distinct()
    value = terms.where("kind = 'value_with_unit' and status in ('supported', 'uncited')").select(*AT, "term", F.explode("keys").alias("q"))
    owners = value.join(bags.where("q is not null").distinct(), ["run_id", "q"]).select(*AT, "term", "property").distinct()
    right = owners.join(told, [*AT, "property"], "left_semi").select(*AT, "term").distinct()
    wrong = owners.select(*AT, "term").distinct().join(right, [*AT, "term"], "left_anti").join(told, AT)
    return wrong.join(owners, [*AT, "term", "property"], "left_anti").select(*AT, F.col("term").alias("claim")).distinct()


def _relating(facts: DataFrame) -> DataFrame:
    """Facts that relate anything: the others are not copied."""
    first = lambda q: F.get(F.element_at("qualifiers", q), F.lit(0))
    facts = facts.where(F.col("predicate").isin("flows_to", "reaches", "path", *ft.LINKS.values()) | F.col("route").isNotNull() | first("owner").isNotNull() | first("part_of").isNotNull())
    return facts.select("run_id", "fact_id", "ref", "predicate", "subject", "object", "route", *(first(q).alias(name) for q, name in (("from_chamber", "exit"), ("to_chamber", "entry"), ("direction", "way"), ("owner", "owner"), ("part_of", "part_of"))))


def _sets(stated: DataFrame, relating: DataFrame) -> DataFrame:
    """stated: run_id, refs (array). run_id, refs, scope: each different set of citations. One that names every result with a relating fact has the run's own scope, that of no citations, as it has the same facts."""
    every = F.expr("cast(array() as array<string>)")
    sets = keep(stated.select("run_id", F.array_sort("refs").alias("refs")).unionByName(stated.select("run_id", every.alias("refs"))).distinct(), "sets")
    results = keep(relating.select("run_id", whole_of("ref").alias("r")).distinct(), "results")
    lacks = sets.where("size(refs) > 0").join(results, "run_id").where(F.col("r").isNull() | ~F.array_contains("refs", F.col("r"))).select("run_id", "refs").distinct().withColumn("lacks", F.lit(True))
    return sets.join(lacks, ["run_id", "refs"], "left").select("run_id", "refs", scope_of(F.when(F.col("lacks"), F.col("refs")).otherwise(every)).alias("scope"))


def _scopes(sets: DataFrame, relating: DataFrame) -> DataFrame:
    """sets: run_id, refs, scope. The relating facts of each different scope; one that is cited by its row and by its result may be there twice."""
    whole = sets.where(F.col("scope") == scope_of(F.expr("cast(array() as array<string>)"))).select("run_id", "scope").distinct()
    cited = sets.join(whole, ["run_id", "scope"], "left_anti").select("run_id", "scope", F.explode("refs").alias("r")).distinct()
    cited = keep(cited, "cited")
    results = keep(cited.where(F.col("r").startswith("R")), "cited")
    own = relating.withColumn("r", F.col("ref")).join(cited, ["run_id", "r"]).unionByName(relating.withColumn("r", whole_of("ref")).join(results, ["run_id", "r"]))
    return own.drop("r").unionByName(relating.join(whole, "run_id"))


def scope_of(refs: str | Column) -> Column:
    return F.concat_ws("\x01", "run_id", F.array_join(F.array_sort(refs), ","))


def shown_pairs(scoped: DataFrame, asked: DataFrame, close: DataFrame) -> tuple[DataFrame, DataFrame]:
    """scoped: facts with scope. asked and close: scope, a, b. Those of asked of which b lies downstream of a; and those of close that one fact, or one route, joins either way round."""
    pipes = scoped.where("predicate = 'flows_to'").select("scope", F.col("subject").alias("from"), F.col("object").alias("to"), "exit", "entry", F.col("fact_id").alias("at"))
    pairs = keep(asked.select("scope", "a", "b").distinct(), "pairs")
    flows = graph.reaching(pipes, pairs)
    way = F.col("way")
    stops = scoped.where("route is not null").select("scope", F.col("fact_id").alias("route_id"), way.isin("downstream", "upstream").alias("drawn"), F.posexplode(F.when(way == "upstream", F.reverse("route")).otherwise(F.col("route"))).alias("pos", "node"))
    stops = keep(stops, "stops")
    at = lambda c, p: stops.select("scope", "route_id", F.col("node").alias(c), F.col("pos").alias(p), *(["drawn"] if c == "a" else []))
    on = keep(pairs.join(at("a", "pa"), ["scope", "a"]).join(at("b", "pb"), ["scope", "route_id", "b"]).where("pa <> pb"), "on")
    flows = flows.unionByName(on.where("drawn and pa < pb").select("scope", "a", "b")).distinct()
    close = keep(close.select("scope", "a", "b").distinct(), "close")
    flows = keep(flows, "flows")
    if close.isEmpty():
        return flows, close
    one = scoped.where(F.col("predicate").isin("flows_to", "reaches", "path", *ft.LINKS.values()) & F.col("object").isNotNull()).select("scope", F.col("subject").alias("a"), F.col("object").alias("b"))
    for q in ("owner", "part_of"):
        one = one.unionByName(scoped.select("scope", F.col("subject").alias("a"), F.col(q).alias("b")).where("b is not null"))
    # Either way round is one pair.
    ends = {"low": F.least("a", "b"), "high": F.greatest("a", "b")}
    joined = close.withColumns(ends).join(one.where("a is not null").withColumns(ends).select("scope", "low", "high"), ["scope", "low", "high"], "left_semi")
    joined = joined.select("scope", "a", "b").unionByName(close.join(on.select("scope", "a", "b"), ["scope", "a", "b"], "left_semi")).distinct()
    return flows, keep(joined, "joined")


def _relations(s: DataFrame, named: DataFrame, facts: DataFrame) -> DataFrame:
    at = named.where("item is not null and asserted").groupBy(*AT).agg(F.array_sort(F.collect_set(F.struct("at", "item"))).alias("where"))
    rows = s.join(at, AT).withColumn("items", F.array_distinct(F.transform("where", lambda x: x["item"]))).where("size(items) > 1")
    rows = keep(rows.select(*AT, F.array_sort("refs").alias("refs"), "relations", "related", "direct", "where", "items"), "stated")
    relating = _relating(facts)
    sets = keep(_sets(rows.select("run_id", "refs"), relating), "scopes")
    rows = keep(rows.join(sets, ["run_id", "refs"], "left").withColumn("whole", scope_of(F.expr("cast(array() as array<string>)"))), "stated")
    r = rows.select(*AT, "scope", "whole", "where", "items", F.explode("relations").alias("r")).select("*", "r.*")
    before = F.transform(F.filter("where", lambda w: w["at"] < F.col("start")), lambda w: w["item"])
    after = F.transform(F.filter("where", lambda w: w["at"] >= F.col("end")), lambda w: w["item"])
    near = F.transform(F.filter("where", lambda w: (w["at"] >= F.col("end")) & (w["at"] <= F.col("end") + wording.SIDE_REACH)), lambda w: w["item"])
    r = r.withColumns({"before": before, "after": after, "near": F.slice(near, 1, 1)})
    links, side = F.col("kind").isin(*ft.LINKS.values()), F.col("kind").isin("downstream", "upstream")
    turned = F.col("kind").isin("fed") | (links & F.col("passive"))
    last, one = F.slice("before", F.greatest(F.size("before"), F.lit(1)), 1), F.slice("after", 1, 1)
    others = F.array_except("items", F.col("near"))
    left = F.when(F.col("kind") == "downstream", F.col("near")).when(F.col("kind") == "upstream", others).when(turned, one).when(links, last).otherwise(F.col("before"))
    right = F.when(F.col("kind") == "downstream", others).when(F.col("kind") == "upstream", F.col("near")).when(turned, last).otherwise(F.col("after"))
    r = r.withColumns({"left": F.array_distinct(left), "right": F.array_except(right, left), "stated": F.row_number().over(Window.partitionBy(*AT).orderBy("start"))})
    # Links are no piping: where one is stated, no flow is read out of the sentence.
    linked = r.where(links & (F.size("left") > 0) & (F.size("right") > 0)).select(*AT).distinct().withColumn("linked", F.lit(True))
    r = keep(r.join(linked, AT, "left").where(links | F.col("linked").isNull()).select(*AT, "scope", "whole", "kind", "stated", "left", "right", links.alias("is_link"), side.alias("is_side")), "relations")
    null = F.lit(None).cast("string")
    unclear = r.where("size(left) = 0 or size(right) = 0").select(*AT, F.col("kind").alias("relation"), null.alias("a"), null.alias("b"), F.lit("unclear").alias("status"))
    pairs = r.where("size(left) > 0 and size(right) > 0").select("*", F.explode("left").alias("a")).select("*", F.explode("right").alias("b")).where("a <> b")
    pairs = keep(pairs, "pairs")

    # Wording that relates the items at all, and that no relation covers: all that are named must hang together.
    covered = r.groupBy(*AT).agg(F.array_distinct(F.flatten(F.collect_list(F.concat("left", "right")))).alias("covered"))
    loose = rows.where("related").join(covered, AT, "left").where("covered is null or size(array_except(items, covered)) > 0").join(linked, AT, "left_anti")
    loose = keep(loose, "loose")
    two = loose.select(*AT, "scope", "whole", "direct", F.posexplode("items").alias("i", "a"), "items").select(*AT, "scope", "whole", "direct", "a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("b"))
    two = keep(two, "two")

    both = lambda df: df.select("scope", "a", "b").unionByName(df.select(F.col("whole").alias("scope"), "a", "b"))
    flow = pairs.where("not is_link")
    turn = lambda df: df.select("scope", F.col("b").alias("a"), F.col("a").alias("b"))
    # Whether a flow is the other way round is asked of the whole run only.
    asked = ft.union(both(flow), turn(flow.select(F.col("whole").alias("scope"), "a", "b")), both(two), turn(both(two)))
    scoped = keep(_scopes(sets, relating), "scoped")
    flows, joined = shown_pairs(scoped, asked, both(two))
    link = scoped.where(F.col("predicate").isin(*ft.LINKS.values())).select("scope", F.col("predicate").alias("p"), F.col("subject").alias("a"), F.col("object").alias("b"))
    shown = keep(flows.select("scope", F.lit("flow").alias("p"), "a", "b").unionByName(link).distinct(), "shown")

    pairs = pairs.withColumn("p", F.when(F.col("is_link"), F.col("kind")).otherwise("flow"))
    mark = lambda flag, scope: shown.withColumnRenamed("scope", scope).withColumn(flag, F.lit(True))
    back = shown.select(F.col("scope").alias("whole"), "p", F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("back"))
    pairs = pairs.join(mark("here", "scope"), ["scope", "p", "a", "b"], "left").join(mark("anywhere", "whole"), ["whole", "p", "a", "b"], "left").join(back, ["whole", "p", "a", "b"], "left")
    yes = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    # A link needs one of its targets, a flow one of its sources for each target, a side each pair.
    group = F.when(F.col("is_link"), F.lit("")).when(F.col("is_side"), F.concat_ws(">", "a", "b")).otherwise(F.col("b"))
    judged = pairs.groupBy(*AT, "kind", "stated", group.alias("of")).agg(F.min("a").alias("a"), F.min("b").alias("b"), yes("here").alias("here"), yes("anywhere").alias("anywhere"), yes("back").alias("back"))
    status = F.when(F.col("here"), "supported").when(F.col("anywhere"), "uncited").when(F.col("back"), "contradicted").otherwise("unsupported")
    judged = judged.select(*AT, F.col("kind").alias("relation"), "a", "b", status.alias("status"))

    if loose.isEmpty():
        return unclear.unionByName(judged)
    # Directly: by one fact. Else also by flow, or on one route.
    direct = joined.withColumn("close", F.lit(True))
    far = flows.unionByName(turn(flows)).distinct().withColumn("far", F.lit(True))

    def together(scope: str, label: str) -> DataFrame:
        own = two.withColumn("s", F.col(scope)).join(direct.withColumnRenamed("scope", "s"), ["s", "a", "b"], "left").join(far.withColumnRenamed("scope", "s"), ["s", "a", "b"], "left")
        hit = own.where(F.col("close") | (F.col("far") & ~F.col("direct")))
        set_id = F.concat_ws("\x01", *AT)
        sets = loose.select(set_id.alias("set_id"), F.explode("items").alias("node"))
        name = lambda c: F.concat_ws("\x02", set_id, F.col(c))
        found = graph.components(sets.select(F.concat_ws("\x02", "set_id", "node").alias("node")), hit.select(name("a").alias("source"), name("b").alias("target")))
        found = found.groupBy(F.substring_index("node", "\x02", 1).alias("set_id")).agg((F.count_distinct("component") == 1).alias(label))
        return found

    held = loose.withColumn("set_id", F.concat_ws("\x01", *AT)).join(together("scope", "here"), "set_id", "left").join(together("whole", "anywhere"), "set_id", "left")
    status = F.when(F.col("here"), "supported").when(F.col("anywhere"), "uncited").otherwise("unsupported")
    held = held.select(*AT, F.lit("related").alias("relation"), F.array_join("items", ",").alias("a"), null.alias("b"), status.alias("status"))
    return ft.union(unclear, judged, held)


def _levels(prose: DataFrame, s: DataFrame, notes: DataFrame, judged: DataFrame, facts: DataFrame, known: DataFrame, rows: DataFrame | None) -> DataFrame:
    """run_id, id, problems, gaps, level, answer."""
    kind = F.col("kind")
    # A term of the question that a sentence, with valid citations, says is not there anchors the answer as much as one that is.
    fine = s.where("size(refs) > 0").select(*AT).distinct()
    asked = notes.where("kind = 'asked'").join(fine, AT, "left_semi").select(*OWN, F.lit("supported").alias("kind"))
    entailed = judged.where("verdict = 'supported'").select(*OWN, F.lit("supported").alias("kind"))
    n = ft.union(notes.select(*OWN, "kind"), asked, entailed).groupBy(*OWN).agg(F.count_if(kind.isin(*PROBLEMS)).alias("problems"), F.count_if(kind.isin(*GAPS)).alias("gaps"), F.count_if(kind == "supported").alias("supported"))
    several = facts.where("predicate = 'ambiguous'").select("run_id", "ref").distinct()
    cited = s.select(*OWN, F.explode("refs").alias("r"))
    vague = cited.join(several.select("run_id", F.explode(F.array("ref", whole_of("ref"))).alias("r")), ["run_id", "r"], "left_semi").select(*OWN).distinct().withColumn("vague", F.lit(True))
    # Answers of citations alone are written out by code, so they are as good as their references.
    bare = s.groupBy(*OWN).agg(F.bool_and((F.size("refs") > 0) & (F.regexp_replace("text", r"[\s.:;*-]+", "") == "")).alias("bare"))
    out = prose.select(*OWN, "text", "has_block").join(n, OWN, "left").join(vague, OWN, "left").join(bare, OWN, "left").fillna({"problems": 0, "gaps": 0, "supported": 0, "vague": False, "bare": False})
    alone = F.col("bare") & ~F.col("has_block")
    level = F.when((F.col("problems") > 0) | ((F.col("supported") == 0) & ~alone), "insufficient_evidence").when(F.col("vague"), "ambiguous").when(F.col("gaps") > 0, "limited").otherwise("grounded")
    answer = F.col("text")
    if rows is not None:
        written = ev.written_out(s.select(*OWN, "n", "refs"), rows)
        out = out.join(written, OWN, "left")
        answer = F.when(alone & (F.col("problems") == 0), F.coalesce("written", "text")).otherwise(F.col("text"))
    return out.select(*OWN, "problems", "gaps", level.alias("level"), answer.alias("answer"))
