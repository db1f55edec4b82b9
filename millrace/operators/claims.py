"""Claims against facts: what is positively entailed is supported, all else is not."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import facts as ft
from millrace.operators import graph, wording
from millrace.plans.storage import keep

CLAIM = "run_id string, claim_id string, predicate string, subject string, object string, value string, property string, qualifiers map<string,array<string>>, route array<string>"
WAYS = ("downstream", "upstream", "any", "both")


def _evidence(facts: DataFrame) -> DataFrame:
    """Facts as what they can support: p, a, b, v, name, way (the direction from a to b), have (qualifiers), route, back (true if it shows the opposite), fact_id."""
    way = F.get(F.element_at("qualifiers", "direction"), F.lit(0))
    null = F.lit(None).cast("string")
    put = lambda rows, p, a, b=null, way_=null, back=False: rows.select(
        "run_id", (F.lit(p) if isinstance(p, str) else p).alias("p"), (F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b"), F.col("value").alias("v"), F.col("property").alias("name"),
        way_.alias("way"), F.col("qualifiers").alias("have"), F.col("route").alias("on"), F.lit(back).alias("back"), "fact_id",
    )
    of = lambda *p: facts.where(F.col("predicate").isin(*p))
    one = of("is_a", "identified_as", "has_property", "lacks_property", *ft.STATES)
    owned = of("has_property", "lacks_property").where(F.element_at("qualifiers", "owner").isNotNull())
    pipes, routes, links = of("flows_to"), of("path", "reaches"), of(*ft.LINKS.values())
    down, up = F.lit("downstream"), F.lit("upstream")
    parts = [
        put(one, F.col("predicate"), "subject", null, way), put(owned, F.col("predicate"), F.get(F.element_at("qualifiers", "owner"), F.lit(0))),
        put(of("not_found", "ambiguous"), F.col("predicate"), null),
        *(put(pipes, p, a, b, w) for p in ("connected_to", "reachable") for a, b, w in (("subject", "object", down), ("object", "subject", up))),
        *(put(routes, p, "subject", "object", F.coalesce(way, down)) for p in ("reachable", "path")),
        put(links, F.col("predicate"), "subject", "object"), put(links, F.col("predicate"), "object", "subject", back=True),
        put(of("no_path"), "no_path", "subject", "object", way),
    ]
    return ft.union(*parts)


def _carried(wanted: Column, have: Column) -> Column:
    """Whether the fact carries every qualifier that the claim gives (direction apart), by names and values that match."""
    needs = F.filter(F.map_entries(wanted), lambda w: w["key"] != "direction")
    fits = lambda w, h: text.names_match(w["key"], h["key"]) & F.exists(w["value"], lambda x: F.exists(h["value"], lambda y: text.values_match(x, y)))
    return F.coalesce(F.forall(needs, lambda w: F.exists(F.map_entries(have), lambda h: fits(w, h))), F.size(needs) == 0, F.lit(True))


def judge(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claims: as CLAIM. facts: of any number of runs; a claim is held against those of its own. run_id, claim_id, verdict, fact_id (of a fact that supports or contradicts it), reason.

    verdict: supported; contradicted (another value, another way round); unsupported; ambiguous or unknown (of a name); unknown_relation.
    """
    # Runs that claim nothing have nothing to be held against.
    claiming = keep(claims.select("run_id").distinct(), "claiming")
    facts = keep(facts.join(claiming, "run_id", "left_semi").withColumn("fact_id", F.monotonically_increasing_id()), "facts")
    c = claims.withColumns({"p": F.lower(F.trim("predicate")), "wanted": F.coalesce("qualifiers", F.expr("cast(map() as map<string,array<string>>)"))})
    listed = c.select("run_id", F.explode(F.concat(F.array("subject", "object"), F.coalesce("route", F.expr("cast(array() as array<string>)")))).alias("name"))
    names = keep(ft.resolve_names(listed, facts), "names")
    end = lambda side: names.select("run_id", F.col("name").alias(side), F.col("ids").alias(f"{side}_ids"), F.col("how").alias(f"{side}_how"))
    c = c.join(end("subject"), ["run_id", "subject"], "left").join(end("object"), ["run_id", "object"], "left")
    steps = c.where("route is not null").select("run_id", "claim_id", F.posexplode("route").alias("pos", "name")).join(names, ["run_id", "name"], "left")
    steps = steps.groupBy("run_id", "claim_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("id")))), lambda x: x["id"]).alias("stops"))
    c = keep(c.join(steps, ["run_id", "claim_id"], "left"), "claims")

    evidence = keep(_evidence(facts), "evidence")
    looked = F.col("p").isin("not_found", "ambiguous")
    own = c.where(~looked).select("*", F.explode("subject_ids").alias("s"))
    hits = own.join(evidence.withColumnsRenamed({"a": "s"}), ["run_id", "p", "s"])
    hits = hits.where(F.col("b").isNull() | F.array_contains("object_ids", F.col("b")))
    asked = F.lower(F.get(F.element_at("wanted", "direction"), F.lit(0)))
    named = F.when(F.col("p") == "is_a", text.name_tokens(F.col("v")) == text.name_tokens(F.col("value"))).when(F.col("p") == "identified_as", text.key(F.col("v")) == text.key(F.col("value")))
    stated = F.when(F.col("p") == "has_property", text.names_match(F.col("property"), F.col("name")) & text.values_match(F.col("value"), F.col("v")))
    lacks = F.when(F.col("p") == "lacks_property", text.name_tokens(F.col("property")) == text.name_tokens(F.col("name")))
    same_way = asked.isNull() | ~asked.isin("downstream", "upstream") | F.col("way").isNull() | (F.col("way") == asked) | F.col("way").isin("any", "both")
    exact_way = F.when(F.col("p").isin("no_path", *ft.STATES), asked.isNull() | F.col("way").eqNullSafe(asked)).otherwise(same_way)
    stops = F.col("route").isNull() | (~F.exists(F.coalesce("stops", F.expr("cast(array() as array<string>)")), lambda x: x.isNull()) & graph.in_order(F.col("stops"), F.col("on")))
    plain = ~F.col("back") & exact_way & F.coalesce(stops, F.lit(False)) & (F.col("p").isin("no_path", *ft.LINKS.values()) | _carried(F.col("wanted"), F.col("have")))
    yes = F.coalesce(named, stated, lacks, plain, F.lit(False))
    # The same property with another value, a link or a pipe the other way: the facts say otherwise.
    other = F.when(F.col("p") == "has_property", text.names_match(F.col("property"), F.col("name"))).when(F.col("p").isin(*ft.STATES), F.lit(False)).otherwise(F.col("back") | ~same_way)
    told = hits.groupBy("run_id", "claim_id").agg(F.min(F.when(yes, F.col("fact_id"))).alias("for"), F.min(F.when(~yes & F.coalesce(other, F.lit(False)), F.col("fact_id"))).alias("against"))

    # Lookups are compared by what was asked for; listed candidates must be among those returned.
    found = evidence.where("p in ('not_found', 'ambiguous')").select("run_id", "p", text.key(F.col("v")).alias("k"), "have", "fact_id")
    want = c.where(looked).withColumn("k", text.key(F.coalesce("value", "subject")))
    candidate = lambda x: F.exists(F.element_at("have", "candidates"), lambda y: text.key(x) == text.key(y))
    fits = F.coalesce(F.forall(F.element_at("wanted", "candidates"), candidate), F.element_at("wanted", "candidates").isNull(), F.lit(True))
    seen = want.join(found, ["run_id", "p", "k"]).where(fits).groupBy("run_id", "claim_id").agg(F.min("fact_id").alias("for"), F.lit(None).cast("bigint").alias("against"))

    two = F.col("p").isin("connected_to", "reachable", "path", "no_path", *ft.LINKS.values())
    verdict = (
        F.when(F.col("p").isNull() | ~F.col("p").isin(*ft.PREDICATES), "unknown_relation")
        .when(~looked & (F.coalesce("subject_how", F.lit("unknown")) == "ambiguous"), "ambiguous")
        .when(~looked & (F.coalesce("subject_how", F.lit("unknown")) == "unknown"), "unknown")
        .when(two & F.coalesce("object_how", F.lit("unknown")).isin("ambiguous", "unknown"), F.coalesce("object_how", F.lit("unknown")))
        .when(asked.isNotNull() & two & ~asked.isin(*WAYS), "unsupported")
        .when(F.col("for").isNotNull(), "supported").when(F.col("against").isNotNull(), "contradicted").otherwise("unsupported")
    )
    reason = (
        F.when(F.col("verdict") == "unknown_relation", F.concat(F.lit("no such relation: "), F.coalesce("predicate", F.lit("-"))))
        .when(F.col("verdict") == "ambiguous", F.lit("a name stands for several items"))
        .when(F.col("verdict") == "unknown", F.lit("a name stands for nothing that a result has"))
        .when(F.col("verdict") == "contradicted", F.lit("the results say otherwise"))
        .when(F.col("verdict") == "unsupported", F.lit("no result says so"))
    )
    out = c.join(told.unionByName(seen), ["run_id", "claim_id"], "left").withColumn("verdict", verdict)
    return out.select("run_id", "claim_id", "verdict", F.when(F.col("verdict") == "supported", F.col("for")).when(F.col("verdict") == "contradicted", F.col("against")).alias("fact_id"), reason.alias("reason"))


def read_claims(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """answers: run_id, id, text. (run_id, id, prose, has_block) and the claims as judge() takes them, claim_id being id/number. What is no claim has no predicate."""
    words = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)
    listed = lambda x: [y for y in map(words, x if isinstance(x, list) else [x]) if y is not None]

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ddl = f"id string, prose string, has_block boolean, {CLAIM}"
    kinds = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for run, own, body in zip(*(batch[c].to_pylist() for c in ("run_id", "id", "text")), strict=True):
                # Without a fence there is no block.
                prose, found = wording.split_answer(body) if "```" in (body or "") else ((body or "").strip(), None)
                rows.append((str(own), prose, found is not None, run, None, None, None, None, None, None, None, None))
                for k, c in enumerate(found or []):
                    c = c if isinstance(c, dict) else {}
                    q = c.get("qualifiers") if isinstance(c.get("qualifiers"), dict) else {}
                    route = listed(q["entities"]) if isinstance(q.get("entities"), list) else None
                    q = [(a, listed(b)) for a, b in q.items() if a != "entities" and b is not None]
                    rows.append((str(own), None, None, run, f"{own}/{k}", *(words(c.get(x)) for x in ("predicate", "subject", "object", "value", "property")), q, route))
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kind.type) for k, kind in enumerate(kinds)], schema=kinds)

    # Texts are short and reading them is not, so they are dealt to all cores. Kept: both parts are read from one pass.
    texts = answers.select("run_id", F.col("id").cast("string").alias("id"), "text").repartition(2 * answers.sparkSession.sparkContext.defaultParallelism)
    every = keep(texts.mapInArrow(run, ddl), "answers")
    return every.where("claim_id is null").select("run_id", "id", "prose", "has_block"), every.where("claim_id is not null").drop("id", "prose", "has_block")
