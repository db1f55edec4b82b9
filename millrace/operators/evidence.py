"""The evidence of a call: its rows with references, the facts that they state, a sentence for each row, and an index of every value in them.

A Result has sections. ROWS says which of them are rows of evidence, in which order they are numbered, and who makes facts of them. Rows are numbered E<step>.<n> in that
order; E<step>.0 stands for the call's status: what it did not find, where the piping ends, where a search was cut. R<step> stands for all rows of a call. Everything
carries the run's key, so evidence of any number of runs goes into one table (see store()).

Sentences are templates with slots, kept as rows (SEGMENTS): a row takes the segments of its section and case whose slot it fills.

The index holds each leaf of a row, however deep it is nested, by field, path and the forms in which a text may name it. It follows a table's schema: no column is named in code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from millrace.functions import text
from millrace.operators import facts as ft
from millrace.operators import grounding
from millrace.operators.submission import label
from millrace.plans.storage import keep

if TYPE_CHECKING:
    from millrace.plans.service import Result, Service

ROW = "run_id string, step int, ref string, section string, ord long, operation string, semantics string, predicate string, main boolean, case string, slots map<string,string>"
POSTING = "run_id string, ref string, section string, path string, field string, value string, k string"
#: What R<step> stands for, beside boundaries, properties, derived rows and the status: the section that answers the operation's question.
MAIN = {"get_connections": "connections", "trace_instrumentation": "connections", "trace_line": "connections", "find_path": "paths", "isolation_boundary": "derived"}

#: section, case, place, text, slot that must be filled.
SEGMENTS: list[tuple[str, str, int, str, str]] = [
    ("entities", "plain", 0, "{label}, {type}", "label"),
    ("entities", "reached", 0, "{label}, {type}: {distance} pipe(s) {way} {start}", "label"),
    ("entities", "reached", 1, ", past {through}", "through"),
    ("entities", "reached", 2, "; the drawn piping ends there", "ends"),
    ("entities", "reached", 3, "; the search was cut there, the piping goes on", "cut"),
    ("entities", "reached", 4, " (with {blocked} taken as closed)", "blocked"),
    ("connections", "pipe", 0, "Drawn flow from {from} to {to}", "from"),
    ("connections", "open", 0, "A pipe at {at} whose other end is not drawn ({end} missing)", "at"),
    ("connections", "link", 0, "{from} {said} {to}", "from"),
    ("connections", "pipe", 1, ", line {line}", "line"),
    ("connections", "open", 1, ", line {line}", "line"),
    ("connections", "pipe", 2, ", {size}", "size"),
    ("connections", "open", 2, ", {size}", "size"),
    ("paths", "drawn_flow", 0, "Route along the drawn flow, {length} pipe(s): {nodes}", "nodes"),
    ("paths", "topological", 0, "Joined by piping, whatever way it flows, {length} pipe(s): {nodes}", "nodes"),
    ("paths", "topological", 1, "; {against} of them against the drawn flow", "against"),
    ("paths", "topological", 2, ", past {one_way} the wrong way", "one_way"),
    ("paths", "drawn_flow", 3, " (with {blocked} taken as closed)", "blocked"),
    ("paths", "topological", 3, " (with {blocked} taken as closed)", "blocked"),
    ("properties", "found", 0, "{label}: {property} = {value}", "label"),
    ("properties", "missing", 0, "{label}: the drawing gives no {property}", "label"),
    ("boundaries", "chamber", 0, "At {label} the search came in by chamber {entered} and may not leave by {blocked}", "label"),
    ("derived", "isolation_boundary_valve", 0, "{object} is the first valve on the {side} side of {subject}", "object"),
    ("derived", "check_valve_on_boundary", 0, "{object} bounds {subject} on the {side} side, but is a check valve and can't be shut", "object"),
    ("derived", "isolation_boundary_valve", 2, "; nothing is drawn behind it", "nothing"),
    ("derived", "check_valve_on_boundary", 2, "; nothing is drawn behind it", "nothing"),
    ("derived", "relief_device_on_boundary", 0, "No valve lies between {subject} and {object}", "object"),
    ("derived", "relief_device_on_boundary", 2, "; drawn flow runs into it from here", "relieves"),
    ("derived", "relief_device_on_boundary", 2, "; drawn flow comes from it, so it does not relieve this piping", "feeds"),
    ("derived", "unisolated_connection", 0, "No valve lies between {subject} and {object}", "object"),
    ("derived", "unisolated_connection", 0, "No valve on the {side} side of {subject} before the pipe leaves the drawing", "open"),
    ("derived", "unisolated_connection", 2, "; the piping leaves the drawing there", "leaves"),
    ("derived", "closed_end_in_region", 0, "{object} is an end of the drawn piping around {subject}", "object"),
    ("derived", "fully_valve_bounded", 0, "Every way out of {subject} ends at a shut-off valve, a relief device or a closed end", "yes"),
    ("derived", "fully_valve_bounded", 0, "{subject} can't be shut off by the valves of this drawing alone", "no"),
    ("derived", "relief_path_inside_boundary", 0, "With its boundary valves shut, {subject} still has a drawn way to a relief device", "yes"),
    ("derived", "relief_path_inside_boundary", 0, "With its boundary valves shut, {subject} has no drawn way to a relief device", "no"),
    ("derived", "line_run", 0, "Line {line} runs from {subject} to {object}", "line"),
    ("derived", "line_run", 1, " by way of {through}", "through"),
    ("derived", "line_run", 2, "; {sizes}; the run ends at: {ends_at}", "sizes"),
    ("derived", "line_meets_line", 0, "At {subject}, line {line} meets line {value}", "value"),
    ("derived", "signal_chain", 0, "Signal chain: {through}", "through"),
    ("derived", "loop_measured_at", 0, "{subject} measures at {object}", "object"),
    ("derived", "loop_acts_on", 0, "{subject} acts on {object}", "object"),
    ("derived", "signal_chain", 2, "; on failure: {fail}", "fail"),
    ("derived", "loop_acts_on", 2, "; on failure: {fail}", "fail"),
    *[("derived", p, 1, " ({line})", "pipe") for p in ("isolation_boundary_valve", "check_valve_on_boundary", "relief_device_on_boundary", "unisolated_connection")],
    ("status", "said", 0, "{said}", "said"),
    ("status", "drawing_end", 0, "{label}: the piping leaves the drawing here, where to is not shown", "label"),
    ("status", "end_of_piping", 0, "{label}: the drawn piping ends here", "label"),
]
#: What a link says, by the predicate of its fact.
LINK_WORDS = {"operates": "operates", "sends_signal_to": "sends its signal to", "senses_at": "senses at", "measurement_input_to": "passes its measurement to"}


@dataclass
class Evidence:
    """rows: as ROW, with text. facts: as facts.py makes them. postings: as POSTING."""

    rows: DataFrame
    facts: DataFrame
    postings: DataFrame


def leaves(c: Column, kind: DataType, path: Column, name: Column) -> Column:
    """Every value inside a column as (path, field, value), whatever structs, arrays and maps it is nested in."""
    none = F.expr("cast(array() as array<struct<path:string,field:string,value:string>>)")
    if isinstance(kind, StructType):
        fields = [f for f in kind.fields if f.name not in ("run_id", "ref", "step")]
        # A struct of a property and its value is that property's field.
        eav = {"property", "value"} <= {f.name for f in fields}
        parts = [leaves(c[f"`{f.name}`"] if "." in f.name else c[f.name], f.dataType, F.concat_ws(".", path, F.lit(f.name)), F.coalesce(c["property"], F.lit("value")) if eav and f.name == "value" else F.lit(f.name)) for f in fields]
        return F.coalesce(F.concat(none, *parts), none)
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(c, lambda x: leaves(x, kind.elementType, path, name))), none)
    if isinstance(kind, MapType):
        each = F.transform(F.map_entries(c), lambda e: leaves(e["value"], kind.valueType, F.concat_ws(".", path, e["key"].cast("string")), e["key"].cast("string")))
        return F.coalesce(F.flatten(each), none)
    return F.array(F.struct(path.alias("path"), name.alias("field"), c.cast("string").alias("value")))


def postings_of(rows: DataFrame, section: str) -> DataFrame:
    """rows: run_id, ref and any other columns. A row per value and form of it, as POSTING."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    kind = StructType(rows.schema.fields)
    each = rows.select("run_id", "ref", F.explode(leaves(whole, kind, F.lit(""), F.lit(""))).alias("leaf")).select("run_id", "ref", "leaf.*").where("value is not null and value not in ('', 'true', 'false')")
    return _forms(each, section)


def _forms(each: DataFrame, section: str) -> DataFrame:
    keys = F.array_distinct(F.transform(text.identifier_pieces(F.col("value")), text.key))
    field = F.regexp_replace(F.lower("field"), "[^a-z0-9]", "")
    return each.select("run_id", "ref", F.lit(section).alias("section"), F.ltrim("path", F.lit(".")).alias("path"), field.alias("field"), "value", F.explode(keys).alias("k")).where("k <> ''")


def postings_of_facts(facts: DataFrame) -> DataFrame:
    """The index of facts alone, for callers that have no rows."""
    q = F.flatten(F.transform(F.map_entries(F.coalesce("qualifiers", F.expr("cast(map() as map<string,array<string>>)"))), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("field"), v.alias("value")))))
    own = F.array(*(F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in ("subject", "object")), F.struct(F.coalesce("property", F.lit("value")).alias("field"), F.col("value").alias("value")), F.struct(F.lit("property").alias("field"), F.col("property").alias("value")))
    each = facts.where("predicate <> 'not_found'").select("run_id", "ref", F.explode(F.concat(own, q)).alias("leaf")).select("run_id", "ref", F.col("leaf.field").alias("path"), "leaf.*").where("value is not null and value <> ''")
    return _forms(each, "facts")


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENTS, "section string, case string, place int, template string, needs string")


def sentences(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows: section, case, slots, and by (their key). Adds text: the segments that the row fills, in their order."""
    own = rows.join(F.broadcast(segments(rows.sparkSession)), ["section", "case"]).where(F.element_at("slots", F.col("needs")).isNotNull())
    filled = F.aggregate(F.map_entries("slots"), F.col("template"), lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit("-"))))
    said = own.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", filled.alias("part")))), lambda x: x["part"]), "").alias("text"))
    return rows.join(said, by, "left")


def slots(**parts: Column) -> Column:
    """A map of what is not null."""
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in parts.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


class _Builder:
    """Collects the sections of one call: each with its rows in order, and what facts they state."""

    def __init__(self, result: Result, service: Service, run_id: str, step: int):
        self.result, self.service, self.run_id, self.step = result, service, run_id, step
        self.parts: list[tuple[str, DataFrame]] = []  # section, rows with ord, case, slots, predicate
        self.names = service.entities.select(F.col("id").alias("n_id"), label(F.col("name"), F.col("id")).alias("n_label"))
        self.direction = result.arguments.get("direction") or ("downstream" if result.tool == "find_path" else "both")
        self.blocked = F.lit(", ".join(map(str, result.arguments.get("blocked_entity_ids") or [])) or None).cast("string")

    def named(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Adds <column>_label for each column of ids."""
        for c in columns:
            rows = rows.join(self.names.withColumnsRenamed({"n_id": c, "n_label": f"{c}_label"}), c, "left").withColumn(f"{c}_label", F.coalesce(f"{c}_label", c))
        return rows

    def add(self, section: str, rows: DataFrame, order: list[Column], case: Column, predicate: Column | None = None, **parts: Column) -> DataFrame:
        """Numbers the rows and returns them with run_id, ref and tool, for facts."""
        ordinal = F.row_number().over(Window.orderBy(*order)).cast("long")
        own = rows.withColumns({"ord": ordinal, "case": case, "slots": slots(**parts), "predicate_": predicate if predicate is not None else F.lit(None).cast("string")})
        own = keep(own, f"rows-{section}")
        self.parts.append((section, own))
        return own

    def numbered(self) -> tuple[DataFrame, list[DataFrame]]:
        """Rows as ROW, and each part with run_id, ref and tool."""
        spark, before, rows, parts = self.service.spark, 0, [], []
        main = MAIN.get(self.result.tool, "entities")
        for section in grounding.SECTIONS:
            for name, own in self.parts:
                if name == section:
                    ref = F.concat(F.lit(f"E{self.step}."), (F.col("ord") + before).cast("string"))
                    cited = own.withColumns({"run_id": F.lit(self.run_id), "ref": ref, "tool": F.lit(self.result.tool)})
                    parts.append(cited)
                    semantics = F.lit(self.result.meta.get("route_semantics")).cast("string")
                    rows.append(cited.select("run_id", F.lit(self.step).alias("step"), "ref", F.lit(section).alias("section"), (F.col("ord") + before).alias("ord"), F.lit(self.result.tool).alias("operation"), semantics.alias("semantics"), F.col("predicate_").alias("predicate"), F.lit(section in (main, "boundaries", "properties", "derived")).alias("main"), "case", "slots"))
                    before += own.count()
        empty = spark.createDataFrame([], ROW)
        return reduce(DataFrame.unionByName, rows, empty), parts


def _entities(b: _Builder) -> DataFrame | None:
    rows = b.result.sections.get("entities")
    if rows is None:
        return None
    more = b.service.entities.select("id", "type_hierarchy", "properties", "piping_context", "ord")
    own = rows.drop("type_hierarchy", "properties", "piping_context", "ord", "line_id").join(more, "id")
    name = label(F.col("name"), F.col("id"))
    if "distance" not in own.columns:
        cited = b.add("entities", own, [F.col("ord"), F.col("id")], F.lit("plain"), label=name, type=F.col("type"))
        return cited
    start = b.result.meta["start"]
    first = b.names.where(F.col("n_id") == start).select(F.col("n_label").alias("start_label"))
    cut = b.result.sections["frontier"].select(F.col("node").alias("id"), F.lit("yes").alias("cut")).distinct()
    way = {"downstream": "downstream of", "upstream": "upstream of"}.get(b.direction, "from (whatever way it flows)")
    own = own.crossJoin(F.broadcast(first)).join(cut, "id", "left")  # one row
    through = F.when(F.size("through_equipment") > 0, F.array_join("through_equipment", ", "))
    return b.add("entities", own, [F.col("distance"), F.col("id")], F.lit("reached"), label=name, type=F.col("type"), distance=F.col("distance"), way=F.lit(way), start=F.col("start_label"), through=through, ends=F.when(F.col("terminal"), "yes"), cut=F.col("cut"), blocked=b.blocked)


def _connections(b: _Builder) -> DataFrame | None:
    rows = b.result.sections.get("connections")
    if rows is None:
        return None
    own = b.service.edges.join(rows.select("id").distinct(), "id", "left_semi")
    own = b.named(own, "source", "target")
    pipe = F.col("relationship") == "piping"
    half = F.col("source").isNull() | F.col("target").isNull()
    words = F.element_at(F.create_map(*(F.lit(x) for kind, p in ft.LINKS.items() for x in (kind, LINK_WORDS[p]))), F.col("connection_type"))
    bag = F.coalesce("properties", F.expr("cast(map() as map<string,string>)"))
    return b.add("connections", own, [F.col("ord"), F.col("id")], F.when(pipe & half, "open").when(pipe, "pipe").otherwise("link"), **{"from": F.col("source_label"), "to": F.col("target_label"), "said": F.coalesce(words, F.lit("is linked with")), "at": F.coalesce("source_label", "target_label"), "end": F.when(F.col("target").isNull(), "destination").otherwise("source"), "line": bag["lineNumber"], "size": bag["nominalDiameterRepresentation"]})


def _paths(b: _Builder) -> DataFrame | None:
    rows = b.result.sections.get("paths")
    if rows is None:
        return None
    source = F.get("path", F.lit(0))["from"]
    own = rows.withColumns({"source": source, "target": F.element_at("path", -1)["to"], "nodes": F.concat(F.array(source), F.transform("path", lambda s: s["to"]))})
    listed = F.when(F.size("one_way_devices_against_flow") > 0, F.array_join("one_way_devices_against_flow", ", "))
    return b.add("paths", own, [F.col("nth")], F.lit(b.result.meta["route_semantics"]), nodes=F.array_join("nodes", " - "), length=F.col("length"), against=F.when(F.col("pipes_against_flow") > 0, F.col("pipes_against_flow")), one_way=listed, blocked=b.blocked)


def _properties(b: _Builder) -> DataFrame | None:
    rows = b.result.sections.get("attributes") if b.result.tool == "list_entities" else b.result.sections.get("properties")
    if rows is None:
        return None
    given = rows if "status" in rows.columns else rows.select("entity_id", F.col("property").alias("name"), F.lit("found").alias("status"), "property", "value", "scope", "source_object_id")
    own = b.named(given.withColumn("source_object_id", F.coalesce("source_object_id", "entity_id")) if "source_object_id" in given.columns else given.withColumn("source_object_id", F.col("entity_id")), "source_object_id")
    return b.add("properties", own, [F.col("status") == "missing", F.col("entity_id"), F.col("name"), F.col("property"), F.col("source_object_id"), F.col("value")], F.col("status"), label=F.col("source_object_id_label"), property=F.coalesce("property", "name"), value=F.col("value"))


def _boundaries(b: _Builder) -> DataFrame | None:
    rows = b.result.sections.get("boundaries")
    if rows is None:
        return None
    return b.add("boundaries", b.named(rows, "node"), [F.col("node"), F.col("id"), F.col("entered")], F.lit("chamber"), label=F.col("node_label"), entered=F.col("entered"), blocked=F.col("blocked"))


def _derived(b: _Builder) -> DataFrame | None:
    """Rows of the composite analyses: predicate, subject, object, value, and what else they say."""
    rows = b.result.sections.get("derived")
    if rows is None:
        return None
    has = lambda c, kind="string": F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    own = rows.withColumns({"value": has("value"), "side": has("side"), "line": has("line"), "size": has("size"), "kind": has("kind"), "elements": has("elements", "array<string>"), "sizes": has("sizes", "array<string>"), "ends_at": has("ends_at"), "fail_action": has("fail_action"), "relieves_region": has("relieves_region", "boolean"), "nothing_drawn_beyond": has("nothing_drawn_beyond", "boolean"), "id": has("id")})
    own = b.named(own, "subject", "object")
    pipe = F.concat_ws(", ", F.concat(F.lit("line "), "line"), "size")
    run = F.col("predicate") == "line_run"
    flag = lambda c: F.when(c, "yes")
    nowhere = F.lit("a point that is not drawn")
    return b.add(
        "derived", own, [F.col("predicate"), F.col("subject"), F.col("object"), F.col("id"), F.col("value")], F.col("predicate"), F.col("predicate"),
        subject=F.when(run, F.coalesce("subject_label", nowhere)).otherwise(F.col("subject_label")), object=F.when(run, F.coalesce("object_label", nowhere)).otherwise(F.col("object_label")), value=F.col("value"), side=F.col("side"),
        line=F.when(F.col("predicate").isin("line_run", "line_meets_line"), F.col("line")).otherwise(pipe), pipe=flag(pipe != ""), nothing=flag(F.col("nothing_drawn_beyond")), relieves=flag(F.col("relieves_region")), feeds=flag(~F.col("relieves_region")),
        open=flag(F.col("kind") == "open_end"), leaves=flag(F.col("kind") == "off_page_connector"), yes=flag(F.col("value") == "true"), no=flag(F.col("value") == "false"),
        through=F.when(F.size("elements") > 0, F.array_join("elements", ", ")), sizes=F.array_join("sizes", " then "), ends_at=F.col("ends_at"), fail=F.col("fail_action"),
    )


def _status(b: _Builder) -> tuple[DataFrame, list[DataFrame]]:
    """The rows of E<step>.0, which several may share, and their facts."""
    r, spark = b.result, b.service.spark
    ref = f"E{b.step}.0"
    facts: list[DataFrame] = []
    asked = next((str(r.arguments[k]) for k in ("query", "entity_id", "start_entity_id", "source_entity_id", "line", "entity_type") if r.arguments.get(k)), None)
    frame = lambda rows, ddl: spark.createDataFrame(rows, f"run_id string, ref string, tool string, {ddl}")
    own = (b.run_id, ref, r.tool)
    if r.status in ("not_found", "ambiguous") and asked:
        names = r.sections.get("entities") if r.status == "ambiguous" else r.sections.get("suggestions")
        column = next((c for c in ("entity_id", "id") if names is not None and c in names.columns), None)
        # As many names as one query has candidates or suggestions.
        several = names.select(F.col(column).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("candidates")) if column else spark.createDataFrame([([],)], "candidates array<string>")
        facts.append(ft.of_lookups(several.select(F.lit(b.run_id).alias("run_id"), F.lit(ref).alias("ref"), F.lit(r.tool).alias("tool"), F.lit(asked).alias("query"), F.lit(r.status).alias("status"), "candidates")))
    if miss := r.meta.get("no_path"):
        facts.append(ft.of_missing_path(frame([(*own, miss["source"], miss["target"])], "source string, target string"), miss["direction"]))
    if r.tool == "traverse" and r.status == "empty":
        absent = grounding.absence_facts(r.sections["flags"], spark.createDataFrame([], "query_id string"), bool(r.meta.get("limited")))
        facts.append(ft.fact(absent.select(F.lit(b.run_id).alias("run_id"), F.lit(ref).alias("ref"), F.lit(r.tool).alias("tool"), F.col("predicate").alias("p"), "subject"), F.col("p"), subject="subject", qualifiers=ft.qualifiers(direction=F.lit(b.direction))))
    said = r.message if r.status != "success" else None
    rows = [spark.createDataFrame([(said,)], "said string").where("said is not null").select(F.lit("said").alias("case"), slots(said=F.col("said")).alias("slots"))]
    if "endpoints" in r.sections:
        ends = b.named(r.sections["endpoints"].withColumn("node", F.col("id")), "node")
        rows.append(ends.select(F.col("kind").alias("case"), slots(label=F.col("node_label")).alias("slots")))
        there = ends.select(F.lit(b.run_id).alias("run_id"), F.lit(ref).alias("ref"), F.lit(r.tool).alias("tool"), "node")
        facts.append(ft.fact(there, "terminal", subject="node", qualifiers=ft.qualifiers(direction=F.lit(b.direction))))
        cut = r.sections["frontier"].select(F.lit(b.run_id).alias("run_id"), F.lit(ref).alias("ref"), F.lit(r.tool).alias("tool"), "node").distinct()
        facts.append(ft.fact(cut, "continues_beyond_depth", subject="node", qualifiers=ft.qualifiers(direction=F.lit(b.direction))))
    every = reduce(DataFrame.unionByName, rows)
    null = F.lit(None).cast("string")
    out = every.select(F.lit(b.run_id).alias("run_id"), F.lit(b.step).alias("step"), F.lit(ref).alias("ref"), F.lit("status").alias("section"), F.lit(0).cast("long").alias("ord"), F.lit(r.tool).alias("operation"), F.lit(r.meta.get("route_semantics")).cast("string").alias("semantics"), null.alias("predicate"), F.lit(True).alias("main"), "case", "slots")
    return out, facts


def of(result: Result, service: Service, run_id: str, step: int) -> Evidence:
    """The evidence of one call, as the step-th of its run."""
    b, spark = _Builder(result, service, run_id, step), service.spark
    for build in (_entities, _connections, _paths, _properties, _boundaries, _derived):
        if result.status in ("success", "empty"):
            build(b)
    rows, parts = b.numbered()
    status, facts = _status(b)
    sections = [s for s in grounding.SECTIONS for name, _ in b.parts if name == s]
    postings = [spark.createDataFrame([], POSTING)]
    for section, own in zip(sections, parts, strict=True):
        postings.append(postings_of(own.drop("case", "slots", "tool", "predicate_", "ord"), section))
        if section == "entities":
            facts.append(ft.of_entities(own, service.identifiers))
            if "distance" in own.columns:
                facts.append(ft.of_reach(own.withColumns({"query_id": F.lit(result.meta["start"]), "node": F.col("id")}), b.direction))
        elif section == "connections":
            facts.append(ft.of_connections(own))
        elif section == "paths":
            facts.append(ft.of_paths(own, result.arguments.get("direction", "downstream")))
        elif section == "properties":
            facts.append(ft.of_report(own))
        elif section == "boundaries":
            facts.append(ft.of_boundaries(own, b.direction))
        elif section == "derived":
            facts.append(ft.of_derived(own))
    children = result.sections.get("sub_objects")
    if children is not None and "owner_id" in children.columns:
        first = f"E{step}.1"
        facts.append(ft.of_sub_objects(children.withColumns({"run_id": F.lit(run_id), "ref": F.lit(first), "tool": F.lit(result.tool)})))
    if "suggestions" in result.sections:
        hints = result.sections["suggestions"].withColumns({"run_id": F.lit(run_id), "ref": F.lit(f"E{step}.0")})
        postings.append(postings_of(hints.drop("query", "score", "ratio"), "status"))
    # Several rows may stand at E<step>.0, so their sentences are told apart by what fills them.
    numbered = keep(rows.unionByName(status).withColumn("row_id", F.monotonically_increasing_id()), "numbered")
    rows = keep(sentences(numbered, ["row_id"]).drop("row_id"), "evidence")
    made = keep(ft.union(*facts) if facts else spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in ft.COLUMNS.items())), "facts")
    return Evidence(rows, made, keep(reduce(DataFrame.unionByName, postings), "postings"))


def union(*parts: Evidence) -> Evidence:
    return Evidence(*(reduce(DataFrame.unionByName, [getattr(p, name) for p in parts]) for name in ("rows", "facts", "postings")))


def store(evidence: Evidence, path: str) -> None:
    """Appends to the tables under path, partitioned by run."""
    for name in ("rows", "facts", "postings"):
        getattr(evidence, name).write.mode("append").partitionBy("run_id").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, runs: list[str] | None = None) -> Evidence:
    """The evidence of some runs, or of all; only their folders are read."""
    out = []
    for name in ("rows", "facts", "postings"):
        df = spark.read.parquet(f"{path}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
        out.append(df.where(F.col("run_id").isin(runs)) if runs is not None else df)
    return Evidence(*out)


def written_out(cited: DataFrame, rows: DataFrame) -> DataFrame:
    """cited: run_id, id, n (order), refs. rows: with text. run_id, id, written: a line for each cited row; R<step> stands for its result's main rows, in their order."""
    each = cited.select("run_id", "id", "n", F.posexplode("refs").alias("pos", "r"))
    said = rows.where("text is not null")
    whole = F.concat(F.lit("R"), F.col("step").cast("string"))
    by = said.select("run_id", F.col("ref").alias("r"), "ref", "ord", "text").unionByName(said.where("main").select("run_id", whole.alias("r"), "ref", "ord", "text"))
    # The status comes after a result's rows, and a row that is cited twice is written once.
    hit = each.join(by, ["run_id", "r"]).withColumn("late", F.col("ord") == 0)
    first = hit.groupBy("run_id", "id", "ref", "text").agg(F.min(F.struct("n", "pos", "late", "ord")).alias("at"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "text", "ref"))), lambda x: F.concat(F.lit("- "), x["text"], F.lit(" ["), x["ref"], F.lit("]")))
    return first.groupBy("run_id", "id").agg(F.array_join(lines, "\n").alias("written"))
