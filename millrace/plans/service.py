"""Ten operations on one drawing, called by name with checked arguments.

Each returns a Result: a status and DataFrames by section, never a dump of rows on the driver. Only names are bound on the driver: a text becomes
one entity, or the result says not_found (with suggestions) or ambiguous.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import analysis, graph, resolve
from millrace.operators import properties as attributes
from millrace.plans.storage import keep
from millrace.sources.drawings import Plant

DIRECTIONS = ("downstream", "upstream", "both")
PATH_DIRECTIONS = ("downstream", "upstream", "any")

RELATIONSHIPS = ("piping", "instrumentation", "all")
TEXTS = (list, str)

#: Operation -> argument -> (type, required).
ARGUMENTS: dict[str, dict[str, tuple[type | tuple[type, ...], bool]]] = {
    "find_entities": {"query": (str, True), "entity_type": (str, False)},
    "list_entities": {"entity_type": (str, False), "properties": (list, False), "property_filter": (dict, False)},
    "get_entity": {"entity_id": (str, True), "include_children": (bool, False)},
    "get_connections": {"entity_id": (str, True), "direction": (str, False), "relationship": (str, False)},
    "traverse": {"start_entity_id": (str, True), "direction": (str, True), "entity_types": (list, False), "max_depth": (int, False), "stop_at_types": (list, False), "blocked_entity_ids": (list, False)},
    "find_path": {"source_entity_id": (str, True), "target_entity_id": (str, True), "direction": (str, False), "all_paths": (bool, False), "blocked_entity_ids": (list, False)},
    "get_properties": {"ids": (TEXTS, True), "requested_properties": (list, False)},
    "isolation_boundary": {"entity_id": (str, True)},
    "trace_instrumentation": {"entity_id": (str, True)},
    "trace_line": {"line": (str, True)},
}


def kind_name(kind: type | tuple[type, ...]) -> str:
    return " or ".join(x.__name__ for x in kind) if isinstance(kind, tuple) else kind.__name__


@dataclass
class Result:
    tool: str
    status: str = "success"
    message: str | None = None
    warnings: list[str] = field(default_factory=list)
    sections: dict[str, DataFrame] = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    arguments: dict = field(default_factory=dict)


class Stop(Exception):
    """Carries a status and message to the result."""

    def __init__(self, status: str, message: str, **sections: DataFrame):
        self.status, self.message, self.sections = status, message, sections


class Service:
    def __init__(self, plant: Plant, drawing_id: str):
        one = lambda df: df.where(F.col("drawing_id") == drawing_id).drop("drawing_id")
        self.entities, self.sub_objects, self.edges, self.properties, self.objects = map(one, (plant.entities, plant.sub_objects, plant.connections, plant.properties, plant.objects))
        self.names = one(plant.identifiers).select("entity_id", F.when(F.col("field") == "tagName", "tag").otherwise(F.col("field")).alias("field"), "value")
        self.spark: SparkSession = plant.entities.sparkSession

    # What names are resolved by is written once, when the first name needs it: every resolution reads it several times, and a call by ids does not.
    @cached_property
    def identifiers(self) -> DataFrame:
        ids = self.entities.select(F.col("id").alias("entity_id"), F.lit("id").alias("field"), F.col("id").alias("value"))
        return keep(self.names.unionByName(ids), "identifiers")

    @cached_property
    def phrases(self) -> DataFrame:
        types = self.entities.select(F.col("id").alias("entity_id"), F.explode("type_hierarchy").alias("type"))
        return keep(resolve.type_phrases(types).unionByName(resolve.category_phrases(self.entities.select(F.col("id").alias("entity_id"), "category"))).distinct(), "phrases")

    @cached_property
    def places(self) -> DataFrame:
        return keep(self.entities.select(F.col("id").alias("entity_id"), (F.col("category") == "piping_line").alias("is_line"), F.col("line_number").alias("line")), "places")

    @cached_property
    def known(self) -> resolve.Catalogue:
        return resolve.Catalogue(self.identifiers, self.phrases, self.places)

    def call(self, tool: str, arguments: str | dict) -> Result:
        """Never raises for what the caller got wrong: an unknown operation or a bad argument is a result of status error."""
        if tool not in ARGUMENTS:
            return Result(tool, "error", f"unknown operation {tool!r}; there are {', '.join(ARGUMENTS)}")
        try:
            args = json.loads(arguments) if isinstance(arguments, str) else dict(arguments)
        except ValueError as e:
            return Result(tool, "error", f"arguments are no JSON: {e}")
        schema = ARGUMENTS[tool]
        wrong = [f"unknown argument {k!r}" for k in args if k not in schema] + [f"{k!r} is required" for k, (_, need) in schema.items() if need and k not in args]
        wrong += [f"{k!r} must be {kind_name(kind)}" for k, (kind, _) in schema.items() if args.get(k) is not None and (not isinstance(args[k], kind) or (kind is int and isinstance(args[k], bool)))]
        if wrong:
            return Result(tool, "error", "; ".join(wrong))
        result = Result(tool, arguments=args)
        try:
            getattr(self, tool)(result, **{k: v for k, v in args.items() if v is not None})
        except Stop as s:
            result.status, result.message = s.status, s.message
            result.sections |= s.sections
        return result

    def _frame(self, values: list[str], column: str) -> DataFrame:
        return self.spark.createDataFrame([(v,) for v in values], f"{column} string")

    def _entity(self, result: Result, name: str, topology: bool = False):
        own = self.entities.where(F.col("id") == name).first()
        if own is None:
            found = resolve.resolve_all(self._frame([name], "query"), self.known)
            rows = found.limit(2).collect()
            if len(rows) > 1:
                raise Stop("ambiguous", f"{name!r} names several entities", entities=found)
            if not rows:
                raise Stop("not_found", f"no entity {name!r}", suggestions=resolve.suggestions(self._frame([name], "query"), self.identifiers))
            result.warnings += [f"{name!r} was taken as {rows[0].entity_id}", *rows[0].warnings]
            result.meta.setdefault("resolved", {})[name] = {"id": rows[0].entity_id, "tier": rows[0].tier, "confidence": rows[0].confidence}
            own = self.entities.where(F.col("id") == rows[0].entity_id).first()
        if topology and not own.in_topology:
            raise Stop("error", f"{own.id} is a line, not an item of the topology")
        return own

    def _choice(self, name: str, value: str, known: tuple[str, ...]) -> None:
        if value not in known:
            raise Stop("error", f"{name} must be one of {', '.join(known)}")

    def _of_types(self, result: Result, types: list[str] | None) -> DataFrame | None:
        """Ids of entities of any of the types; an unknown type matches nothing and is warned of."""
        if not types:
            return None
        named = resolve.types_named(self._frame(list(map(str, types)), "name"), self.phrases)
        unknown = [r.name for r in named.where("phrase is null").orderBy("name").collect()]
        result.warnings += [f"unknown type {t!r}" for t in unknown]
        result.meta["unknown_types"] = [*result.meta.get("unknown_types", []), *unknown]
        return self.phrases.join(named, "phrase", "left_semi").select(F.col("entity_id").alias("node")).distinct()

    def _blocked(self, result: Result, names: list[str] | None, *ends: str) -> DataFrame | None:
        if not names:
            return None
        ids = [self._entity(result, n, True).id for n in names]
        if set(ids) & set(ends):
            raise Stop("error", "an end of the search can't be blocked")
        return self._frame(ids, "node")

    def _start(self, node: str) -> DataFrame:
        return self.spark.createDataFrame([(node, node)], "query_id string, node string")

    def _roles(self) -> DataFrame:
        return self.entities.select(F.col("id").alias("node"), analysis.piping_role(F.col("type_hierarchy"), F.col("category")).alias("role"))

    def _sized(self) -> DataFrame:
        bag = F.col("properties")
        return self.edges.withColumns({"line": bag["lineNumber"], "size": bag["nominalDiameterRepresentation"]})

    def _summary(self, rows: DataFrame, *more: str) -> DataFrame:
        counts = graph.link_counts(self.edges)
        own = self.entities.select("id", "type", "category", "tag", "name", "ord")
        return rows.join(own, rows["entity_id"] == own["id"]).join(counts, "entity_id", "left").select("id", "type", "category", "tag", "name", *more, *counts.columns[1:], "ord")

    def find_entities(self, result: Result, query: str, entity_type: str | None = None) -> None:
        q = self._frame([query.strip()], "query")
        found = resolve.resolve_all(q, self.known)
        kinds = self._of_types(result, [entity_type] if entity_type else None)
        match = found.first()
        by_name = match is not None and match.tier != "type"
        if match is not None:
            result.warnings += match.warnings
        if kinds is not None:
            fits = found.join(kinds.withColumnRenamed("node", "entity_id"), "entity_id", "left_semi")
            if not query.strip():
                found = kinds.select(F.lit("").alias("query"), F.col("node").alias("entity_id"), F.lit("type").alias("tier"), F.lit(resolve.TIERS["type"]).alias("confidence"), F.lit(False).alias("ambiguous"), F.expr("cast(array() as array<string>)").alias("warnings"))
            elif not fits.isEmpty():
                found = fits.withColumn("ambiguous", F.col("ambiguous") & (F.count(F.lit(1)).over(Window.partitionBy("query")) > 1))
            elif by_name and not result.meta["unknown_types"]:
                # A line with a type names the items of that type on it; else an identifier is the stronger word.
                on = found.join(self.places, "entity_id")
                items = self.places.where("not is_line").join(on.where("is_line").select("line").distinct(), "line").join(kinds.withColumnRenamed("node", "entity_id"), "entity_id", "left_semi")
                if on.where("not is_line").isEmpty() and not items.isEmpty():
                    several = F.count(F.lit(1)).over(Window.partitionBy("query")) > 1
                    base = items.select(F.lit(query).alias("query"), "entity_id", F.lit("embedded_identifier").alias("tier"), F.lit(resolve.TIERS["embedded_identifier"]).alias("confidence"))
                    found = base.withColumns({"ambiguous": several, "warnings": F.expr("cast(array() as array<string>)")})
                else:
                    result.warnings.append(f"what {query!r} names is not of type {entity_type!r}; it is returned all the same")
            elif by_name:
                result.warnings.append("the type was not used")
            else:
                found = fits
        found = keep(found, "found")
        if found.isEmpty():
            raise Stop("not_found", self._explained(query.strip()), suggestions=resolve.suggestions(q, self.identifiers))
        result.sections["entities"] = self._summary(found, "tier", "confidence", "ambiguous").orderBy("ord").drop("ord")
        if found.where("ambiguous").limit(1).count():
            result.status, result.message = "ambiguous", f"{query!r} names no single entity; give an id, or the line or type"

    def _explained(self, name: str) -> str:
        """What an id that is no entity's stands for."""
        if link := self.edges.where(F.col("id") == name).first():
            return f"{name} is no entity but a connection ({link.connection_type}) from {link.source} to {link.target}"
        if thing := self.objects.where(F.col("id") == name).first():
            return f"{name} is no entity but an object of type {thing.type}" + (f" of {thing.owner_entity_id}" if thing.owner_entity_id else "")
        return f"nothing is named {name!r}"

    def list_entities(self, result: Result, entity_type: str | None = None, properties: list | None = None, property_filter: dict | None = None) -> None:
        out, kinds = self.entities, self._of_types(result, [entity_type] if entity_type else None)
        if not entity_type and not property_filter:
            result.sections |= {"types": attributes.catalogue(self.entities).orderBy("type"), "categories": self.entities.groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy("category"), "other_objects": self.objects.where("type = 'MetaData'").select("id")}
            return
        if kinds is not None:
            out = out.join(kinds.withColumnRenamed("node", "id"), "id", "left_semi")
        if property_filter:
            out = out.join(attributes.having(self.properties, [(k, str(v)) for k, v in property_filter.items()]).withColumnRenamed("entity_id", "id"), "id", "left_semi")
        result.sections["entities"] = out.select("id", "type", "category", "tag", "name", "ord").orderBy("ord")
        if wanted := [*map(str, properties or []), *(k for k in property_filter or {} if k not in (properties or []))]:
            ids = out.select(F.col("id").alias("entity_id"))
            own = self.properties.where("scope not in ('connection', 'object')").join(ids, "entity_id", "left_semi")
            result.sections["attributes"] = attributes.report(own, ids.select("entity_id", F.explode(F.array(*map(F.lit, wanted))).alias("name"))).where("status = 'found'")
        if out.isEmpty():
            result.status, result.message = "empty", f"no {entity_type or 'entity'} of that kind"
            result.sections["types"] = attributes.catalogue(self.entities).orderBy("type")

    def get_entity(self, result: Result, entity_id: str, include_children: bool = False) -> None:
        own = self._entity(result, entity_id)
        children = self.sub_objects.where(F.col("owner_id") == own.id).orderBy("ord")
        result.sections["entities"] = self.entities.where(F.col("id") == own.id).join(graph.link_counts(self.edges).withColumnRenamed("entity_id", "id"), "id", "left")
        result.sections["sub_objects"] = children if include_children else children.select("id", "type")

    def get_connections(self, result: Result, entity_id: str, direction: str = "both", relationship: str = "all") -> None:
        self._choice("direction", direction, DIRECTIONS)
        self._choice("relationship", relationship, RELATIONSHIPS)
        own = self._entity(result, entity_id, True)
        if direction != "both" and relationship != "piping":
            result.warnings.append("direction selects piping only; instrumentation links are all listed")
        found = graph.adjacency(self.edges, self.entities.where(F.col("id") == own.id), direction, relationship)
        named = self.entities.select(F.col("id").alias("other"), F.col("name").alias("other_name"), F.col("type").alias("other_type"), F.col("category").alias("other_category"))
        more = self.edges.select("id", "connection_type", "properties", "source_nozzle", "target_nozzle", "source_chamber", "target_chamber", "open_end")
        result.sections["connections"] = found.join(more, "id").join(named, "other", "left").orderBy("ord")
        result.sections["entities"] = self.entities.where(F.col("id") == own.id).select("id", "type", "category", "tag", "name")
        if found.isEmpty():
            result.status, result.message = "empty", f"no {'' if relationship == 'all' else relationship + ' '}connections of {own.id} in direction {direction}"

    def traverse(self, result: Result, start_entity_id: str, direction: str, entity_types: list | None = None, max_depth: int | None = None, stop_at_types: list | None = None, blocked_entity_ids: list | None = None) -> None:
        self._choice("direction", direction, DIRECTIONS)
        own = self._entity(result, start_entity_id, True)
        depth = graph.clamp_depth(max_depth)
        if max_depth is not None and depth != max_depth:
            result.warnings.append(f"max_depth was set to {depth}")
        wanted, stops = self._of_types(result, entity_types), self._of_types(result, stop_at_types)
        t = graph.traverse(self.edges, self._start(own.id), direction, depth, stops, self._blocked(result, blocked_entity_ids, own.id))
        ends = graph.endpoints(self.edges, t.reached, direction) if direction != "both" else t.reached.limit(0)
        reached = t.reached if wanted is None else t.reached.join(wanted, "node", "left_semi")
        equipment = self.entities.where("category = 'equipment'").select(F.col("id").alias("between"))
        through = reached.select("node", F.posexplode("through").alias("pos", "between")).join(equipment, "between").groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "between"))), lambda x: x["between"]).alias("all"))
        rows = reached.join(self.entities, reached["node"] == self.entities["id"]).join(through, "node", "left")
        rows = rows.select("id", "type", "category", "tag", "name", "distance", "path", F.element_at("path", -1)["from"].alias("via"), F.coalesce("all", F.expr("cast(array() as array<string>)")).alias("through_equipment"))
        last = graph.terminal(self.edges, rows.select(F.col("id").alias("node")), direction).select(F.col("node").alias("id"), "terminal")
        result.sections["entities"] = rows.join(last, "id").orderBy("distance", "id")
        steps = reached.select(F.explode("path").alias("s")).select("s.id").distinct()
        result.sections["connections"] = self.edges.join(steps, "id", "left_semi").orderBy("ord")
        kind = F.when(F.contains("type", F.lit("OffPageConnector")), "drawing_end").otherwise("end_of_piping")
        ends = ends.select(F.col("node").alias("id")).join(self.entities.select("id", "type", "name"), "id").withColumn("kind", kind)
        result.sections |= {"boundaries": t.boundaries, "endpoints": ends.orderBy("id"), "frontier": t.frontier, "stopped": t.stopped, "blocked": t.blocked, "flags": t.flags, "open_ends": graph.open_ends(self.edges, t.states, self._start(own.id), direction)}
        flags = t.flags.first()
        result.meta |= {"start": own.id, "max_depth": depth, "route_semantics": graph.route_semantics(direction), "cycle_detected": flags.cycle_detected, "start_is_in_cycle": flags.returns_to_start, "truncated_by_max_depth": flags.truncated, "limited": bool(stop_at_types or result.meta.get("unknown_types"))}
        if reached.isEmpty():
            result.status, result.message = "empty", f"nothing found {direction} of {own.id} within depth {depth}"

    def find_path(self, result: Result, source_entity_id: str, target_entity_id: str, direction: str = "downstream", all_paths: bool = False, blocked_entity_ids: list | None = None) -> None:
        self._choice("direction", direction, PATH_DIRECTIONS)
        a, b = self._entity(result, source_entity_id, True).id, self._entity(result, target_entity_id, True).id
        if a == b:
            raise Stop("error", "source and target are the same entity")
        travel = "both" if direction == "any" else direction
        blocked = self._blocked(result, blocked_entity_ids, a, b)
        pairs = self.spark.createDataFrame([("q", a, b)], "query_id string, source string, target string")
        result.meta["route_semantics"] = graph.route_semantics(travel)
        best = graph.shortest_path(self.edges, pairs, travel, blocked)
        if best.isEmpty():
            result.status, result.message = "empty", f"nothing drawn leads {'either way' if direction == 'any' else direction} from {a} as far as {b}"
            result.meta["no_path"] = {"source": a, "target": b, "direction": direction, "blocked": list(blocked_entity_ids or [])}
            if direction != "any" and blocked is None:
                opposite = "upstream" if direction == "downstream" else "downstream"
                if not graph.shortest_path(self.edges, pairs, opposite).isEmpty():
                    result.warnings.append(f"there is a route {opposite}")
            return
        routes = graph.simple_paths(self.edges, pairs, travel, blocked) if all_paths else best.select("query_id", F.lit(1).alias("nth"), F.col("distance").alias("length"), "path", F.lit(None).cast("boolean").alias("more"))
        result.sections["paths"] = graph.annotate_routes(routes, self._roles())

    def get_properties(self, result: Result, ids: list | str, requested_properties: list | None = None) -> None:
        known, wrong = [], []
        for name in [ids] if isinstance(ids, str) else list(map(str, ids)):
            other = self.edges.select("id").unionByName(self.objects.select("id")).where(F.col("id") == name).first()
            try:
                known.append((name, name if other is not None else self._entity(result, name).id))
            except Stop as s:
                wrong.append((name, s.status, s.message))
                result.warnings.append(s.message)
        if wrong:
            result.sections["errors"] = self.spark.createDataFrame(wrong, "asked string, error string, message string")
        if not known:
            result.status, result.message = "not_found", "none of the ids is in the drawing"
            return
        asked = self.spark.createDataFrame(list(dict.fromkeys(known)), "asked string, entity_id string")
        own = self.properties.join(asked.select("entity_id").distinct(), "entity_id", "left_semi")
        if requested_properties:
            wanted = asked.select("entity_id", F.explode(F.array(*(F.lit(str(x)) for x in requested_properties))).alias("name")).distinct()
            result.sections["properties"] = attributes.report(own, wanted)
            found = result.sections["properties"].where("status = 'found'")
        else:
            found = result.sections["properties"] = own
        result.sections["available"] = own.groupBy("entity_id").agg(F.array_sort(F.collect_set("property")).alias("available"))
        if found.isEmpty():
            result.status, result.message = "empty", "none of the ids has such a property"

    def isolation_boundary(self, result: Result, entity_id: str) -> None:
        own = self._entity(result, entity_id, True)
        out = analysis.isolation_boundary(self.edges, self._roles(), self._start(own.id))
        result.sections |= {"region": out.region, "derived": analysis.isolation_rows(self._sized(), out), "summary": out.summary}
        result.sections["entities"] = self.entities.where(F.col("id") == own.id).select("id", "type", "category", "tag", "name")
        if out.summary.isEmpty():
            result.status, result.message = "empty", f"{own.id} has no piping connections"

    def trace_instrumentation(self, result: Result, entity_id: str) -> None:
        own = self._entity(result, entity_id)
        members, chains = analysis.trace_instrumentation(self.edges, self.entities.select(F.col("id").alias("node"), "category"), self._start(own.id))
        types = self.entities.select(F.col("id").alias("node"), "type")
        rows = analysis.loop_rows(self.edges, types, self.properties.where("scope <> 'object'"), chains)
        used = chains.select(F.explode("links").alias("id")).distinct()
        result.sections |= {"members": members, "chains": chains, "derived": rows, "connections": self.edges.join(used, "id", "left_semi").orderBy("ord")}
        result.sections["properties"] = self.properties.join(members.select(F.col("node").alias("entity_id")), "entity_id", "left_semi")
        if members.isEmpty():
            result.status, result.message = "empty", f"{own.id} has no instrumentation links"

    def trace_line(self, result: Result, line: str) -> None:
        edges = self._sized()
        words = self._frame([line, *line.split()], "word").select(text.normalize_identifier(F.col("word")).alias("norm"))
        known = edges.where("line is not null").select("line", text.normalize_identifier(F.col("line")).alias("norm")).distinct()
        hit = known.join(words, "norm", "left_semi").first()
        if hit is None:
            # Not a line's number: the line that an entity is, or is on.
            named = resolve.resolve_all(self._frame([line], "query"), self.known).limit(2).collect()
            on = self.places.where(F.col("entity_id") == named[0].entity_id).first() if len(named) == 1 else None
            hit = known.where(F.col("line") == on.line).first() if on is not None and on.line else None
        if hit is None:
            raise Stop("not_found", f"no line {line!r}", lines=known.select("line").orderBy("line"))
        result.meta["line"] = hit.line
        on = F.col("line") == hit.line
        runs, meets = analysis.trace_line(edges, self._roles())
        runs, meets = keep(runs.where(on), "runs"), keep(meets.where(on), "meetings")
        result.sections |= {"runs": runs, "meetings": meets, "derived": analysis.line_rows(edges, runs, meets), "connections": self.edges.where(F.col("properties")["lineNumber"] == hit.line).orderBy("ord")}
