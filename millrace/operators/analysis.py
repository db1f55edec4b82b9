"""Composite operators on drawings: isolation boundaries, instrument loops, lines in runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.operators.components import numbered, together
from millrace.operators.stretches import jumped
from millrace.plans.storage import forget, keep

#: Class in a component's ancestry -> its role, the first that fits.
ROLES = [("OperatedValve", "isolation_valve"), ("CheckValve", "check_valve"), ("SafetyValveOrFitting", "relief_device"), ("PipeOffPageConnector", "off_page_connector")]
#: Link that names what is measured, link that names what is operated, class of a loop's functions, property of an actuator.
MEASURES, OPERATES, FUNCTION, FAIL_ACTION = "sensing_location", "operated_valve_reference", "ProcessInstrumentationFunction", "failAction"
#: How a run of a line ends.
ENDS = {"off_page_connector": "the piping leaves the drawing here", "equipment": "equipment", "end": "end of the drawn piping", "junction": "junction", "open": "not represented on this drawing"}
NO_SIZE = "size not given"
#: Links drawn against the way the signal goes.
REVERSED = ("sensing_location",)
#: Hops after which what a flood has reached becomes one table again.
FOLD = 16


def piping_role(type_hierarchy: Column, category: Column) -> Column:
    out = F.when(category == "equipment", "equipment").otherwise("fitting")
    for name, role in reversed(ROLES):
        out = F.when(F.array_contains(type_hierarchy, name), role).otherwise(out)
    return out


@dataclass
class Isolation:
    """region: query_id, node, side (null for the start). rows: query_id, predicate, object, side, id (connection), kind or flag. summary: one row per start."""

    region: DataFrame
    rows: DataFrame
    summary: DataFrame


def isolation_boundary(edges: DataFrame, roles: DataFrame, starts: DataFrame) -> Isolation:
    """From each of starts (query_id, node) along pipes in both ways, past fittings, up to the first valve, relief device, equipment, connector or open end of each branch.

    roles: node, role. A pipe is used once per start: by the node that reaches it first. Every FOLD hops the tables so far are written as one, so a hop reads FOLD tables at most.
    """
    piping = edges.where("relationship = 'piping'")
    out = piping.select(F.col("source").alias("from"), F.col("target").alias("to"), F.lit("downstream").alias("way"), "id", "ord")
    back = piping.select(F.col("target").alias("from"), F.col("source").alias("to"), F.lit("upstream").alias("way"), "id", "ord")
    kinds = roles.select(F.col("node").alias("to"), "role")
    step = keep(out.unionByName(back).where("from is not null").join(kinds, "to", "left"), "steps")
    frontier = starts.select("query_id", "node", F.lit(None).cast("string").alias("side"), F.expr("cast(array() as array<bigint>)").alias("turns"))
    region, before = frontier, frontier
    used = met = walls = None
    loose, folded = [], []
    while True:
        near = frontier.join(step, frontier["node"] == step["from"])
        if used is not None:
            near = near.join(used, ["query_id", "id"], "left_anti")
        first = Window.partitionBy("query_id", "id").orderBy("turns", "ord")
        near = near.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
        # Hops go along pipes in both ways, so what is next to a node that was reached by the last hop was itself reached by that hop or the one before, or is a wall, which is never passed.
        seen = before.select("query_id", "node").unionByName(frontier.select("query_id", "node"))
        seen = seen if walls is None else seen.unionByName(walls)
        known = seen.select("query_id", F.col("node").alias("to"), F.lit(True).alias("known")).distinct()
        near = near.join(known, ["query_id", "to"], "left")
        role = F.when(F.col("to").isNull(), "open_end").otherwise(F.coalesce("role", F.lit("fitting")))
        near = near.select("query_id", "node", "to", "id", "way", F.coalesce("side", "way").alias("side"), F.concat("turns", F.array(F.col("ord").cast("long"))).alias("turns"), role.alias("role"), F.coalesce("known", F.lit(False)).alias("known"))
        # Of several pipes to one new node, the first counts, unless the node never becomes seen.
        again = F.row_number().over(Window.partitionBy("query_id", "to").orderBy("turns")) > 1
        repeats = F.col("role").isin("open_end", "off_page_connector", "equipment")
        near = keep(near.withColumn("late", again & ~repeats), "isolation")
        met = near if met is None else met.unionByName(near)
        # A pipe that was used before was used by the last hop, for the same reason.
        used = near.select("query_id", "id")
        new = near.where("not known and not late and role not in ('open_end', 'off_page_connector', 'equipment')")
        before, frontier = frontier, new.where("role = 'fitting'").select("query_id", F.col("to").alias("node"), "side", "turns")
        shut = new.where("role <> 'fitting'").select("query_id", F.col("to").alias("node"))
        walls = shut if walls is None else walls.unionByName(shut)
        if frontier.isEmpty():
            break
        region = region.unionByName(frontier)
        loose.append(near)
        if len(loose) == FOLD:
            frontier = keep(frontier, "frontier")
            now = [keep(df, "isolation") for df in (met, used, walls, region, before)]
            for old in (*loose, *folded):
                forget(old)
            met, used, walls, region, before = now
            loose, folded = [], [*now, frontier]
    counted = met.where("not known and not late")
    degree = graph.degree(edges)
    kind = F.when(F.col("role") == "isolation_valve", "isolation_boundary_valve").when(F.col("role") == "check_valve", "check_valve_on_boundary").when(F.col("role") == "relief_device", "relief_device_on_boundary").when(F.col("role") != "fitting", "unisolated_connection")
    rows = counted.select("query_id", kind.alias("predicate"), F.col("to").alias("object"), "side", "id", F.when(kind == "unisolated_connection", F.col("role")).alias("kind"), F.when(F.col("role") == "relief_device", F.col("way") == "downstream").alias("relieves_region")).where("predicate is not null")
    ends = region.where("side is not null").join(degree.where("degree = 1"), "node").select("query_id", F.lit("closed_end_in_region").alias("predicate"), F.col("node").alias("object"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("relieves_region"))
    beyond = degree.select(F.col("node").alias("object"), (F.col("degree") == 1).alias("end"))
    rows = rows.unionByName(ends).join(beyond, "object", "left").withColumn("nothing_drawn_beyond", F.when(F.col("predicate").isin("isolation_boundary_valve", "check_valve_on_boundary"), F.coalesce("end", F.lit(False)))).drop("end")
    count = lambda p: F.count_if(F.col("predicate") == p)
    totals = rows.groupBy("query_id").agg(count("isolation_boundary_valve").alias("valves"), count("check_valve_on_boundary").alias("checks"), count("unisolated_connection").alias("unisolated"), F.count_if(F.col("relieves_region")).alias("relieving"))
    sizes = region.groupBy("query_id").agg(F.count(F.lit(1)).alias("region_size"))
    drawn = starts.join(degree, "node").select("query_id", F.col("node").alias("start"))
    summary = drawn.join(sizes, "query_id").join(totals, "query_id", "left").fillna(0)
    summary = summary.select("query_id", "start", "region_size", "valves", "checks", "unisolated", "relieving", ((F.col("unisolated") == 0) & (F.col("checks") == 0)).alias("fully_valve_bounded"), (F.col("relieving") > 0).alias("relief_path_inside_boundary"))
    return Isolation(region.select("query_id", "node", "side"), rows, summary)


def trace_instrumentation(edges: DataFrame, categories: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of each start's loop (query_id, node) and its signal chains (query_id, elements, links).

    Links run through instruments only; a measured item or a valve ends the loop. Chains are all simple paths, of any length, in signal order, from members that no link of the loop enters.
    """
    links = edges.where("relationship = 'instrumentation' and source is not null and target is not null")
    turned = F.col("connection_type").isin(*REVERSED)
    links = numbered(links.select("id", F.when(turned, F.col("target")).otherwise(F.col("source")).alias("first"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("second")))
    instrument = categories.where("category = 'instrumentation'").select("node").distinct()
    marked = lambda c: instrument.select(F.col("node").alias(c), F.lit(True).alias(f"{c}_in"))
    links = keep(together(links.join(marked("first"), "first", "left").join(marked("second"), "second", "left").fillna(False)), "links")
    # Instruments that links join lie in one part, found in a logarithm of the loop's length of rounds; other items stand at a part's edge.
    ends = F.array(F.when(F.col("first_in"), F.col("first")), F.when(F.col("second_in"), F.col("second")))
    inner = links.where("first_in and second_in").select(F.col("first").alias("source"), F.col("second").alias("target"))
    part = keep(graph.components(links.select(F.explode(ends).alias("node")).where("node is not null"), inner), "parts")
    # Links seen from an end that is no instrument.
    end = lambda node, other: F.struct(F.col(node).alias("node"), F.col(f"{node}_in").alias("own_in"), F.col(other).alias("other"), F.col(f"{other}_in").alias("other_in"))
    edge = links.where("not (first_in and second_in)").withColumn("e", F.explode(F.array(end("first", "second"), end("second", "first")))).select(*links.columns, "e.*").where("not own_in")
    plain = starts.select("query_id", "node").distinct()
    outer = keep(plain.join(edge.select("node").distinct(), "node"), "outer")
    # A start that is no instrument opens every part that it touches.
    touched = outer.join(edge.where("other_in"), "node").select("query_id", F.col("other").alias("node"))
    opened = keep(plain.unionByName(touched).join(part, "node").select("query_id", "component").distinct(), "opened")
    inside = keep(opened.join(part, "component").select("query_id", "node"), "inside")
    # A link lies in the part of its instruments, so it is found once for each query.
    columns = ["query_id", *links.columns]
    used = inside.join(links.withColumn("node", F.coalesce(*(ends[k] for k in (0, 1)))), "node").select(columns)
    used = keep(together(used.unionByName(outer.join(edge.where("not other_in"), "node").select(columns).distinct())), "used")
    others = used.where("not (first_in and second_in)").select("query_id", F.explode(F.array(F.when(~F.col("first_in"), F.col("first")), F.when(~F.col("second_in"), F.col("second")))).alias("node"))
    members = inside.unionByName(others.where("node is not null").distinct())
    return members, _chains(keep(_stretches(used.drop("first_in", "second_in")), "stretches"))


def _places(links: DataFrame, breaks: DataFrame | None = None) -> DataFrame:
    """links: query_id, id, first, second, at. breaks: query_id, node. Each link with the first link of its stretch (head) and its place in it; a stretch ends where links
    join or branch off, and at breaks. Links on closed rings, which have no first one, are left out.

    Found by pointer jumping, a logarithm of the longest stretch in rounds.
    """
    into = links.groupBy("query_id", F.col("second").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("id").alias("before"))
    out_of = links.groupBy("query_id", F.col("first").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    inner = into.join(out_of, ["query_id", "node"]).where("n_in = 1 and n_out = 1")
    inner = inner.join(breaks.select("query_id", "node").distinct(), ["query_id", "node"], "left_anti") if breaks is not None else inner
    inner = inner.select("query_id", F.col("node").alias("first"), "before")
    return jumped(links.select("query_id", "id", "first", "at").join(inner, ["query_id", "first"], "left").select("query_id", "id", "before", "at"))


def _stretches(links: DataFrame) -> DataFrame:
    """links: query_id, id, first, second, at. Links between which nothing joins or branches off, in one: query_id, first, end, inner (nodes between), links."""
    done = _places(links).join(links.drop("at"), ["query_id", "id"])
    runs = done.groupBy("query_id", "head").agg(F.array_sort(F.collect_list(F.struct("place", "id", "first", "second"))).alias("run"))
    nodes = F.transform("run", lambda x: x["second"])
    return runs.select("query_id", F.get("run", F.lit(0))["first"].alias("first"), F.element_at(nodes, -1).alias("end"), F.slice(nodes, 1, F.size(nodes) - 1).alias("inner"), F.transform("run", lambda x: x["id"]).alias("used"))


def _chains(stretches: DataFrame) -> DataFrame:
    """All simple paths from members that no link enters: query_id, elements, links. One round for each stretch of the longest."""
    # A node that links enter is within a stretch, on a closed ring, or where a stretch ends.
    entered = stretches.select("query_id", F.col("end").alias("node")).distinct()
    origins = stretches.select("query_id", F.col("first").alias("node")).distinct().join(entered, ["query_id", "node"], "left_anti")
    path = origins.select("query_id", "node", F.array("node").alias("elements"), F.expr("cast(array() as array<string>)").alias("links"))
    ended = None
    while True:
        move = path.join(stretches.withColumnRenamed("query_id", "q"), (F.col("query_id") == F.col("q")) & (F.col("node") == F.col("first")))
        back = F.array_contains("elements", F.col("end"))
        # A stretch that leads back into the path is followed as far as that.
        move = move.where(~back | (F.size("inner") > 0)).select("query_id", F.col("elements").alias("before"), back.alias("back"), F.col("end").alias("node"), F.concat("elements", "inner", F.when(back, F.expr("cast(array() as array<string>)")).otherwise(F.array("end"))).alias("elements"), F.concat("links", F.when(back, F.slice("used", 1, F.size("used") - 1)).otherwise(F.col("used"))).alias("links"))
        move = keep(move, "chains")
        stuck = path.join(move.select("query_id", F.col("before").alias("elements")).distinct(), ["query_id", "elements"], "left_anti").select("query_id", "elements", "links")
        last = keep(stuck.unionByName(move.where("back").select("query_id", "elements", "links")), "ended")
        ended = last if ended is None else ended.unionByName(last)
        path = move.where("not back").select("query_id", "node", "elements", "links")
        if path.isEmpty():
            return ended


def loop_rows(edges: DataFrame, types: DataFrame, properties: DataFrame, chains: DataFrame) -> DataFrame:
    """What the chains of trace_instrumentation() say: query_id, predicate, subject, object, elements, fail_action, via.

    signal_chain: a row per chain; loop_measured_at and loop_acts_on: a row per function (a node whose type is FUNCTION) and what is
    measured or operated, by the first chain that says so. types: node, type. properties: entity_id, property, value.
    """
    chain = F.row_number().over(Window.partitionBy("query_id").orderBy("elements"))
    own = keep(chains.withColumn("chain", chain), "chains")
    each = own.select("query_id", "chain", F.posexplode("elements").alias("pos", "node"))
    used = own.select("query_id", "chain", F.explode("links").alias("id")).join(edges.select("id", "connection_type", F.col("target").alias("node")), "id")
    at = each.join(used.select("query_id", "chain", "node", "connection_type"), ["query_id", "chain", "node"])
    first = lambda kind: F.min(F.when(F.col("connection_type") == kind, F.struct("pos", "node")))["node"]
    ends = at.groupBy("query_id", "chain").agg(first(MEASURES).alias("measured"), first(OPERATES).alias("operated"))
    fails = properties.where(F.col("property") == FAIL_ACTION).groupBy(F.col("entity_id").alias("node")).agg(F.min("value").alias("fail"))
    acts = each.join(fails, "node").groupBy("query_id", "chain").agg(F.min(F.struct("pos", "node", "fail")).alias("f")).select("query_id", "chain", F.col("f.node").alias("via"), F.col("f.fail").alias("fail_action"))
    told = own.join(ends, ["query_id", "chain"], "left").join(acts, ["query_id", "chain"], "left")
    none = F.lit(None).cast("string")
    whole = told.select("query_id", F.lit("signal_chain").alias("predicate"), F.get("elements", F.lit(0)).alias("subject"), F.element_at("elements", -1).alias("object"), "elements", "fail_action", none.alias("via"))
    functions = each.join(types.where(F.col("type") == FUNCTION).select("node"), "node", "left_semi").join(told, ["query_id", "chain"])

    def rows(predicate: str, end: str, fail: F.Column, via: F.Column) -> DataFrame:
        least = F.row_number().over(Window.partitionBy("query_id", "node", end).orderBy("chain"))
        got = functions.where(F.col(end).isNotNull()).withColumn("nth", least).where("nth = 1")
        return got.select("query_id", F.lit(predicate).alias("predicate"), F.col("node").alias("subject"), F.col(end).alias("object"), "elements", fail.alias("fail_action"), via.alias("via"))

    return whole.unionByName(rows("loop_measured_at", "measured", none, none)).unionByName(rows("loop_acts_on", "operated", F.col("fail_action"), F.col("via")))


def line_runs(components: DataFrame, breaks: DataFrame) -> DataFrame:
    """components: line, pos, item, size in drawing order; breaks: item. One row per run between breaks: line, run, first, last, n, sizes (consecutive distinct)."""
    order = Window.partitionBy("line").orderBy("pos")
    marked = components.join(breaks.select("item", F.lit(1).alias("break")).distinct(), "item", "left").fillna({"break": 0})
    run = F.sum("break").over(order)
    change = F.lag("size").over(Window.partitionBy("line", "run").orderBy("pos"))
    marked = marked.withColumn("run", run)
    marked = marked.withColumn("new_size", F.when(change.eqNullSafe(F.col("size")), F.lit(None)).otherwise(F.struct("pos", "size")))
    sizes = F.array_join(F.transform(F.array_sort(F.collect_list("new_size")), lambda x: x["size"]), " then ")
    return marked.groupBy("line", "run").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"), sizes.alias("sizes"))


def trace_line(edges: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All lines of a drawing at once: runs (line, run, source, components, target, sizes, ends_at, links) and line_meetings().

    edges: with line and size. A run goes from break to break: equipment, connectors, nodes with other than two pipes, and nodes of another line.
    Pipes learn their run by pointer jumping, so a line of any length takes a logarithm of it in rounds; a run's pipes are one row in the result.
    """
    pipes = edges.where("relationship = 'piping' and line is not null")
    own = keep(numbered(pipes).select("at", F.col("line").alias("query_id"), "id", F.col("source").alias("first"), F.col("target").alias("second"), F.coalesce("size", F.lit(NO_SIZE)).alias("size"), F.col("ord").alias("run_ord")), "pipes")
    # All that a run needs to know of a node, whatever the line: one row for each node. A node of two lines is foreign to both.
    side = lambda node, enters: F.struct(F.col(node).alias("node"), F.lit(enters).alias("enters"))
    at = edges.where("relationship = 'piping'").select("id", "line", F.explode(F.array(side("source", False), side("target", True))).alias("e")).select("id", "line", "e.*").where("node is not null")
    nodes = at.groupBy("node").agg(F.count(F.lit(1)).alias("degree"), (F.coalesce(F.min("line") != F.max("line"), F.lit(False)) | (F.count_if(F.col("line").isNull()) > 0)).alias("foreign"), F.count_if("enters").alias("n_in"), F.min(F.when(F.col("enters"), F.col("id"))).alias("before"))
    nodes = nodes.join(roles, "node", "left")
    role = F.coalesce("role", F.lit("fitting"))
    is_break = role.isin("equipment", "off_page_connector") | (F.col("degree") != 2) | F.col("foreign")
    ends_at = F.when(role == "off_page_connector", ENDS["off_page_connector"]).when(role == "equipment", ENDS["equipment"]).when(F.col("degree") == 1, ENDS["end"]).otherwise(ENDS["junction"])
    nodes = keep(nodes.select("node", ends_at.alias("ends_at"), F.when(~is_break & (F.col("n_in") == 1), F.col("before")).alias("before")), "nodes")
    through = nodes.where("before is not null").select(F.col("node").alias("first"), "before")
    placed = jumped(own.select("query_id", "id", "first", "at").join(through, "first", "left").select("query_id", "id", "before", "at")).join(own.drop("at"), ["query_id", "id"])
    runs = placed.groupBy(F.col("query_id").alias("line"), F.col("head").alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "id", "first", "second", "size", "run_ord"))).alias("pipes"))
    part = lambda name: F.transform("pipes", lambda p: p[name])
    sizes = part("size")
    changed = F.filter(F.transform(sizes, lambda x, i: F.when((i == 0) | (F.get(sizes, i - 1) != x), x)), lambda x: x.isNotNull())
    runs = runs.select("line", "run", F.get(part("run_ord"), F.lit(0)).alias("run_ord"), F.get(part("first"), F.lit(0)).alias("source"), F.slice(part("second"), 1, F.size("pipes") - 1).alias("components"), F.element_at(part("second"), -1).alias("target"), changed.alias("sizes"), part("id").alias("links"))
    runs = runs.join(nodes.select(F.col("node").alias("target"), "ends_at"), "target", "left").withColumn("ends_at", F.coalesce("ends_at", F.lit(ENDS["open"])))
    return runs, line_meetings(edges)


def line_meetings(edges: DataFrame) -> DataFrame:
    """line, node, other_line, id: a row for each pipe of another line at a line's nodes, with the pipe's other end (far) and size. Nothing is walked for it."""
    end = lambda node, far: F.struct(F.col(node).alias("node"), F.col(far).alias("far"))
    size = F.col("size") if "size" in edges.columns else F.lit(None).cast("string").alias("size")
    at = edges.where("relationship = 'piping'").select("id", "line", size, F.explode(F.array(end("source", "target"), end("target", "source"))).alias("e")).select("id", "line", "size", "e.*").where("node is not null")
    on = at.where("line is not null").select("line", "node").distinct()
    return on.join(at.withColumnRenamed("line", "other_line"), "node").where("other_line <> line").select("line", "node", "other_line", "id", "far", "size")


NO_ROW = {"value": "string", "side": "string", "line": "string", "size": "string", "id": "string", "kind": "string", "relieves_region": "boolean", "nothing_drawn_beyond": "boolean", "elements": "array<string>", "sizes": "array<string>", "ends_at": "string", "links": "array<string>"}


def _derived(rows: DataFrame) -> DataFrame:
    """Rows of an analysis in one form: query_id, predicate, subject, object and NO_ROW, null where a row has none."""
    return rows.select("query_id", "predicate", "subject", "object", *(F.col(c).cast(kind).alias(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in NO_ROW.items()))


def isolation_rows(edges: DataFrame, found: Isolation) -> DataFrame:
    """What isolation_boundary() says as derived rows: its boundary, and for each start fully_valve_bounded and relief_path_inside_boundary with value true or false.

    edges: with line and size, which the rows name for the pipe that they are about.
    """
    start = found.summary.select("query_id", F.col("start").alias("subject"))
    pipe = edges.select("id", "line", "size")
    own = found.rows.join(start, "query_id").join(pipe, "id", "left")
    flags = F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(p).cast("string").alias("value")) for p in ("fully_valve_bounded", "relief_path_inside_boundary")))
    whole = found.summary.select("query_id", F.col("start").alias("subject"), F.lit(None).cast("string").alias("object"), F.explode(flags).alias("f")).select("query_id", "subject", "object", "f.*")
    return _derived(own).unionByName(_derived(whole))


def line_rows(edges: DataFrame, runs: DataFrame, meetings: DataFrame) -> DataFrame:
    """What trace_line() says as derived rows, query_id being the line: line_run (from subject to object through elements) and line_meets_line (at subject, value being the other line; object is the pipe's other end)."""
    went = runs.select(F.col("line").alias("query_id"), F.lit("line_run").alias("predicate"), F.col("source").alias("subject"), F.col("target").alias("object"), "line", F.col("run").alias("id"), F.col("components").alias("elements"), "sizes", "ends_at", "links")
    # Meetings are many where lines share a node: they bring what their rows say, so they are not joined again.
    met = meetings.select(F.col("line").alias("query_id"), F.lit("line_meets_line").alias("predicate"), F.col("node").alias("subject"), F.col("far").alias("object"), "line", "id", "size", F.col("other_line").alias("value"))
    return _derived(went).unionByName(_derived(met))
