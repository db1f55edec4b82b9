"""Operators on graphs of connected equipment: adjacency, reachability, routes, components.

Edges have id, source, target (either may be null: an open end), source_chamber, target_chamber, relationship and ord, the
order in which they were drawn; every tie is broken by ord. Reachability runs many starts at once: a row of the frontier is
(query_id, node, chamber), and one level of all searches is one join with the moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.components import component_of, numbered
from millrace.operators.stretches import jumped
from millrace.plans.storage import keep

DEEPEST = 25
MOST_PATHS = 12
#: A scope of so many edges and pairs at most, and of so many edges times starts, is searched by the task that has its rows; what is larger is searched by all tasks.
WITHIN, WORK = 100_000, 5_000_000
STEP = "struct<id:string,from:string,to:string,with_flow:boolean>"


def clamp_depth(depth: int | None) -> int:
    return DEEPEST if depth is None else min(max(depth, 1), DEEPEST)


def route_semantics(direction: str) -> str:
    return "drawn_flow" if direction in ("downstream", "upstream") else "topological"


def flow_edges(edges: DataFrame) -> DataFrame:
    return edges.where("relationship = 'piping' and source is not null and target is not null")


def moves(edges: DataFrame, direction: str) -> DataFrame:
    """from, to, exit and entry (chambers), with_flow, id, turn (the order in which a node tries its moves)."""
    flow = flow_edges(edges)
    out = flow.select(F.col("source").alias("from"), F.col("target").alias("to"), F.col("source_chamber").alias("exit"), F.col("target_chamber").alias("entry"), F.lit(True).alias("with_flow"), "id", F.col("ord").cast("long").alias("turn"))
    back = flow.select(F.col("target").alias("from"), F.col("source").alias("to"), F.col("target_chamber").alias("exit"), F.col("source_chamber").alias("entry"), F.lit(False).alias("with_flow"), "id", (F.col("ord") + F.lit(1 << 40)).cast("long").alias("turn"))
    if direction == "downstream":
        return out
    return back if direction == "upstream" else out.unionByName(back)


@dataclass
class Traversal:
    """reached: query_id, node, distance, path (steps), through (nodes between). boundaries: chamber changes that stopped a move.
    blocked: nodes met that are closed. stopped: nodes at which the search was told to stop. frontier: nodes cut by depth.
    flags: one row per query. states: every (query_id, node, chamber) entered."""

    reached: DataFrame
    boundaries: DataFrame
    blocked: DataFrame
    stopped: DataFrame
    frontier: DataFrame
    flags: DataFrame
    states: DataFrame


def traverse(edges: DataFrame, starts: DataFrame, direction: str = "downstream", max_depth: int | None = None, stop: DataFrame | None = None, blocked: DataFrame | None = None, paths: bool = True) -> Traversal:
    """Breadth-first search from each of starts (query_id, node). stop and blocked: one column, node.

    A state is a node with the chamber it was entered by: a move may not leave by another chamber. Stops and chambers don't
    hold for the start. One job per level; the frontier is written at each, so the plan doesn't grow with depth.

    A plain move is the only way to its end, from a node that itself is entered in one way at most; no start lies at its end. A search makes it once, so what it
    leads to was not seen before, and is not looked up later. Without paths, reached has neither path nor through, and no row carries them.
    """
    depth, step = clamp_depth(max_depth), moves(edges, direction)
    ways = step.groupBy(F.col("to").alias("n")).agg(F.count(F.lit(1)).alias("ways")).unionByName(starts.select(F.col("node").alias("n"), F.lit(1).cast("long").alias("ways")))
    ways = ways.groupBy("n").agg(F.sum("ways").alias("ways")).where("ways > 1")
    twice = keep(ways, "twice")
    unplain = not twice.isEmpty()
    if unplain:
        for end in ("to", "from"):
            step = step.join(twice.select(F.col("n").alias(end), F.lit(True).alias(f"odd_{end}")), end, "left")
        step = keep(step.withColumn("plain", F.col("odd_to").isNull() & F.col("odd_from").isNull()).drop("odd_to", "odd_from"), "moves")
    else:
        step = step.withColumn("plain", F.lit(True))
    start = starts.select("query_id", F.col("node").alias("start"))
    frontier = start.select("query_id", "start", F.col("start").alias("node"), F.lit(None).cast("string").alias("chamber"), F.expr("cast(array() as array<bigint>)").alias("turns"), F.lit(False).alias("plain"), *([F.expr(f"cast(array() as array<{STEP}>)").alias("path")] if paths else []))
    halts = stop.select(F.col("node").alias("halt")).distinct() if stop is not None else None
    closed = blocked.select(F.col("node").alias("closed")).distinct() if blocked is not None else None
    states, tried, stopped = frontier, None, None
    for level in range(depth + 1):
        active = frontier
        if halts is not None and level:
            held = frontier.join(halts, frontier["node"] == halts["halt"], "left")
            here = held.where("halt is not null").select("query_id", "node").distinct()
            stopped = here if stopped is None else stopped.unionByName(here)
            active = held.where("halt is null").drop("halt")
        found = active.drop("plain").join(step, active["node"] == step["from"])
        skip = F.lit(level > 0) & F.col("chamber").isNotNull() & F.col("exit").isNotNull() & (F.col("chamber") != F.col("exit"))
        found = found.withColumn("skip", F.coalesce(skip, F.lit(False)))
        found = found.join(closed, found["to"] == closed["closed"], "left") if closed is not None else found.withColumn("closed", F.lit(None).cast("string"))
        found = found.withColumn("next_turns", F.concat("turns", F.array("turn"))).withColumn("level", F.lit(level))
        if unplain:
            seen = states.where("not plain").select(F.col("query_id").alias("q"), F.col("node").alias("n"), F.coalesce("chamber", F.lit("")).alias("c")).distinct()
            found = found.join(seen, (found["query_id"] == seen["q"]) & (found["to"] == seen["n"]) & (F.coalesce(found["entry"], F.lit("")) == seen["c"]), "left").withColumn("seen", F.col("q").isNotNull()).drop("q", "n", "c")
            order = Window.partitionBy("query_id", "to", "entry", "skip", F.col("closed").isNotNull(), "seen").orderBy("next_turns")
            found = found.withColumn("nth", F.row_number().over(order))
        else:
            found = found.withColumns({"seen": F.lit(False), "nth": F.lit(1)})
        found = keep(found, "level")
        tried = found if tried is None else tried.unionByName(found)
        if level == depth:
            break
        frontier = found.where("not skip and closed is null and not seen and nth = 1").select("query_id", "start", F.col("to").alias("node"), F.col("entry").alias("chamber"), F.col("next_turns").alias("turns"), "plain", *([F.concat("path", F.array(F.struct("id", F.col("node").alias("from"), "to", "with_flow"))).alias("path")] if paths else []))
        if frontier.isEmpty():
            break
        states = states.unionByName(frontier)
    free = tried.where("not skip and closed is null")
    cut = free.where(F.col("seen") == F.lit(False)).where(F.col("level") == depth)
    again = free.where(F.col("seen") | ((F.col("nth") > 1) & (F.col("level") < depth)) | ((F.col("to") == F.col("start")) & (F.col("level") < depth)))
    cyclic = again.groupBy("query_id").agg(F.lit(direction != "both").alias("cycle"), (F.bool_or(F.col("to") == F.col("start")) & F.lit(direction != "both")).alias("home"))
    deep = cut.groupBy("query_id").agg(F.lit(True).alias("truncated"))
    false = F.lit(False)
    flags = start.join(cyclic, "query_id", "left").join(deep, "query_id", "left").select("query_id", "start", F.coalesce("cycle", false).alias("cycle_detected"), F.coalesce("home", false).alias("returns_to_start"), F.coalesce("truncated", false).alias("truncated"))
    first = Window.partitionBy("query_id", "node").orderBy(F.size("turns"), "turns")
    reached = states.where("node <> start")
    reached = reached.withColumn("nth", F.row_number().over(first)).where("nth = 1") if unplain else reached
    route = ["path", F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda s: s["to"]).alias("through")] if paths else []
    reached = reached.select("query_id", "node", F.size("turns").alias("distance"), *route)
    none = F.expr("1 = 0")
    return Traversal(
        reached,
        tried.where("skip").select("query_id", "node", F.col("chamber").alias("entered"), F.col("exit").alias("blocked"), "id").distinct(),
        tried.where("not skip and closed is not null").select("query_id", F.col("closed").alias("node")).distinct(),
        stopped.distinct() if stopped is not None else starts.select("query_id", "node").where(none),
        cut.select("query_id", "node").distinct(),
        flags,
        states.select("query_id", "node", "chamber"),
    )


def endpoints(edges: DataFrame, reached: DataFrame, direction: str) -> DataFrame:
    """Reached nodes without any move in the direction, whatever chambers, closed items and open ends say."""
    return reached.join(moves(edges, direction).select(F.col("from").alias("node")).distinct(), "node", "left_anti")


def open_ends(edges: DataFrame, states: DataFrame, starts: DataFrame, direction: str) -> DataFrame:
    """Open-ended pipes that leave a visited state by a chamber it was entered by, in the direction; the start is exempt from the chamber rule."""
    pipes = edges.where("relationship = 'piping' and (source is null) <> (target is null)")
    known = pipes.select("id", F.coalesce("source", "target").alias("node"), F.coalesce("source_chamber", "target_chamber").alias("by"), F.col("target").isNull().alias("leaves"))
    if direction != "both":
        known = known.where(F.col("leaves") == F.lit(direction == "downstream"))
    begun = starts.select("query_id", F.col("node").alias("start"))
    met = states.join(known, "node").join(begun, "query_id")
    fits = (F.col("node") == F.col("start")) | F.col("chamber").isNull() | F.col("by").isNull() | (F.col("chamber") == F.col("by"))
    return met.where(fits).select("query_id", "node", "id").distinct()


def terminal(edges: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """nodes: node. Adds terminal: no pipe with both ends leads on in the direction, whatever chambers and closed items say."""
    onward = moves(edges, direction).select(F.col("from").alias("node"), F.lit(False).alias("ends")).distinct()
    return nodes.join(onward, "node", "left").withColumn("terminal", F.coalesce("ends", F.lit(True))).drop("ends")


def pairs_on_routes(routes: DataFrame) -> DataFrame:
    """routes: nodes (array, in order). Every ordered pair (a, b) with a before b on one of them."""
    each = routes.select(F.monotonically_increasing_id().alias("route"), "nodes").select("nodes", F.posexplode("nodes").alias("pos", "a"))
    after = F.slice("nodes", F.col("pos") + 2, F.greatest(F.size("nodes") - F.col("pos") - 1, F.lit(0)))
    return each.select("a", F.explode(after).alias("b")).where("a <> b").distinct()


def related_pairs(edges: DataFrame) -> DataFrame:
    """Unordered pairs (a < b) that one connection joins, of whatever kind."""
    whole = edges.where("source is not null and target is not null and source <> target")
    return whole.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def connected_sets(pairs: DataFrame, sets: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """pairs: a, b. sets: set_id, node. set_id, connected: whether its nodes are joined by pairs among themselves and the hubs (node) next to them."""
    links = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    nodes = sets.select("set_id", "node").distinct()
    if hubs is not None:
        near = sets.join(links, sets["node"] == links["a"]).select("set_id", F.col("b").alias("node")).distinct()
        nodes = nodes.unionByName(near.join(hubs.select("node").distinct(), "node", "left_semi").select("set_id", "node")).distinct()
    own = links.where("a < b").join(nodes.withColumnRenamed("node", "a"), "a").join(nodes.withColumnRenamed("node", "b"), ["set_id", "b"])
    name = lambda c: F.struct("set_id", F.col(c).alias("node"))
    found = components(nodes.select(name("node").alias("node")), own.select(name("a").alias("source"), name("b").alias("target")))
    wanted = sets.select(F.struct("set_id", "node").alias("node")).distinct()
    return found.join(wanted, "node").groupBy(F.col("node.set_id").alias("set_id")).agg((F.count_distinct("component") == 1).alias("connected"))


def in_order(wanted: F.Column, route: F.Column) -> F.Column:
    """Whether the nodes of wanted occur on the route in their order, others between them or not."""
    met = F.aggregate(route, F.lit(0), lambda n, x: F.when(F.get(wanted, n) == x, n + 1).otherwise(n))
    return met == F.size(wanted)


def shortest_path(edges: DataFrame, pairs: DataFrame, direction: str = "downstream", blocked: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """pairs: query_id, source, target. One row per pair that a route joins: query_id, target, distance, path."""
    found = traverse(edges, pairs.select("query_id", F.col("source").alias("node")), direction, max_depth, blocked=blocked).reached
    return found.join(pairs.select("query_id", F.col("target").alias("node")), ["query_id", "node"]).select("query_id", F.col("node").alias("target"), "distance", "path")


def simple_paths(edges: DataFrame, pairs: DataFrame, direction: str = "downstream", blocked: DataFrame | None = None, max_length: int | None = None, most: int = MOST_PATHS) -> DataFrame:
    """Routes that visit no node twice: the first `most` in drawing order, then by length: query_id, nth, length, path, more (whether there are others).

    Partial routes are kept only at nodes from which the target can still be reached. Of these, at most `most` + 1 of a query, the first in drawing
    order, are deepened at a time; the others wait. Where all that are deepened come to an end and there are too few routes, the next ones that wait
    are taken, from the deepest level first. So no level holds more than a few rows of a query, however many routes there are.
    """
    longest, step = clamp_depth(max_length), moves(edges, direction)
    if blocked is not None:
        step = step.join(blocked.select(F.col("node").alias("to")).distinct(), "to", "left_anti")
    opposite = {"downstream": "upstream", "upstream": "downstream"}.get(direction, direction)
    back = traverse(edges.withColumns({"source_chamber": F.lit(None).cast("string"), "target_chamber": F.lit(None).cast("string")}), pairs.select("query_id", F.col("target").alias("node")), opposite, longest)
    near = back.reached.select("query_id", F.col("node").alias("to"), F.col("distance").alias("rest")).unionByName(pairs.select("query_id", F.col("target").alias("to"), F.lit(0).alias("rest")))
    near = keep(near, "near")
    active = pairs.select("query_id", "target", F.col("source").alias("node"), F.lit(None).cast("string").alias("chamber"), F.expr("cast(array() as array<bigint>)").alias("turns"), F.expr(f"cast(array() as array<{STEP}>)").alias("path"), F.array("source").alias("visited"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("turns"))
    found = waiting = None
    while True:
        new = active.join(step, active["node"] == step["from"]).where((F.size("turns") == 0) | F.col("chamber").isNull() | F.col("exit").isNull() | (F.col("chamber") == F.col("exit"))).where(~F.array_contains("visited", F.col("to")))
        new = new.join(near, ["query_id", "to"]).where(F.col("rest") <= longest - F.size("turns") - 1)
        new = new.select("query_id", "target", F.col("to").alias("node"), F.col("entry").alias("chamber"), F.concat("turns", F.array("turn")).alias("turns"), F.concat("path", F.array(F.struct("id", F.col("from"), "to", "with_flow"))).alias("path"), F.concat("visited", F.array("to")).alias("visited"))
        new = keep(new, "routes")
        done = new.where("node = target").select("query_id", "turns", "path")
        every = done if found is None else found.unionByName(done)
        found = keep(every.withColumn("place", place).where(F.col("place") <= most + 1), "found")
        last = found.where(F.col("place") == most + 1).select("query_id", F.col("turns").alias("last"))
        found = found.drop("place")

        def before(rows: DataFrame, last: DataFrame = last) -> DataFrame:
            """What can still be among the first routes of its query."""
            return rows.join(last, "query_id", "left").where("last is null or turns < last").drop("last")

        ranked = keep(before(new.where("node <> target")).withColumn("place", place), "ranked")
        active, late = ranked.where(F.col("place") <= most + 1).drop("place"), ranked.where(F.col("place") > most + 1).drop("place")
        waiting = keep(late if waiting is None else late.unionByName(before(waiting)), "waiting")
        idle = waiting.join(active.select("query_id").distinct(), "query_id", "left_anti")
        deepest = F.max(F.size("turns")).over(Window.partitionBy("query_id"))
        taken = keep(idle.withColumn("deepest", deepest).where(F.size("turns") == F.col("deepest")).withColumn("place", place).where(F.col("place") <= most + 1).drop("deepest", "place"), "taken")
        waiting = waiting.join(taken.select("query_id", "turns"), ["query_id", "turns"], "left_anti")
        active = active.unionByName(taken)
        if active.isEmpty():
            break
    drawn = Window.partitionBy("query_id").orderBy("turns")
    found = found.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= most + 1)
    more = (F.max("place").over(Window.partitionBy("query_id")) > most).alias("more")
    found = found.select("*", more).where(F.col("place") <= most)
    order = Window.partitionBy("query_id").orderBy(F.size("path"), "place")
    return found.select("query_id", F.row_number().over(order).alias("nth"), F.size("path").alias("length"), "path", "more")


def annotate_routes(paths: DataFrame, roles: DataFrame) -> DataFrame:
    """What lies on each route by role, and what it passes against the drawn flow. roles: node, role."""
    each = paths.select("query_id", "nth", F.posexplode("path").alias("pos", "step"))
    inside = each.select("query_id", "nth", "pos", F.col("step.to").alias("node"))
    last = Window.partitionBy("query_id", "nth")
    inside = inside.withColumn("last", F.max("pos").over(last)).where("pos < last").join(roles, "node")
    listed = lambda role, name: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("pos", "node")))), lambda x: x["node"]).alias(name)
    kinds = inside.groupBy("query_id", "nth").agg(listed("isolation_valve", "shut_off_valves"), listed("check_valve", "check_valves"), listed("relief_device", "relief_devices"), listed("equipment", "equipment"))
    against = each.where("not step.with_flow")
    passed = against.select("query_id", "nth", "pos", F.posexplode(F.array("step.from", "step.to")).alias("side", "node")).join(roles.where("role in ('check_valve', 'relief_device')"), "node")
    one_way = passed.groupBy("query_id", "nth").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "side", "node"))), lambda x: x["node"])).alias("one_way_devices_against_flow"))
    n = against.groupBy("query_id", "nth").agg(F.count(F.lit(1)).alias("pipes_against_flow"))
    return paths.join(kinds, ["query_id", "nth"], "left").join(n, ["query_id", "nth"], "left").join(one_way, ["query_id", "nth"], "left").fillna({"pipes_against_flow": 0})


def adjacency(edges: DataFrame, entities: DataFrame, direction: str = "both", relationship: str | None = None) -> DataFrame:
    """One row per entity and connection: entity_id, side, id, other. Direction selects piping only; instrumentation has both sides always."""
    own = edges if relationship in (None, "all") else edges.where(F.col("relationship") == relationship)
    piping = F.col("relationship") == "piping"
    out = own.where("source is not null").select(F.col("source").alias("entity_id"), F.when(piping, "downstream").otherwise("outgoing").alias("side"), "id", F.col("target").alias("other"), "relationship", "ord")
    back = own.where("target is not null").select(F.col("target").alias("entity_id"), F.when(piping, "upstream").otherwise("incoming").alias("side"), "id", F.col("source").alias("other"), "relationship", "ord")
    both = out.unionByName(back)
    if direction != "both":
        both = both.where((F.col("relationship") != "piping") | (F.col("side") == direction))
    return both.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi")


def link_counts(edges: DataFrame) -> DataFrame:
    """Per entity: piping_upstream, piping_downstream, piping_open_ended, instrumentation."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.lit("out").alias("way"), F.col("target").isNull().alias("open")), F.struct(F.col("target").alias("node"), F.lit("in").alias("way"), F.col("source").isNull().alias("open")))
    each = edges.select("relationship", F.explode(ends).alias("e")).select("relationship", "e.*").where("node is not null")
    piping = F.col("relationship") == "piping"
    return each.groupBy(F.col("node").alias("entity_id")).agg(F.count_if(piping & ~F.col("open") & (F.col("way") == "in")).alias("piping_upstream"), F.count_if(piping & ~F.col("open") & (F.col("way") == "out")).alias("piping_downstream"), F.count_if(piping & F.col("open")).alias("piping_open_ended"), F.count_if(~piping).alias("instrumentation"))


def degree(edges: DataFrame) -> DataFrame:
    """node, degree: piping edges at the node, open ends too."""
    piping = edges.where("relationship = 'piping'")
    return piping.select(F.explode(F.array("source", "target")).alias("node")).where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it is connected with); edges with an open end join nothing."""
    return component_of(nodes, edges)


def descendants(children: DataFrame, roots: DataFrame) -> DataFrame:
    """children: parent, child. root, node, depth of everything below each root (node), however deep; a node that is its own ancestor is not followed again."""
    level = roots.select(F.col("node").alias("root"), F.col("node").alias("node"), F.lit(0).alias("depth"), F.array("node").alias("above"))
    out = None
    while True:
        below = level.join(children, level["node"] == children["parent"]).where(~F.array_contains("above", F.col("child")))
        level = keep(below.select("root", F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("above", F.array("child")).alias("above")), "below")
        if out is None or not level.isEmpty():
            out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            return out.drop("above")


def reaching(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """edges: scope, from, to, exit, entry (chambers), at (their order, so that neighbours can be found together; optional). pairs: scope, a, b. Those of pairs whose b lies downstream of a, under the chamber rule, in the same scope.

    Nothing is searched but what is asked for, and no closure is stored. Small scopes, of which many lie in one task, are searched there (WITHIN); of the others no task holds more than a part.
    """
    asked = keep(pairs.select("scope", "a", "b").where("a <> b").distinct(), "asked")
    edges = edges if "at" in edges.columns else numbered(edges)
    size = edges.groupBy("scope").agg(F.count(F.lit(1)).alias("edges"))
    size = size.join(asked.groupBy("scope").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("starts")), "scope")
    large = keep(size.where((F.col("edges") + F.col("pairs") > WITHIN) | (F.col("edges") * F.col("starts") > WORK)).select("scope"), "large")
    if large.isEmpty():
        return _reaching_within(edges, asked)
    far = _reaching_across(edges.join(large, "scope", "left_semi"), keep(asked.join(large, "scope", "left_semi"), "asked"))
    return _reaching_within(edges.join(large, "scope", "left_anti"), asked.join(large, "scope", "left_anti")).unionByName(far)


def _reaching_within(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """As reaching(), for scopes that a task can hold: a scope's edges come first, then its pairs by their first ends, and each of these is searched from once."""
    null = F.lit(None).cast("string")
    rows = edges.select("scope", F.lit(False).alias("asked"), F.col("from").alias("a"), F.col("to").alias("b"), "exit", "entry")
    rows = rows.unionByName(asked.select("scope", F.lit(True).alias("asked"), "a", "b", null.alias("exit"), null.alias("entry"))).where("scope is not null and a is not null and b is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope = start = on = None
        reached: set = set()
        for batch in batches:
            out = []
            for s, is_pair, a, b, leaves, enters in zip(*(batch[c].to_pylist() for c in ("scope", "asked", "a", "b", "exit", "entry")), strict=True):
                if s != scope:
                    scope, start, on = s, None, {}
                if not is_pair:
                    on.setdefault(a, []).append((leaves, b, enters))
                    continue
                if a != start:
                    start, reached, seen, todo = a, set(), {(a, None)}, [(a, None)]
                    while todo:
                        node, chamber = todo.pop()
                        for exit_, to, entry in on.get(node, ()):
                            if (chamber is None or exit_ is None or chamber == exit_) and (to, entry) not in seen:
                                seen.add((to, entry))
                                todo.append((to, entry))
                                reached.add(to)
                if b in reached:
                    out.append((s, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in out], pa.string()) for k in range(3)], names=["scope", "a", "b"])

    return rows.repartition("scope").sortWithinPartitions("scope", "asked", "a").mapInArrow(run, "scope string, a string, b string")


def _reaching_across(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """As reaching(), for scopes of any size; edges with at, asked as it keeps them.

    A state is a node with the chamber it was entered by; states with one way in and one way on, which are no pair's end, are jumped over: each learns the end of its stretch,
    within a task's own rows first and then by pointer jumping, a logarithm of what it crosses in rounds. What is left, junctions and ends, is searched level by level from the
    pairs' first ends: a row for each of these and each junction it reaches.
    """
    step = edges.groupBy("scope", "from", "to", "exit", "entry").agg(F.min("at").alias("at"))
    starts = asked.select("scope", F.col("a").alias("from")).distinct()
    entered = step.select("scope", F.col("to").alias("from"), F.col("entry").alias("chamber")).unionByName(starts.withColumn("chamber", F.lit(None).cast("string"))).distinct()
    free = F.col("chamber").isNull() | F.col("exit").isNull() | (F.col("chamber") == F.col("exit"))
    state = lambda node, chamber: F.struct(F.col(node).alias("node"), F.col(chamber).alias("chamber"))
    links = keep(entered.join(step, ["scope", "from"]).where(free).select("scope", state("from", "chamber").alias("u"), state("to", "entry").alias("v"), "at").where("u <> v").groupBy("scope", "u", "v").agg(F.min("at").alias("at")), "links")
    ends = asked.select("scope", F.explode(F.array("a", "b")).alias("node")).distinct()
    into = links.groupBy("scope", F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("n_in"))
    on = links.groupBy("scope", F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("n_out"), F.min("v").alias("next"), F.min("at").alias("at"))
    inner = into.join(on, ["scope", "x"]).where("n_in = 1 and n_out = 1").withColumn("node", F.col("x.node")).join(ends, ["scope", "node"], "left_anti")
    inner = keep(inner.select("scope", "x", "next", "at"), "inner")
    # A state as a text: the end of a stretch is the first state ahead that is none of them. Closed rings, which nothing enters, have none.
    said = lambda c: F.concat_ws("\x03", F.col(f"{c}.node"), F.col(f"{c}.chamber"))
    over = jumped(inner.select(F.col("scope").alias("query_id"), said("x").alias("id"), said("next").alias("before"), "at"))
    told = lambda c: F.struct(F.substring_index(c, "\x03", 1).alias("node"), F.when(F.contains(c, F.lit("\x03")), F.substring_index(c, "\x03", -1)).alias("chamber"))
    over = over.select(F.col("query_id").alias("scope"), told(F.col("id")).alias("v"), told(F.col("head")).alias("far"))
    links = links.join(inner.select("scope", F.col("x").alias("u")), ["scope", "u"], "left_anti").join(over, ["scope", "v"], "left").select("scope", "u", F.coalesce("far", "v").alias("v")).where("u <> v").distinct()
    links = keep(links, "junctions")
    none = F.lit(None).cast("string")
    frontier = asked.select("scope", "a", F.struct(F.col("a").alias("node"), none.alias("chamber")).alias("s")).distinct()
    seen, level = frontier, 0
    while True:
        near = frontier.join(links, (frontier["scope"] == links["scope"]) & F.col("s").eqNullSafe(F.col("u"))).select(frontier["scope"], "a", F.col("v").alias("s")).distinct()
        known = seen.select(F.col("scope").alias("k"), F.col("a").alias("f"), F.col("s").alias("t"))
        frontier = keep(near.join(known, (F.col("scope") == F.col("k")) & (F.col("a") == F.col("f")) & F.col("s").eqNullSafe(F.col("t")), "left_anti"), "reach")
        if frontier.isEmpty():
            break
        seen, level = seen.unionByName(frontier), level + 1
        if level % 16 == 0:
            seen = keep(seen, "seen")
    return asked.join(seen.select("scope", "a", F.col("s.node").alias("b")).distinct(), ["scope", "a", "b"], "left_semi")


def transitive_pairs(edges: DataFrame) -> DataFrame:
    """All ordered pairs (a, b) with b downstream of a, under the chamber rule, however far apart."""
    step = moves(edges, "downstream").select("from", "to", "exit", "entry").distinct()
    states = frontier = step.select(F.col("from").alias("a"), F.col("from").alias("node"), F.lit(None).cast("string").alias("chamber")).distinct()
    level = 0
    while True:
        free = F.col("chamber").isNull() | F.col("exit").isNull() | (F.col("chamber") == F.col("exit"))
        near = frontier.join(step, frontier["node"] == step["from"]).where(free).select("a", F.col("to").alias("node"), F.col("entry").alias("chamber")).distinct()
        seen = states.select(F.col("a").alias("q"), F.col("node").alias("n"), F.col("chamber").alias("c"))
        frontier = keep(near.join(seen, (F.col("a") == F.col("q")) & (F.col("node") == F.col("n")) & F.col("chamber").eqNullSafe(F.col("c")), "left_anti"), "pairs")
        if frontier.isEmpty():
            return states.where("a <> node").select("a", F.col("node").alias("b")).distinct()
        states, level = states.unionByName(frontier), level + 1
        if level % 16 == 0:
            # One table again, so that the plan stays short.
            states = keep(states, "states")
