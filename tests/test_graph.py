"""Breadth-first search, routes, isolation and instrument loops on small hand-made graphs."""

import pytest

from millrace.operators import analysis, graph

EDGE = "id string, source string, target string, source_chamber string, target_chamber string, relationship string, ord long"


def edges(spark, *rows):
    """Each row: 'a>b' with optional chambers 'a/C1>b/C2'; '>b' and 'a>' are open ends."""
    out = []
    for k, r in enumerate(rows):
        (a, x), (b, y) = ((e.split("/") + [None])[:2] for e in r.split(">"))
        out.append((f"p{k}", a or None, b or None, x, y, "piping", k))
    return spark.createDataFrame(out, EDGE)


def starts(spark, *nodes):
    return spark.createDataFrame([(n, n) for n in nodes], "query_id string, node string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def reach(t):
    return {(r.query_id, r.node): r.distance for r in t.reached.collect()}


def flags(t):
    return {r.query_id: (r.cycle_detected, r.returns_to_start, r.truncated) for r in t.flags.collect()}


def test_directions(spark):
    e = edges(spark, "a>b", "b>c", "d>b")
    assert reach(graph.traverse(e, starts(spark, "a", "c"), "downstream")) == {("a", "b"): 1, ("a", "c"): 2}
    assert reach(graph.traverse(e, starts(spark, "c"), "upstream")) == {("c", "b"): 1, ("c", "a"): 2, ("c", "d"): 2}
    assert reach(graph.traverse(e, starts(spark, "a"), "both")) == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 2}


def test_cycle_returns_to_start(spark):
    t = graph.traverse(edges(spark, "a>b", "b>c", "c>a"), starts(spark, "a"))
    assert flags(t) == {"a": (True, True, False)} and ("a", "a") not in reach(t)
    assert flags(graph.traverse(edges(spark, "a>b", "b>c", "c>a"), starts(spark, "a"), "both"))["a"][0] is False


def test_diamond_is_a_met_state_and_keeps_the_first_route(spark):
    t = graph.traverse(edges(spark, "a>b", "a>c", "b>d", "c>d"), starts(spark, "a"))
    route = {r.node: [s["id"] for s in r.path] for r in t.reached.collect()}
    assert route["d"] == ["p0", "p2"] and flags(t)["a"] == (True, False, False)


def test_depth_cut(spark):
    t = graph.traverse(edges(spark, "a>b", "b>c", "c>d"), starts(spark, "a"), max_depth=2)
    assert reach(t) == {("a", "b"): 1, ("a", "c"): 2} and flags(t)["a"] == (False, False, True)
    assert [r.node for r in t.frontier.collect()] == ["c"]


@pytest.mark.parametrize("asked, used", [(None, 25), (0, 1), (7, 7), (99, 25)])
def test_depth_is_clamped(asked, used):
    assert graph.clamp_depth(asked) == used


def test_stop_does_not_hold_for_the_start(spark):
    t = graph.traverse(edges(spark, "a>b", "b>c"), starts(spark, "a"), stop=nodes(spark, "a", "b"))
    assert reach(t) == {("a", "b"): 1} and [r.node for r in t.stopped.collect()] == ["b"]


def test_blocked_is_never_entered(spark):
    t = graph.traverse(edges(spark, "a>b", "a>c", "b>d"), starts(spark, "a"), blocked=nodes(spark, "b"))
    assert reach(t) == {("a", "c"): 1} and [r.node for r in t.blocked.collect()] == ["b"]


def test_chambers(spark):
    e = edges(spark, "a>x/C1", "x/C1>b", "x/C2>c", "x>d", "e>x")
    t = graph.traverse(e, starts(spark, "a", "x", "e"))
    assert {n for q, n in reach(t) if q == "a"} == {"x", "b", "d"}
    assert [(r.node, r.entered, r.blocked, r.id) for r in t.boundaries.collect()] == [("x", "C1", "C2", "p2")]
    assert {n for q, n in reach(t) if q == "x"} == {"b", "c", "d"} and {n for q, n in reach(t) if q == "e"} == {"x", "b", "c", "d"}


def test_a_node_is_expanded_once_per_chamber(spark):
    e = edges(spark, "a>x/C1", "x/C1>b", "b>x/C2", "x/C2>c")
    assert reach(graph.traverse(e, starts(spark, "a"))) == {("a", "x"): 1, ("a", "b"): 2, ("a", "c"): 4}


def test_return_into_another_chamber_of_the_start(spark):
    t = graph.traverse(edges(spark, "x/C1>b", "b>x/C2", "x/C2>c"), starts(spark, "x"))
    assert flags(t)["x"][:2] == (True, True) and reach(t) == {("x", "b"): 1, ("x", "c"): 1}


def test_open_ends_and_instruments_carry_no_flow(spark):
    e = edges(spark, "a>b", "b>", ">a")
    t = graph.traverse(e, starts(spark, "a"))
    assert reach(t) == {("a", "b"): 1}
    assert [(r.node, r.id) for r in graph.open_ends(e, t.states, starts(spark, "a"), "downstream").collect()] == [("b", "p1")]
    assert [r.node for r in graph.endpoints(e, t.reached, "downstream").collect()] == ["b"]


def test_mirror(spark):
    e = edges(spark, "a>b", "b>c", "c>d", "b>d", "d>a")
    names = ["a", "b", "c", "d"]
    down = set(reach(graph.traverse(e, starts(spark, *names), "downstream")))
    assert {(b, a) for a, b in down} == set(reach(graph.traverse(e, starts(spark, *names), "upstream")))


def test_simple_paths_in_drawing_order(spark):
    pairs = spark.createDataFrame([("q", "a", "d")], "query_id string, source string, target string")
    e = edges(spark, "a>b", "b>c", "c>d", "b>d", "a>d", "c>a")
    got = [[s["to"] for s in r.path] for r in sorted(graph.simple_paths(e, pairs).collect(), key=lambda r: r.nth)]
    assert got == [["d"], ["b", "d"], ["b", "c", "d"]]
    few = graph.simple_paths(e, pairs, most=2).collect()
    assert len(few) == 2 and all(r.more for r in few)


def test_link_counts_and_degree(spark):
    e = edges(spark, "a>b", "b>", "c>b").unionByName(spark.createDataFrame([("i", "a", "b", None, None, "instrumentation", 9)], EDGE))
    got = {r.entity_id: (r.piping_upstream, r.piping_downstream, r.piping_open_ended, r.instrumentation) for r in graph.link_counts(e).collect()}
    assert got["b"] == (2, 0, 1, 1) and got["a"] == (0, 1, 0, 1)
    assert {r.node: r.degree for r in graph.degree(e).collect()} == {"a": 1, "b": 3, "c": 1}


def test_components_and_descendants(spark):
    e = edges(spark, "a>b", "c>d", "d>e")
    got = {r.node: r.component for r in graph.components(nodes(spark, *"abcdef"), e).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c", "f": "f"}
    tree = spark.createDataFrame([("r", "x"), ("x", "y"), ("r", "z")], "parent string, child string")
    assert {(r.node, r.depth) for r in graph.descendants(tree, nodes(spark, "r")).collect()} == {("x", 1), ("y", 2), ("z", 1)}


def test_descendants_at_any_depth(spark):
    tree = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(11)] + [("n11", "n3")], "parent string, child string")
    assert {(r.node, r.depth) for r in graph.descendants(tree, nodes(spark, "n0")).collect()} == {(f"n{k}", k) for k in range(1, 12)}
    assert graph.descendants(tree, nodes(spark, "none")).collect() == []


def test_transitive_pairs_at_any_distance(spark):
    got = [(r.a, r.b) for r in graph.transitive_pairs(edges(spark, *(f"{k}>{k + 1}" for k in range(28)))).collect()]
    assert sorted(got) == sorted((str(a), str(b)) for b in range(29) for a in range(b))
    got = graph.transitive_pairs(edges(spark, "a>b/C1", "b/C2>c", "b/C1>d", "d>a", "x>b/C2")).collect()
    assert sorted(map(tuple, got)) == sorted([("a", "b"), ("a", "d"), ("b", "c"), ("b", "d"), ("b", "a"), ("d", "a"), ("d", "b"), ("x", "b"), ("x", "c")])


def test_long_signal_chain(spark):
    names = [f"I{k}" for k in range(29)]
    rows = [*zip(names, names[1:]), ("I3", "side")]
    e = spark.createDataFrame([(f"s{k}", a, b, None, None, "instrumentation", k, "signal_line") for k, (a, b) in enumerate(rows)], EDGE + ", connection_type string")
    kinds = spark.createDataFrame([(n, "instrumentation") for n in [*names, "side"]], "node string, category string")
    _, chains = analysis.trace_instrumentation(e, kinds, starts(spark, "I0"))
    assert sorted(r.elements for r in chains.collect()) == sorted([names, [*names[:4], "side"]])


def test_isolation(spark):
    e = edges(spark, "v1>t", "t>x", "x>v2", "x>s", "x>k", "k>far", "t>")
    roles = spark.createDataFrame([("v1", "isolation_valve"), ("v2", "isolation_valve"), ("s", "relief_device"), ("k", "check_valve"), ("x", "fitting"), ("t", "equipment"), ("far", "equipment")], "node string, role string")
    out = analysis.isolation_boundary(e, roles, starts(spark, "t"))
    assert {r.node for r in out.region.collect()} == {"t", "x"}
    rows = {(r.predicate, r.object, r.side) for r in out.rows.collect()}
    assert rows == {("isolation_boundary_valve", "v1", "upstream"), ("isolation_boundary_valve", "v2", "downstream"), ("relief_device_on_boundary", "s", "downstream"), ("check_valve_on_boundary", "k", "downstream"), ("unisolated_connection", None, "downstream")}
    s = out.summary.first()
    assert (s.valves, s.checks, s.unisolated, s.relieving, s.fully_valve_bounded, s.relief_path_inside_boundary) == (2, 1, 1, 1, False, True)


@pytest.mark.parametrize("fold", [1, 3])
def test_isolation_in_folds(spark, monkeypatch, fold):
    """The region against a plain walk, on a long chain with loops, branches and valves, whatever the number of hops until tables become one."""
    import random

    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    rows = [f"{a}>{b}" for a, b in zip(names, names[1:], strict=False)] + [f"{rng.choice(names)}>{rng.choice(names)}" for _ in range(3)] + [f"{n}>w{n}" for n in rng.sample(names, 4)] + ["n13>"]
    role = {n: "fitting" for n in names} | {f"w{n}": rng.choice(["isolation_valve", "check_valve", "equipment", "fitting"]) for n in names}
    monkeypatch.setattr(analysis, "FOLD", fold)
    out = analysis.isolation_boundary(edges(spark, *rows), spark.createDataFrame(list(role.items()), "node string, role string"), starts(spark, "n0", "n5"))
    near = {}
    for r in rows:
        a, b = r.split(">")
        if b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, borders = set(), set()
    for start in ("n0", "n5"):
        seen, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                if role[b] == "fitting":
                    todo.append(b)
        want |= {(start, n) for n in seen if n == start or role[n] == "fitting"}
        borders |= {(start, n) for n in seen if n != start and role[n] != "fitting"}
    assert [tuple(r) for r in out.region.select("query_id", "node").orderBy("query_id", "node").collect()] == sorted(want)
    rows = out.rows.where("predicate <> 'closed_end_in_region' and object is not null")
    assert {tuple(r) for r in rows.select("query_id", "object").collect()} == borders


def test_instrument_loop(spark):
    kind = EDGE + ", connection_type string"
    rows = [("s", "PT", "tank", "sensing_location"), ("m", "PT", "PIC", "measuring_line"), ("g", "PIC", "PV", "signal_line"), ("o", "PV", "valve", "operated_valve_reference"), ("s2", "TT", "tank", "sensing_location")]
    e = spark.createDataFrame([(i, a, b, None, None, "instrumentation", k, t) for k, (i, a, b, t) in enumerate(rows)], kind)
    kinds = spark.createDataFrame([(n, "instrumentation" if n in ("PT", "PIC", "PV", "TT") else "equipment") for n in ("PT", "PIC", "PV", "TT", "tank", "valve")], "node string, category string")
    members, chains = analysis.trace_instrumentation(e, kinds, starts(spark, "PIC"))
    assert {r.node for r in members.collect()} == {"PT", "PIC", "PV", "tank", "valve"}
    assert [r.elements for r in chains.collect()] == [["tank", "PT", "PIC", "PV", "valve"]]


def test_lines(spark):
    e = edges(spark, "t>a", "a>b", "b>j", "j>k", "j>m", "m>u").selectExpr("*", "case when id in ('p4', 'p5') then 'L2' else 'L1' end as line", "case when id = 'p1' then 'DN 50' else 'DN 80' end as size")
    roles = spark.createDataFrame([("t", "equipment"), ("u", "equipment")], "node string, role string")
    runs, meets = analysis.trace_line(e, roles)
    got = {(r.line, r.source, tuple(r.components), r.target, tuple(r.sizes), r.ends_at) for r in runs.collect()}
    assert got == {("L1", "t", ("a", "b"), "j", ("DN 80", "DN 50", "DN 80"), "junction"), ("L1", "j", (), "k", ("DN 80",), "end of the drawn piping"), ("L2", "j", ("m",), "u", ("DN 80",), "equipment")}
    assert {(r.line, r.node, r.other_line) for r in meets.collect()} == {("L1", "j", "L2"), ("L2", "j", "L1")}


def test_chains_against_plain_walks(spark):
    """Loops with branches, joints, rings and long stretches: all simple paths from members that nothing enters."""
    import random

    from millrace.operators import analysis

    rng = random.Random(7)
    for trial in range(3):
        names = [f"n{i}" for i in range(14)]
        links = [(f"L{trial}-{k}", *rng.sample(names, 2)) for k in range(13)] + [(f"R{k}", f"r{k}", f"r{(k + 1) % 4}") for k in range(4)] + [(f"C{k}", f"c{k}", f"c{k + 1}") for k in range(40)]
        edges = spark.createDataFrame([(i, a, b, "instrumentation", "signal_line", k) for k, (i, a, b) in enumerate(links)], "id string, source string, target string, relationship string, connection_type string, ord long")
        every = sorted({x for _, a, b in links for x in (a, b)})
        valves = set(rng.sample(names, 2))
        kinds = spark.createDataFrame([(x, "piping_component" if x in valves else "instrumentation") for x in every], "node string, category string")
        members, chains = analysis.trace_instrumentation(edges, kinds, spark.createDataFrame([(x, x) for x in ("n0", "n3", "r1", "c20")], "query_id string, node string"))
        got_members, got = {}, {}
        for r in members.collect():
            got_members.setdefault(r.query_id, set()).add(r.node)
        for r in chains.collect():
            got.setdefault(r.query_id, set()).add((tuple(r.elements), tuple(r.links)))
        for start in ("n0", "n3", "r1", "c20"):
            seen, todo, used = set(), [start], set()
            while todo:
                x = todo.pop()
                if x in seen or not any(x in (a, b) for _, a, b in links):
                    continue
                seen.add(x)
                if x == start or x not in valves:
                    used |= {(i, a, b) for i, a, b in links if x in (a, b)}
                    todo += [b if x == a else a for i, a, b in links if x in (a, b)]
            want = set()

            def follow(path, on):
                more = [(i, b) for i, a, b in used if a == path[-1] and b not in path]
                if not more:
                    want.add((path, on))
                for i, b in more:
                    follow((*path, b), (*on, i))

            for x in seen - {b for _, _, b in used}:
                follow((x,), ())
            assert got_members.get(start, set()) == seen, (trial, start)
            assert got.get(start, set()) == want, (trial, start)


def test_first_routes_of_a_grid(spark):
    """A grid 6 wide and 20 deep has 42,504 routes from corner to corner; the first twelve are found without the others."""
    wide, deep = 6, 20
    rows, n = [], 0
    for i in range(wide):
        for j in range(deep):
            for to in ((i + 1, j), (i, j + 1)):
                if to[0] < wide and to[1] < deep:
                    rows.append((f"e{n}", f"{i}.{j}", f"{to[0]}.{to[1]}", None, None, "piping", n))
                    n += 1
    e = spark.createDataFrame(rows, "id string, source string, target string, source_chamber string, target_chamber string, relationship string, ord long")
    out = {r.id: (r.source, r.target) for r in e.collect()}
    on = {}
    for own, (a, b) in out.items():
        on.setdefault(a, []).append((int(own[1:]), b))
    first = []

    def walk(node, path):
        if len(first) < 13:
            if node == f"{wide - 1}.{deep - 1}":
                first.append(path)
            else:
                for turn, b in sorted(on.get(node, [])):
                    walk(b, [*path, turn])

    walk("0.0", [])
    pairs = spark.createDataFrame([("q", "0.0", f"{wide - 1}.{deep - 1}")], "query_id string, source string, target string")
    got = graph.simple_paths(e, pairs).orderBy("nth").collect()
    assert [[int(s.id[1:]) for s in r.path] for r in got] == first[:12] and all(r.more for r in got)


def test_routes_behind_dead_ends(spark):
    """Many partial routes that come first lead nowhere, as a simple route can't go on from them; the ones that wait are taken then."""
    rows = [("a0", "s", "m", 0), ("z", "s", "t", 900)]
    for i in range(30):
        # From m into x_i, and on only back to m: x_i can reach t, but no route through m and x_i is simple.
        rows += [(f"b{i}", "m", f"x{i}", 10 + i), (f"c{i}", f"x{i}", "m", 100 + i)]
    rows += [("d", "m", "y", 800), ("f", "y", "t", 801)]
    e = spark.createDataFrame([(a, b, c, None, None, "piping", o) for a, b, c, o in rows], "id string, source string, target string, source_chamber string, target_chamber string, relationship string, ord long")
    pairs = spark.createDataFrame([("q", "s", "t")], "query_id string, source string, target string")
    assert [[s.id for s in r.path] for r in graph.simple_paths(e, pairs).orderBy("nth").collect()] == [["z"], ["a0", "d", "f"]]


def test_a_line_of_many_pipes(spark, monkeypatch):
    """10,000 pipes in a row, with two sizes: few tables are written, a logarithm of the line's length."""
    n = 10_000
    kept = []
    monkeypatch.setattr(analysis, "keep", lambda df, label, keep=analysis.keep: (kept.append(label), keep(df, label))[1])
    pipes = spark.range(n).selectExpr("concat('p', id) as id", "concat('n', id) as source", "concat('n', id + 1) as target", "'piping' as relationship", "'L' as line", f"if(id < {n // 2}, 'DN 50', 'DN 80') as size", "id as ord")
    runs, meets = analysis.trace_line(pipes, spark.createDataFrame([("n0", "equipment")], "node string, role string"))
    row = runs.collect()
    assert len(row) == 1 and row[0].source == "n0" and row[0].target == f"n{n}" and len(row[0].components) == n - 1 and row[0].components[:2] == ["n1", "n2"] and row[0].sizes == ["DN 50", "DN 80"] and row[0].ends_at == "end of the drawn piping"
    assert len(kept) <= 20 and meets.count() == 0


def test_places_within_and_across_tasks(spark, monkeypatch):
    """Chains and rings, lying together or dealt out at random: the same heads and places; what lies together takes no rounds."""
    import random

    from millrace.operators import stretches

    rng = random.Random(5)
    rows = [(q, f"{c}{k}", f"{c}{k - 1}" if k else None) for q in ("p", "q") for c in "abc" for k in range(30)]
    want = {(q, i, i[0] + "0", int(i[1:])) for q, i, _ in rows}
    rows += [("q", f"r{k}", f"r{(k - 1) % 5}") for k in range(5)]
    written = []
    whole = stretches.keep
    monkeypatch.setattr(stretches, "keep", lambda df, label: written.append(label) or whole(df, label))
    for spread, rounds in ((0, (1, 2)), (40, (2, 9))):
        written.clear()
        table = spark.createDataFrame([(*r, rng.randrange(spread << 18) if spread else k) for k, r in enumerate(rows)], "query_id string, id string, before string, at long")
        got = [(r.query_id, r.id, r.head, r.place) for r in stretches.jumped(table).collect()]
        assert len(got) == len(want) and set(got) == want
        assert rounds[0] <= written.count("places") <= rounds[1]


def test_loops_of_starts_that_are_no_instruments(spark):
    """A valve between two loops opens both, a start on a link without instruments has that link, and what stands alone has nothing."""
    rows = [("a", "F1", "F2", "signal_line"), ("b", "F2", "V", "operated_valve_reference"), ("c", "G1", "V", "operated_valve_reference"), ("d", "T", "U", "signal_line")]
    e = spark.createDataFrame([(i, a, b, None, None, "instrumentation", k, t) for k, (i, a, b, t) in enumerate(rows)], EDGE + ", connection_type string")
    kinds = spark.createDataFrame([(n, "instrumentation" if n[0] in "FGX" else "equipment") for n in ("F1", "F2", "G1", "V", "T", "U", "X")], "node string, category string")
    members, chains = analysis.trace_instrumentation(e, kinds, starts(spark, "V", "F1", "T", "X"))
    assert {tuple(r) for r in members.collect()} == {("V", x) for x in ("F1", "F2", "G1", "V")} | {("F1", x) for x in ("F1", "F2", "V")} | {("T", "T"), ("T", "U")}
    assert sorted((r.query_id, ">".join(r.elements)) for r in chains.collect()) == [("F1", "F1>F2>V"), ("T", "T>U"), ("V", "F1>F2>V"), ("V", "G1>V")]


def test_answers_copy_only_what_sentences_ask_for(spark, monkeypatch):
    """Of a run of forty events that feed one another, pieces are kept for named ones alone, copies are of pipes, and a stretch that lies together takes no rounds."""
    from pyspark.sql import functions as F

    from millrace.operators import answers, facts, stretches

    kept = {}
    whole = answers.keep
    monkeypatch.setattr(answers, "keep", lambda df, label: kept.update({label: whole(df, label)}) or kept[label])
    rounds = []
    monkeypatch.setattr(stretches, "keep", lambda df, label: rounds.append(label) or whole(df, label))
    e = spark.range(40).select(F.lit("r").alias("run_id"), F.concat(F.lit("E1."), (F.col("id") + 1).cast("string")).alias("ref"), F.concat(F.lit("EV-"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("EV-"), (F.col("id") + 1).cast("string")).alias("target"), F.concat(F.lit("pipe"), F.col("id").cast("string")).alias("pipe"))
    have = facts.fact(e.select("run_id", F.lit("E2.1").alias("ref"), "name"), "identified_as", subject="name", value="name").unionByName(facts.fact(e.where("target <> 'EV-40'"), "flows_to", subject="name", object="target", qualifiers=facts.qualifiers(connection=F.col("pipe"))))
    said = spark.createDataFrame([("r", "a", "EV-3 feeds EV-30 [R1]."), ("r", "b", "EV-30 feeds EV-3 [R1]."), ("r", "c", "EV-3 feeds EV-30 [E1.4].")], "run_id string, id string, text string")
    got = {r.id: r.level for r in answers.check(said, have).answers.collect()}
    assert got == {"a": "grounded", "b": "insufficient_evidence", "c": "limited"}
    assert {r.k for r in kept["pieces"].select("k").distinct().collect()} <= {"ev-3", "ev-30", "ev3", "ev30"}
    assert {r.predicate for r in kept["scoped"].select("predicate").distinct().collect()} == {"flows_to"}
    assert rounds.count("places") <= 2


def test_answers_look_up_only_what_they_name(spark, monkeypatch):
    """Of two runs of forty events, without claims: nothing is indexed, judged or searched but what sentences name, and facts are not copied for a citation of all of them."""
    from pyspark.sql import functions as F

    from millrace.operators import answers, claims, facts

    kept, searches = {}, []
    for module in (answers, claims, facts, graph):
        monkeypatch.setattr(module, "keep", lambda df, label, keep=module.keep, at=module.__name__.split(".")[-1]: (out := keep(df, label), kept.setdefault((at, label), out))[0])
    across = graph._reaching_across
    monkeypatch.setattr(graph, "_reaching_across", lambda *a: searches.append(1) or across(*a))
    e = spark.range(80).select((F.col("id") % 2).cast("string").alias("run_id"), F.floor(F.col("id") / 2).alias("n"))
    e = e.select("run_id", F.concat(F.lit("E1."), (F.col("n") + 1).cast("string")).alias("ref"), F.concat(F.lit("EV-"), F.col("n").cast("string")).alias("name"), F.concat(F.lit("EV-"), (F.col("n") + 1).cast("string")).alias("target"), F.concat(F.lit("pipe"), F.col("n").cast("string")).alias("pipe"))
    have = facts.fact(e.select("run_id", F.lit("E2.1").alias("ref"), "name"), "identified_as", subject="name", value="name").unionByName(facts.fact(e.where("target <> 'EV-40'"), "flows_to", subject="name", object="target", qualifiers=facts.qualifiers(connection=F.col("pipe"))))
    said = spark.createDataFrame([("0", "a", "EV-3 feeds EV-30 [R1]."), ("0", "b", "EV-30 feeds EV-3 [R1]."), ("1", "c", "EV-3 feeds EV-30 [E1.4]."), ("1", "d", "EV-3 feeds EV-30 [R2].")], "run_id string, id string, text string")
    got = {r.id: r.level for r in answers.check(said, have).answers.collect()}
    assert got == {"a": "grounded", "b": "insufficient_evidence", "c": "limited", "d": "limited"}
    assert kept["answers", "postings"].count() == kept["answers", "pieces"].count() == kept["claims", "facts"].count() == kept["claims", "evidence"].count() == 0
    # Both runs with all their pipes, and one with the pipe that is cited; result 2 relates nothing.
    assert sorted(r["count"] for r in kept["answers", "scoped"].groupBy("scope").count().collect()) == [1, 39, 39]
    assert not searches


def test_reaching_within_a_task_and_across_tasks(spark, monkeypatch):
    """Random scopes with chambers and rings: what one task searches is the same as what all tasks do, whatever scopes are taken for large."""
    import random

    rng = random.Random(7)
    chamber = lambda: rng.choice([None, None, "1", "2"])
    edges = [(s, f"n{rng.randrange(14)}", f"n{rng.randrange(14)}", chamber(), chamber()) for s in ("p", "q", "r") for _ in range(18 if s == "p" else 26)] + [("q", None, "n1", None, None), ("q", "n1", None, None, None), ("p", "n3", "n3", None, None)]
    pairs = [(s, f"n{a}", f"n{b}") for s in ("p", "q", "r", "none") for a in range(6) for b in range(14)]
    e = spark.createDataFrame(edges, "scope string, from string, to string, exit string, entry string")
    p = spark.createDataFrame(pairs, "scope string, a string, b string")
    found = []
    for within in (graph.WITHIN, 18 + 78 + 2, 0):
        monkeypatch.setattr(graph, "WITHIN", within)
        found.append(sorted(map(tuple, graph.reaching(e, p).collect())))
    assert found[0] == found[1] == found[2] and 0 < len(found[0]) < len(pairs)
