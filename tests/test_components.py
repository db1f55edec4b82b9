import importlib
import random

from millrace.operators.components import component_of, components


def plain(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in up}


def test_random_graphs_hubs_and_chains(spark):
    draw = random.Random(5)
    hub = [(0, i) for i in range(1, 400)]
    chain = [(1000 + i, 1001 + i) for i in range(300)]
    loose = [(draw.randint(2000, 2300), draw.randint(2000, 2300)) for _ in range(150)]
    loose = [(a, b) for a, b in loose if a != b]
    edges = hub + chain + loose
    draw.shuffle(edges)
    found = components(spark.createDataFrame(edges + edges[:50] + [(5, 5), (None, 4), (4, None)], "u long, v long"))
    assert {r.node: r.component for r in found.collect()} == plain(edges) and found.count() == len(plain(edges))


def test_strings_binary_and_lonely_nodes(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", None), ("y", "y")], "source string, target string")
    nodes = spark.createDataFrame([(n,) for n in "abcxyz"], "node string")
    assert {tuple(r) for r in component_of(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "y"), ("z", "z")}
    digests = components(edges.selectExpr("unhex(md5(source)) as u", "unhex(md5(target)) as v"))
    assert digests.count() == 3 and digests.select("component").distinct().count() == 1
    assert components(edges.where("false").toDF("u", "v")).count() == 0


def test_chains_in_one_file_are_stars_before_the_first_step(spark, monkeypatch):
    """A chain of 600 nodes takes the steps of a star: one that changes nothing. Blocks that cut it change no result."""
    own = importlib.import_module("millrace.operators.components")
    states, state = [], own._state
    monkeypatch.setattr(own, "_state", lambda df: states.append(1) or state(df))
    edges = spark.range(1, 600, 1, 1).selectExpr("id as u", "id - 1 as v")
    for block in (own.BLOCK, 7):
        monkeypatch.setattr(own, "BLOCK", block)
        states.clear()
        got = components(edges if block > 7 else edges.selectExpr("concat('n', u) as u", "concat('n', v) as v")).collect()
        assert len(got) == 600 and {r.component for r in got} == ({0} if block > 7 else {"n0"})
        assert block == 7 or len(states) == 2
