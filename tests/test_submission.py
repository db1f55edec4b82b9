"""Cited rows, fixed wording, budgets."""

from millrace.operators import submission as sb


def test_submission(spark):
    rows = [("E1.1", 1, "isolation_boundary", None, "derived", "isolation_boundary_valve", "V1"), ("E1.2", 1, "isolation_boundary", None, "derived", "closed_end_in_region", "T"), ("E1.3", 1, "isolation_boundary", None, "derived", "fully_valve_bounded", "yes"),
            ("E2.1", 2, "find_path", "topological", "paths", None, "a to b"), ("E3.1", 3, "get_entity", None, "entities", None, "P1")]
    run = lambda df, name="r": df.withColumn("run_id", sb.F.lit(name))
    rows = spark.createDataFrame(rows, "ref string, step int, operation string, semantics string, section string, predicate string, text string")
    cited = spark.createDataFrame([("E1.1", "q1"), ("E2.1", "q2"), ("E2.1", "q3"), ("E9.1", "q1"), ("R3", "q5"), ("E3.1", "q9")], "ref string, output_id string")
    asked = spark.createDataFrame([("q1", "boundary"), ("q2", "flow_reachability"), ("q3", "connectivity"), ("q4", "procedure_or_behaviour"), ("q5", "property"), ("q6", "count")], "output_id string, kind string")
    unknown = spark.createDataFrame([("q4", "operating_procedure")], "output_id string, category string")
    # A second run has the same references with other rows; neither knows of the other.
    both = lambda df: run(df).unionByName(run(df, "s")) if df is not rows else run(df).unionByName(run(df.withColumn("operation", sb.F.lit("get_entity")), "s"))
    answer, verdict = sb.submit(both(cited), both(rows), both(asked), both(unknown))
    other = {(r.output_id, r.ref, r.status) for r in verdict.where("run_id = 's'").collect()}
    assert ("q1", None, "wrong_operation") in other and ("q3", None, "wrong_operation") in other and {r.ref for r in answer.where("run_id = 's' and output_id = 'q1'").collect()} == {"E1.1"}
    answer, verdict = answer.where("run_id = 'r'"), verdict.where("run_id = 'r'")
    got = {(r.output_id, r.ref, r.status) for r in verdict.collect()}
    assert got == {("q1", None, "covered"), ("q2", None, "wrong_operation"), ("q3", None, "covered"), ("q4", None, "unknown"), ("q5", None, "covered"), ("q6", None, "missing"), ("q1", "E9.1", "unknown_reference"), ("q9", None, "unknown_output")}
    assert {(r.ref, r.kind, r.added) for r in answer.where("output_id = 'q1'").collect()} == {("E1.1", "derived", False), ("E1.3", "derived", True)}
    assert {(r.ref, r.kind) for r in answer.where("output_id = 'q5'").collect()} == {("E3.1", "direct")}
    single = sb.submit(run(spark.createDataFrame([("E3.1", None)], "ref string, output_id string")), run(rows), run(asked.where("output_id = 'q5'")), run(unknown.where("1 = 0")))[1]
    assert [(r.output_id, r.status) for r in single.collect()] == [("q5", "covered")]
    caps = {(r.kind, r.operation): r.semantics for r in sb.capabilities(spark).collect()}
    assert caps["flow_reachability", "traverse"] == "drawn_flow" and caps["connectivity", "find_path"] is None


def test_wording(spark):
    rows = [(1, "traverse", "empty", "P1", "downstream", False, False, 25, []), (2, "traverse", "empty", "P1", "downstream", True, False, 3, []), (3, "traverse", "empty", None, "both", False, True, 25, []), (4, "find_entities", "ambiguous", "77", None, False, False, 0, ["V1", "V2"]), (5, "traverse", "success", "P1", "both", False, False, 25, [])]
    said = {r.id: r.said for r in sb.status_text(spark.createDataFrame(rows, "id int, tool string, status string, item string, direction string, truncated boolean, limited boolean, max_depth int, candidates array<string>")).collect()}
    assert said[1].startswith("Nothing is downstream of P1") and "not searched" in said[2] and "does not show" in said[3] and "V1, V2" in said[4] and said[5] is None
    names = spark.createDataFrame([(1, "t 4750"), (1, "safe to open"), (1, "unsafe  to open"), (1, "Tank9"), (1, "x")], "id int, name string")
    known = spark.createDataFrame([("t 4750", "T 4750")], "k string, spelling string")
    asked = spark.createDataFrame([(1, "Is it Unsafe to open, or T 4750?")], "id int, text string")
    assert {r.name: r.shown for r in sb.shown(names, asked, known).collect()} == {"t 4750": "T 4750", "safe to open": None, "unsafe  to open": "Unsafe to open", "Tank9": None, "x": None}


def test_runs(spark):
    assert sb.call_key("a", {"y": 1, "x": None, "b": [2]}) == sb.call_key("a", {"b": [2], "y": 1}) != sb.call_key("a", {"y": 1})
    assert sb.stops_for(0, 0, 0, 0) is None and sb.stops_for(8, 0, 0, 0) and sb.stops_for(0, 16, 0, 0) and sb.stops_for(0, 0, 2, 0)
    found = spark.createDataFrame([("r", 1, "find_entities", "success", 1, "P1"), ("r", 3, "find_entities", "success", 1, "P1"), ("r", 4, "get_entity", "success", 1, "P1")], "run_id string, step int, tool string, status string, n int, entity_id string")
    assert [tuple(r) for r in sb.reused(found).collect()] == [("r", 3, "P1", 1)]
    steps = spark.createDataFrame([("r", 2, "b", None), ("r", 1, "a", "x")], "run_id string, step int, title string, body string")
    assert sb.transcript(steps).first().record == "## 1. a\nx\n\n## 2. b\n"
    calls = spark.createDataFrame([("r", 1, 2, 3), ("r", 4, 5, None)], "run_id string, prompt_tokens int, completion_tokens int, total_tokens int")
    assert tuple(sb.usage(calls).first()) == ("r", 2, 5, 7, 3)
    assert [(r.v, r.left_out) for r in sb.head(spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "g string, v int"), "g", "v", 2).collect()] == [(1, 1), (2, 1)]
