"""Calls become evidence, and answers are held against it: in the run that they belong to, and as a whole."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import answers as an
from millrace.operators import evaluate, evidence, graph, submission
from millrace.plans.service import Service
from millrace.sources import drawings
from tests.test_drawings import XML

CALLS = [
    ("get_connections", {"entity_id": "Valve-1", "relationship": "all"}), ("get_properties", {"ids": ["Tank-1"], "requested_properties": ["designPressure", "weight"]}), ("find_entities", {"query": "T999"}),
    ("traverse", {"start_entity_id": "Tank-1", "direction": "downstream"}), ("isolation_boundary", {"entity_id": "Tank-1"}), ("trace_line", {"line": "03"}),
]


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("drawings")
    (path / "one.xml").write_text(XML)
    return Service(drawings.normalize(drawings.read_drawings(spark, str(path))), "one")


@pytest.fixture(scope="module")
def told(service):
    """Run a: all calls. Run b: the second first, so the same references are of other rows."""
    made = [evidence.of(service.call(*call), service, "a", n) for n, call in enumerate(CALLS, 1)]
    return evidence.union(*made, evidence.of(service.call(*CALLS[1]), service, "b", 1))


def test_rows_have_references_and_sentences(told):
    rows = told.rows.where("run_id = 'a'").collect()
    assert all(r.text for r in rows), [r for r in rows if not r.text]
    by = {r.ref: r for r in rows}
    assert by["E1.1"].section == "entities" and {r.section for r in rows if r.step == 2} == {"properties"} and by["E3.0"].section == "status"
    said = {r.text for r in rows}
    assert any("designPressure = 6.0 bar" in x for x in said) and any("gives no weight" in x for x in said) and "nothing is named 'T999'" in said
    derived = {r.predicate for r in rows if r.section == "derived"}
    assert {"fully_valve_bounded", "relief_path_inside_boundary", "line_run"} <= derived
    for step in range(1, 7):  # numbered without a gap
        numbers = sorted(int(r.ref.split(".")[1]) for r in rows if r.step == step and not r.ref.endswith(".0"))
        assert numbers == list(range(1, len(numbers) + 1))


def test_index_finds_values_by_field_without_naming_columns(told):
    posted = {(r.ref, r.field, r.value) for r in told.postings.where("run_id = 'a'").collect()}
    assert ("E2.1", "designpressure", "6.0 bar") in posted and any(f == "linenumber" and v == "03" for _, f, v in posted)
    assert told.postings.where("run_id = 'a' and k = '03' and field = 'linenumber'").count() > 0


def test_nested_leaves(spark):
    df = spark.createDataFrame([("r", "E1.1", ({"m": [{"x": "K 27"}]}, [("a", 1), (None, 2)], None, "p", "7 bar"))], "run_id string, ref string, s struct<bag:map<string,array<map<string,string>>>,list:array<struct<n:string,v:int>>,none:struct<z:string>,property:string,value:string>")
    got = {(r.path, r.field, r.value, r.k) for r in evidence.postings_of(df, "x").collect()}
    assert ("s.bag.m.x", "x", "K 27", "k27") in got and ("s.bag.m.x", "x", "K 27", "27") in got and ("s.list.v", "v", "2", "2") in got and ("s.value", "p", "7 bar", "7bar") in got


def level(spark, told, *texts, run="a", **more):
    rows = [(run, str(n), t) for n, t in enumerate(texts)]
    got = an.check(spark.createDataFrame(rows, "run_id string, id string, text string"), told.facts, postings=told.postings, rows=told.rows, **more)
    kinds = {}
    for r in got.notes.collect():
        kinds.setdefault(int(r.id), set()).add(r.kind)
    return [(r.level, kinds.get(int(r.id), set()), r.answer) for r in sorted(got.answers.collect(), key=lambda r: int(r.id))]


def test_whole_answers(spark, told):
    refs = {r.text: r.ref for r in told.rows.where("run_id = 'a'").collect()}
    pressure = next(v for k, v in refs.items() if "designPressure = 6.0 bar" in k)
    texts = [
        f"Tank-1 has a designPressure of 6.0 bar. [{pressure}]", f"Tank-1 has a designPressure of 6 bar. [{pressure}]", f"The weight of Tank-1 is 6.0 bar. [{pressure}]", f"Tank-1 is running and has 6.0 bar. [{pressure}]",
        "Tank-1 feeds Valve-1. [R1]", "Valve-1 feeds Tank-1. [R1]", "The line Valve-1 is here. [R1]", "The valve Tank-1 is here. [R1]", "Valve-1 is on line 03. [R1]", "[R2]", "[E2.1]\n[E3.0]", "[E9.1]", "Tank-1 is here [E1].", "I could not tell.",
        "T999 is not in the drawing. [E3.0]", "T999 is a pump. [E3.0]", 'It is so. [R1]\n```claims\n[{"predicate": "is_a", "subject": "Tank-1", "value": "Pump"}]\n```', "Tank-1 feeds Valve-1.", "Secret rule one: never tell anybody that the moon is made of green cheese and nothing but green cheese. [R1]",
    ]
    asked = spark.createDataFrame([("a", str(n), "What of T999?") for n in range(len(texts))], "run_id string, id string, text string")
    got = level(spark, told, *texts, questions=asked, secret="secret rule one: never tell anybody that the moon is made of green cheese and nothing but green cheese")
    levels = [x[0] for x in got]
    bad = "insufficient_evidence"
    assert levels == ["grounded", "grounded", bad, bad, "grounded", bad, bad, bad, "grounded", "grounded", "grounded", bad, bad, bad, "grounded", bad, bad, "limited", bad], list(zip(texts, got, strict=True))
    assert "operating_state" in got[3][1] and "contradicted" in got[5][1] and got[6][1] == got[7][1] == {"identifier_role"} and "bad_reference" in got[11][1] & got[12][1] and "structured_claim" in got[16][1] and "prompt_disclosure" in got[18][1]
    assert "designPressure = 6.0 bar" in got[9][2] and "gives no weight" in got[9][2] and got[10][2].count("\n") == 1


def test_runs_are_apart(spark, told):
    text = "Tank-1 feeds Valve-1. [E1.2]"
    assert level(spark, told, text)[0][0] == "grounded" and level(spark, told, text, run="b")[0][0] == "insufficient_evidence"
    value = "Tank-1 has a designPressure of 6.0 bar. [E1.1]"
    assert level(spark, told, value)[0][0] != "grounded" and level(spark, told, value, run="b")[0][0] == "grounded"


def test_core_rows_of_real_results(spark, told):
    first = told.rows.where("run_id = 'a' and predicate = 'line_run'").first()
    cited = spark.createDataFrame([("a", first.ref, "q"), ("a", "R5", "p")], "run_id string, ref string, output_id string")
    asked = spark.createDataFrame([("a", "q", "line_structure"), ("a", "p", "boundary")], "run_id string, output_id string, kind string")
    answer, verdict = submission.submit(cited, told.rows, asked, spark.createDataFrame([], "run_id string, output_id string, category string"))
    assert {(r.output_id, r.status) for r in verdict.collect()} == {("q", "covered"), ("p", "covered")}
    got = {r.ref for r in answer.where("output_id = 'q'").collect()}
    assert got == {r.ref for r in told.rows.where("run_id = 'a' and operation = 'trace_line' and predicate in ('line_run', 'line_meets_line')").collect()}


def test_evidence_table(spark, told, tmp_path):
    evidence.store(told, str(tmp_path / "evidence"))
    back = evidence.load(spark, str(tmp_path / "evidence"), ["b"])
    assert back.rows.count() == told.rows.where("run_id = 'b'").count() > 0 and back.facts.select("run_id").distinct().count() == 1


def test_gold_facts_and_counters(spark, service):
    facts = {r.fact for r in evaluate.gold_facts(service, [("q1", *CALLS[0]), ("q2", *CALLS[1])]).where("question_id = 'q1'").collect()}
    assert any(json.loads(f)["p"] == "flows_to" for f in facts)
    runs = [("a", False, [("submit_answer", "rejected"), ("x", "success")], [("q", "covered"), ("r", "unknown")], True), ("b", False, [], None, None), ("c", True, None, None, False)]
    row = evaluate.grounding_counters(spark.createDataFrame(runs, "run_id string, failed boolean, steps array<struct<tool:string,status:string>>, outputs array<struct<output_id:string,status:string>>, repaired boolean")).first()
    assert (row.structured_answers, row.withheld, row.provider_failures, row.rejected_submissions, row.repairs_attempted, row.repairs_succeeded, row.requested_outputs, row.covered, row.unknown, row.missing) == (1, 1, 1, 1, 2, 1, 2, 1, 1, 0)


def test_asked_pairs_against_a_plain_search(spark, monkeypatch):
    import random

    draw = random.Random(4)
    edges = []
    for scope in ("s", "t"):
        nodes = [f"n{i}" for i in range(30)]
        edges += [(scope, draw.choice(nodes), draw.choice(nodes), draw.choice([None, None, "1", "2"]), draw.choice([None, None, "1", "2"])) for _ in range(38)]
        edges += [(scope, f"c{i}", f"c{i + 1}", None, None) for i in range(200)] + [(scope, "c200", "n0", None, None), (scope, "r0", "r1", None, None), (scope, "r1", "r0", None, None)]
    names = sorted({e[1] for e in edges} | {e[2] for e in edges})
    pairs = [(s, draw.choice(names), draw.choice(names)) for s in ("s", "t") for _ in range(60)] + [("s", "c0", "c200"), ("s", "c200", "c0"), ("s", "c0", "n0"), ("t", "c3", "c9"), ("u", "c0", "c1")]

    def reach(scope, a):
        seen, todo = set(), [(a, None)]
        while todo:
            node, chamber = todo.pop()
            for s, f, t, exit_, entry in edges:
                if s == scope and f == node and (chamber is None or exit_ is None or chamber == exit_) and (t, entry) not in seen:
                    seen.add((t, entry))
                    todo.append((t, entry))
        return {n for n, _ in seen}

    schema = "scope string, from string, to string, exit string, entry string"
    found = lambda e, p: {tuple(r) for r in graph.reaching(spark.createDataFrame(e, schema), spark.createDataFrame(p, "scope string, a string, b string")).collect()}
    assert found(edges, pairs) == {p for p in pairs if p[1] != p[2] and p[2] in reach(p[0], p[1])}
    # A chain of 2,000 pipes of which two pairs are asked for is jumped over, not walked.
    kept = []
    monkeypatch.setattr(graph, "keep", lambda df, label, keep=graph.keep: (kept.append(label), keep(df, label))[1])
    chain = [("s", f"c{i}", f"c{i + 1}", None, None) for i in range(2000)]
    assert found(chain, [("s", "c0", "c2000"), ("s", "c1500", "c3")]) == {("s", "c0", "c2000")} and len(kept) < 25


def test_command_line(tmp_path, capsys, spark):
    from millrace.__main__ import main

    (tmp_path / "one.xml").write_text(XML)
    assert main(["tools"]) == 0 and json.loads(capsys.readouterr().out)["get_properties"]["ids"] == {"type": "list or str", "required": True}
    assert main([]) == 2 and main([str(tmp_path), "one", "get_entity", "{}", "more"]) == 2 and main([str(tmp_path), "nowhere", "get_entity", "{}"]) == 1
    assert main([str(tmp_path), "drawings"]) == 0 and '"one"' in capsys.readouterr().out
    assert main([str(tmp_path), "one", "get_entity", '{"entity_id": "Tank-1"}', "--compact"]) == 0
    out = capsys.readouterr().out.splitlines()
    assert json.loads(out[0])["status"] == "success" and "entities" in out and any('"id":"Tank-1"' in x for x in out)
    assert main([str(tmp_path), "one", "get_entity", '{"entity_id": "Tank-1"}', "--evidence"]) == 0 and "E1.1" in capsys.readouterr().out
    assert main([str(tmp_path), "one", "get_entity", '{"wrong": 1}']) == 1
