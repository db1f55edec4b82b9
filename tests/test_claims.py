"""Facts, claims and prose on a small plant of our own."""

import pytest

from millrace.operators import answers as an
from millrace.operators import claims as cl
from millrace.operators import facts as ft


@pytest.fixture(scope="module")
def facts(spark):
    entities = [("P1", "CentrifugalPump", ["CentrifugalPump", "Pump", "Equipment"], "equipment", "P-100", "P-100", {"designPressure": "6.0 bar"}, None), ("T1", "Tank", ["Tank"], "equipment", "T 200", "T 200", {"nominalCapacity": "20 m3"}, None),
                ("V1", "GlobeValve", ["GlobeValve", "OperatedValve"], "piping_component", None, "V1", {}, {"nominalDiameterRepresentation": "DN 80"}), ("V2", "GlobeValve", ["GlobeValve", "OperatedValve"], "piping_component", None, "V2", {}, None),
                ("C1", "ProcessInstrumentationFunction", ["ProcessInstrumentationFunction"], "instrumentation", "PIC1", "PIC1", {}, None), ("A1", "ActuatingFunction", ["ActuatingFunction"], "instrumentation", "A1", "A1", {}, None)]
    e = spark.createDataFrame(entities, "id string, type string, type_hierarchy array<string>, category string, tag string, name string, properties map<string,string>, piping_context map<string,string>").selectExpr("*", "'E1.1' as ref", "'get_entity' as tool")
    ids = spark.createDataFrame([("V1", "loop", "77"), ("V2", "loop", "77")], "entity_id string, field string, value string")
    links = [("L1", "P1", "V1", "piping", "pipe", {"lineNumber": "03"}, None, "CH1"), ("L2", "V1", "T1", "piping", "pipe", {"lineNumber": "03"}, "CH1", None), ("L3", "V2", None, "piping", "open_end", {}, None, None), ("S1", "C1", "A1", "instrumentation", "signal_line", {}, None, None), ("O1", "A1", "V1", "instrumentation", "operated_valve_reference", {}, None, None)]
    c = spark.createDataFrame(links, "id string, source string, target string, relationship string, connection_type string, properties map<string,string>, source_chamber string, target_chamber string").selectExpr("*", "'E2.1' as ref", "'get_connections' as tool")
    steps = spark.createDataFrame([("P1", "T1", 2, [("L1", "P1", "V1", True), ("L2", "V1", "T1", True)])], "query_id string, node string, distance int, path array<struct<id:string,from:string,to:string,with_flow:boolean>>").selectExpr("*", "'E3.1' as ref", "'traverse' as tool")
    report = spark.createDataFrame([("P1", "weight", "missing", None, None, None), ("T1", "capacity", "found", "nominalCapacity", "20 m3", "own")], "entity_id string, name string, status string, property string, value string, scope string")
    looked = spark.createDataFrame([("K 9", "not_found", []), ("77", "ambiguous", ["V1", "V2"])], "query string, status string, candidates array<string>")
    missing = spark.createDataFrame([("T1", "P1")], "source string, target string")
    ends = spark.createDataFrame([("T1",)], "node string")
    return ft.union(ft.of_entities(e, ids), ft.of_connections(c), ft.of_reach(steps, "downstream", ends=ends), ft.of_report(report), ft.of_lookups(looked), ft.of_missing_path(missing, "downstream"))


CLAIMS = [
    ("is_a", {"subject": "P-100", "value": "pump"}, "supported"), ("is_a", {"subject": "P1", "value": "Tank"}, "unsupported"), ("is_a", {"subject": "pump P-100 (P1)", "value": "Centrifugal pump"}, "supported"),
    ("identified_as", {"subject": "T1", "value": "t200"}, "supported"), ("identified_as", {"subject": "T1", "value": "T 201"}, "unsupported"),
    ("has_property", {"subject": "P1", "property": "design pressure", "value": "6 bar"}, "supported"), ("has_property", {"subject": "P1", "property": "design pressure", "value": "7 bar"}, "contradicted"),
    ("has_property", {"subject": "P1", "property": "pressure", "value": "6 bar"}, "unsupported"), ("has_property", {"subject": "V1", "property": "nominal diameter", "value": "DN 80"}, "supported"), ("has_property", {"subject": "V1", "property": "nominal diameter", "value": "80 mm"}, "contradicted"),
    ("has_property", {"subject": "line 03", "property": "line", "value": "03"}, "supported"), ("lacks_property", {"subject": "P1", "property": "weight"}, "supported"), ("lacks_property", {"subject": "T1", "property": "weight"}, "unsupported"),
    ("connected_to", {"subject": "P1", "object": "V1"}, "supported"), ("connected_to", {"subject": "V1", "object": "P1"}, "supported"), ("connected_to", {"subject": "V1", "object": "P1", "qualifiers": {"direction": ["downstream"]}}, "contradicted"),
    ("connected_to", {"subject": "P1", "object": "V1", "qualifiers": {"line": ["03"]}}, "supported"), ("connected_to", {"subject": "P1", "object": "V1", "qualifiers": {"line": ["04"]}}, "unsupported"), ("connected_to", {"subject": "P1", "object": "T1"}, "unsupported"),
    ("reachable", {"subject": "P1", "object": "T1"}, "supported"), ("reachable", {"subject": "P1", "object": "T1", "qualifiers": {"direction": ["upstream"]}}, "contradicted"), ("reachable", {"subject": "T1", "object": "V1", "qualifiers": {"direction": ["upstream"]}}, "supported"),
    ("path", {"subject": "P1", "object": "T1", "route": ["P-100", "V1", "T1"]}, "supported"), ("path", {"subject": "P1", "object": "T1", "route": ["V1", "P1"]}, "unsupported"),
    ("no_path", {"subject": "T1", "object": "P1"}, "supported"), ("no_path", {"subject": "P1", "object": "T1"}, "unsupported"),
    ("operates", {"subject": "A1", "object": "V1"}, "supported"), ("operates", {"subject": "V1", "object": "A1"}, "contradicted"), ("sends_signal_to", {"subject": "PIC1", "object": "A1"}, "supported"), ("senses_at", {"subject": "PIC1", "object": "A1"}, "unsupported"),
    ("open_end", {"subject": "V2", "qualifiers": {"direction": ["downstream"]}}, "supported"), ("open_end", {"subject": "V2", "qualifiers": {"direction": ["upstream"]}}, "unsupported"), ("terminal", {"subject": "T1"}, "supported"), ("terminal", {"subject": "P1"}, "unsupported"),
    ("not_found", {"value": "K9"}, "supported"), ("not_found", {"value": "K8"}, "unsupported"), ("ambiguous", {"value": "77", "qualifiers": {"candidates": ["V1"]}}, "supported"), ("ambiguous", {"value": "77", "qualifiers": {"candidates": ["P1"]}}, "unsupported"),
    ("is_a", {"subject": "77", "value": "valve"}, "ambiguous"), ("is_a", {"subject": "X9", "value": "valve"}, "unknown"), ("connected_to", {"subject": "P1", "object": "X9"}, "unknown"), ("cools", {"subject": "P1", "object": "T1"}, "unknown_relation"),
]


def test_claims_of_every_kind(spark, facts):
    names = ("subject", "object", "value", "property", "qualifiers", "route")
    rows = [("", str(k), p, *(c.get(n) for n in names)) for k, (p, c, _) in enumerate(CLAIMS)]
    got = {int(r.claim_id): r for r in cl.judge(spark.createDataFrame(rows, cl.CLAIM), facts).collect()}
    assert {k: got[k].verdict for k in got} == {k: v for k, (_, _, v) in enumerate(CLAIMS)}
    assert all((got[k].fact_id is not None) == (v in ("supported", "contradicted")) for k, (_, _, v) in enumerate(CLAIMS))


def test_claim_blocks(spark):
    texts = [
        ("a", 'P1 feeds V1.\n\n## Claims:\n```claims\n[{"predicate": "is_a", "subject": "P1", "value": "Pump"}, {"predicate": "path", "subject": "P1", "object": "T1", "qualifiers": {"entities": ["P1", "T1"], "length": 2}}]\n```'),
        ("b", 'x\n```json\n{"predicate": "is_a"},\n[{"predicate": "terminal", "subject": "T1"}]\n```\n'), ("c", "no block"), ("d", "text\n```claims\n{broken\n```"), ("e", None), ("f", '```json\n{"claims": ["odd"]}\n```'),
    ]
    prose_, found = cl.read_claims(spark.createDataFrame([("r", *t) for t in texts], "run_id string, id string, text string"))
    assert {r.id: (r.prose, r.has_block) for r in prose_.collect()} == {"a": ("P1 feeds V1.", True), "b": ("x", True), "c": ("no block", False), "d": ("text", False), "e": ("", False), "f": ("", True)}
    got = {r.claim_id: r for r in found.collect()}
    assert set(got) == {"a/0", "a/1", "b/0", "b/1", "f/0"}
    assert got["a/1"].route == ["P1", "T1"] and got["a/1"].qualifiers == {"length": ["2"]} and got["f/0"].predicate is None


def test_answers_in_prose(spark, facts):
    answers = [
        ("ok", "P-100 feeds V1 [E2.1]. P-100 has a design pressure of 6.0 bar [E1.1]."), ("back", "T1 feeds P-100 [E2.1]."), ("value", "P-100 has 20 m3 [E1.1]."), ("strange", "P-100 feeds X99 [E2.1]."),
        ("side", "T1 is downstream of P-100 [E3.1]."), ("side_back", "P-100 is downstream of T1 [E3.1]."), ("link", "A1 operates V1 [E2.1]."), ("link_by", "V1 is operated by A1 [E2.1]."), ("link_back", "V1 operates A1 [E2.1]."),
        ("denied", "P-100 feeds V1, not T1 [E2.1]."), ("uncited", "P-100 feeds V1 [E1.1]."), ("bare", "P-100 feeds V1."), ("none", "It is the main pump."), ("bad", "P-100 feeds V1 [E9.9]."), ("apart", "P-100 is connected to V2 [E2.1]."), ("empty", None),
    ]
    got = an.check(spark.createDataFrame([("", *a) for a in answers], "run_id string, id string, text string"), facts)
    level = {r.id: r.level for r in got.answers.collect()}
    assert {k for k, v in level.items() if v == "grounded"} == {"ok", "side", "link", "link_by", "denied"}, level
    assert {k for k, v in level.items() if v == "limited"} == {"uncited", "bare"}, level
    status = {(r.id, r.relation): r.status for r in got.relations.collect()}
    assert status["back", "flow"] == status["side_back", "downstream"] == status["link_back", "operates"] == "contradicted" and status["apart", "related"] == "unsupported"
    assert {(r.id, r.term): r.status for r in got.terms.collect()}["value", "20 m3"] == "pairing"
