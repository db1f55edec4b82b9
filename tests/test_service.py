"""The ten operations by name on a small drawing, the resolver, properties, claims and scores."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import evaluate, grounding, properties, resolve
from millrace.plans.service import Service
from millrace.sources import drawings
from tests.test_drawings import XML


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("drawings")
    (path / "one.xml").write_text(XML)
    return Service(drawings.normalize(drawings.read_drawings(spark, str(path))), "one")


def ids(df, column="id"):
    return {r[column] for r in df.select(column).collect()}


def test_bad_calls_are_results(service):
    assert service.call("nothing", {}).status == "error"
    assert service.call("get_entity", "{").status == "error"
    assert service.call("get_entity", {"entity_id": "Tank-1", "more": 1}).status == "error"
    assert service.call("traverse", {"start_entity_id": "Tank-1", "direction": "sideways"}).status == "error"
    assert service.call("traverse", {"start_entity_id": "Tank-1", "direction": "downstream", "max_depth": "x"}).status == "error"
    assert service.call("get_entity", {}).status == "error"


def test_lookup(service):
    r = service.call("get_entity", '{"entity_id": "T100"}')
    assert r.status == "success" and ids(r.sections["entities"]) == {"Tank-1"} and r.warnings
    assert service.call("get_entity", {"entity_id": "T10"}).status == "not_found"
    assert ids(service.call("find_entities", {"query": "the valve 03/C1 there"}).sections["entities"]) == {"Valve-1"}
    assert ids(service.call("list_entities", {"entity_type": "Globe Valve"}).sections["entities"]) == {"Valve-1"}
    assert ids(service.call("list_entities", {"property_filter": {"design pressure": "6 bar"}}).sections["entities"]) == {"Tank-1"}
    r = service.call("list_entities", {"entity_type": "spaceship"})
    assert (r.status, r.meta["unknown_types"]) == ("empty", ["spaceship"]) and r.sections["types"].count() > 3
    for kind, want in {"GlobeValve": {"Valve-1"}, "globe_valves": {"Valve-1"}, "valves": {"Valve-1"}, "line": {"Line-1"}, "glob": {"Valve-1"}, "vessel": {"Tank-1"}, "equipment": {"Tank-1"}, "instrument": {"PIF-1", "PSGF-1", "AF-1"}, "fitting": {"Tee-1"}}.items():
        assert ids(service.call("list_entities", {"entity_type": kind}).sections["entities"]) == want, kind
    r = service.call("list_entities", {"entity_type": "tank", "properties": ["design pressure", "weight"]})
    assert [(x.property, x.value) for x in r.sections["attributes"].collect()] == [("designPressure", "6.0 bar")]
    assert {x.type for x in service.call("list_entities", {}).sections["types"].collect()} >= {"Tank", "GlobeValve"}
    assert ids(service.call("get_entity", {"entity_id": "Tank-1", "include_children": True}).sections["sub_objects"]) == {"Nozzle-1", "Section-1"}
    r = service.call("get_connections", {"entity_id": "Valve-1", "relationship": "all"})
    assert r.sections["connections"].count() == 3 and service.call("get_connections", {"entity_id": "Valve-1", "relationship": "x"}).status == "error"
    r = service.call("get_connections", {"entity_id": "Valve-1", "relationship": "piping", "direction": "upstream"})
    assert [(c.id, c.other, c.other_category) for c in r.sections["connections"].collect()] == [("Segment-1/connections/1", "Tank-1", "equipment")]
    assert service.call("get_connections", {"entity_id": "PIF-1", "relationship": "piping"}).status == "empty"
    assert {(r.side, r.id) for r in service.call("get_connections", {"entity_id": "Valve-1"}).sections["connections"].collect()} == {("upstream", "Segment-1/connections/1"), ("downstream", "Segment-1/connections/2"), ("incoming", "Reference-1")}


def test_properties_of_everything(service):
    r = service.call("get_properties", {"ids": ["Tank-1", "Segment-1/connections/1", "Segment-1", "nothing"], "requested_properties": ["fluid code", "designPressure"]})
    got = {(x.entity_id, x.property, x.value) for x in r.sections["properties"].where("status = 'found'").collect()}
    assert r.status == "success" and got == {("Tank-1", "designPressure", "6.0 bar"), ("Segment-1/connections/1", "fluidCode", "S"), ("Segment-1", "fluidCode", "S")}
    assert [(x.asked, x.error) for x in r.sections["errors"].collect()] == [("nothing", "not_found")]
    assert service.call("get_properties", {"ids": "T100"}).sections["properties"].where("property = 'designPressure'").count() == 1
    assert service.call("get_properties", {"ids": ["nothing"]}).status == "not_found"
    assert service.call("get_properties", {"ids": ["Tee-1"], "requested_properties": ["weight"]}).status == "empty"


def test_names_in_context(service):
    found = lambda q, **more: service.call("find_entities", {"query": q, **more})
    assert ids(found("valve on line 03").sections["entities"]) == {"Valve-1"}
    assert ids(found("line 03").sections["entities"]) == {"Line-1"}
    assert ids(found("03", entity_type="valve").sections["entities"]) == {"Valve-1"}
    r = found("the pump T100")
    assert ids(r.sections["entities"]) == {"Tank-1"}
    r = found("the valve T100")
    assert ids(r.sections["entities"]) == {"Tank-1"} and any("type" in w for w in r.warnings)
    assert found("all valves").status == "success" and found("all instruments").status == "success"
    r = found("the instrument")
    assert r.status == "ambiguous" and r.sections["entities"].count() == 3
    assert "connection" in found("Segment-1/connections/1").message and "Nozzle" in found("Nozzle-1").message
    r = found("T10")
    assert r.status == "not_found" and [x.entity_id for x in r.sections["suggestions"].collect()] == ["Tank-1"]
    assert ids(found("T100", entity_type="spaceship").sections["entities"]) == {"Tank-1"}
    assert found("T100", entity_type="valve").warnings


def test_loop_rows(service):
    rows = {(x.predicate, x.subject, x.object) for x in service.call("trace_instrumentation", {"entity_id": "PIF-1"}).sections["derived"].collect()}
    assert rows == {("signal_chain", "Tank-1", "Valve-1"), ("loop_measured_at", "PIF-1", "Tank-1"), ("loop_acts_on", "PIF-1", "Valve-1")}
    assert service.call("trace_line", {"line": "Valve-1"}).sections["runs"].count() > 0


def test_searches(service):
    r = service.call("traverse", {"start_entity_id": "Tank-1", "direction": "downstream"})
    assert {(x.id, x.distance) for x in r.sections["entities"].collect()} == {("Valve-1", 1), ("Tee-1", 2)}
    assert {(x.id, x.kind) for x in r.sections["endpoints"].collect()} == {("Tee-1", "end_of_piping")} and {x.id for x in r.sections["open_ends"].collect()} == {"Segment-1/connections/3"}
    r = service.call("find_path", {"source_entity_id": "Tank-1", "target_entity_id": "Tee-1"})
    assert [(p.length, p.shut_off_valves) for p in r.sections["paths"].collect()] == [(2, ["Valve-1"])]
    r = service.call("find_path", {"source_entity_id": "Tee-1", "target_entity_id": "Tank-1"})
    assert r.status == "empty" and r.warnings
    assert service.call("find_path", {"source_entity_id": "Tank-1", "target_entity_id": "Tee-1", "blocked_entity_ids": ["Valve-1"]}).status == "empty"
    assert service.call("find_path", {"source_entity_id": "Tank-1", "target_entity_id": "Tank-1"}).status == "error"
    s = service.call("isolation_boundary", {"entity_id": "Tank-1"}).sections["summary"].first()
    assert (s.valves, s.fully_valve_bounded) == (1, True)
    chains = service.call("trace_instrumentation", {"entity_id": "PIF-1"}).sections["chains"].collect()
    assert [c.elements for c in chains] == [["Tank-1", "PSGF-1", "PIF-1", "AF-1", "Valve-1"]]
    runs = service.call("trace_line", {"line": "line 03"}).sections["runs"].collect()
    assert {(r.source, tuple(r.components), r.target) for r in runs} >= {("Tank-1", ("Valve-1", "Tee-1"), None)}
    assert service.call("trace_line", {"line": "99"}).status == "not_found"


def test_suggestions_never_bind(spark):
    known = spark.createDataFrame([("e1", "tag", "P4711"), ("e2", "tag", "T4750"), ("e3", "tag", "P4712")], "entity_id string, field string, value string")
    q = spark.createDataFrame([("P4771",)], "query string")
    assert resolve.resolve(q, known).count() == 0
    assert [(r.entity_id, r.score) for r in resolve.suggestions(q, known).orderBy("nth").collect()] == [("e1", 0.8), ("e3", 0.8)]


def test_suggestions_against_all_pairs(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab01") for _ in range(n))
    known = [(f"e{i % 150:03d}", "tag", word(rng.randint(1, 9))) for i in range(200)] + [("h", "tag", "H18"), ("p", "tag", "P01")]
    queries = ["h8", "p1", "pump a10b please", *{word(rng.randint(1, 9)) for _ in range(40)}]
    got = {}
    frame = spark.createDataFrame(known, "entity_id string, field string, value string").repartition(5)
    for r in resolve.suggestions(spark.createDataFrame([(q,) for q in queries], "query string"), frame).orderBy("nth").collect():
        got.setdefault(r["query"], []).append((r.entity_id, r.score))
    norm = lambda s: "".join(c for c in s.lower() if c.isalnum())
    for q in queries:
        forms = {norm(q), *(norm(w) for w in q.split() if any(c.isdigit() for c in w))}
        best = {}
        for e, _, v in known:
            score = max(SequenceMatcher(None, f, norm(v)).ratio() for f in forms)
            if score >= 0.75:
                best[e] = max(best.get(e, 0), score)
        assert got.get(q, []) == [(e, round(s, 3)) for e, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]], q


def test_values(spark):
    rows = [("80 mm", "80.0 MM", True), ("DN 80", "80 mm", False), ("DN 80", "dn80", True), ("80", "80 mm", False), ("fail close", "Fail  Close", True), ("60.0 kW", "60 kW", True)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    assert [r[0] for r in df.select(text.values_match(F.col("a"), F.col("b"))).collect()] == [w for _, _, w in rows]


def test_same_value_needs_no_unit(spark):
    df = spark.createDataFrame([("6.0 bar", "6"), ("6.0 bar", "6 kPa"), ("S", "s "), ("6", "6 bar")], "a string, b string")
    assert [r[0] for r in df.select(text.same_value(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_property_names(spark):
    own = spark.createDataFrame([("e", "nominalDiameter", "DN 50", "own"), ("e", "nominalDiameterStandard", "X", "own"), ("e", "fluidCode", "W", "own")], "entity_id string, property string, value string, scope string")
    want = spark.createDataFrame([("e", "nominal diameter"), ("e", "diameter"), ("e", "code fluid"), ("e", "cod")], "entity_id string, name string")
    got = {(r.name, r.status, r.property) for r in properties.report(own, want).collect()}
    assert got == {("nominal diameter", "found", "nominalDiameter"), ("diameter", "found", "nominalDiameter"), ("diameter", "found", "nominalDiameterStandard"), ("code fluid", "found", "fluidCode"), ("cod", "missing", None)}


def test_terms(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "id int, text string")
    out = grounding.check_terms(t((1, "P4711 feeds T4750 and X99")), t((1, "P4711, T4750.")), t((1, "what about x99?")))
    assert {(r.term, r.status) for r in out.collect()} == {("p4711", "supported"), ("t4750", "supported"), ("x99", "question_only")}
    assert grounding.grounding_level(out).first().level == "limited"


def test_shown_rows(spark):
    rows = spark.createDataFrame([("path", "a", "x", 2), ("path", "a", "y", 1), ("path", "b", "z", 3)], "kind string, id string, statement string, ord int")
    shown = grounding.evidence_rows(rows, 1).collect()
    assert [(r.statement, r.left_out) for r in shown] == [("y", 1)]


def test_scores(spark):
    rows = [("a", "required", True, True, False), ("a", "required", False, True, False), ("a", "forbidden", False, True, False), ("b", "required", True, True, False), ("b", "forbidden", True, True, False), ("c", "required", False, False, False), ("d", "required", False, True, True)]
    out = evaluate.answer_scores(spark.createDataFrame(rows, "question_id string, kind string, matched boolean, answered boolean, failed boolean"))
    assert {r.question_id: (r.score, r.outcome) for r in out.collect()} == {"a": (0.5, "partial"), "b": (0.0, "incorrect"), "c": (0.0, "abstained"), "d": (None, "infrastructure")}


def test_a_call_by_id_needs_no_catalogue_of_names(spark, monkeypatch):
    from millrace.plans import service as module

    written = []
    whole = module.keep
    monkeypatch.setattr(module, "keep", lambda df, label: written.append(label) or whole(df, label))
    entities = spark.createDataFrame([("d", n, "ProcessInstrumentationFunction", ["ProcessInstrumentationFunction"], "instrumentation", n, True, None, k) for k, n in enumerate(("A", "B"))], "drawing_id string, id string, type string, type_hierarchy array<string>, category string, tag string, in_topology boolean, line_number string, ord long")
    links = spark.createDataFrame([("d", "s", "A", "B", "instrumentation", "signal_line", 0)], "drawing_id string, id string, source string, target string, relationship string, connection_type string, ord long")
    none = lambda ddl: spark.createDataFrame([], f"drawing_id string, {ddl}")
    plant = module.Plant(entities, none("id string"), none("entity_id string, field string, value string"), links, none("entity_id string, property string, value string, scope string"), none("warning string"), none("id string"))
    out = module.Service(plant, "d").call("trace_instrumentation", {"entity_id": "B"})
    assert [tuple(r.elements) for r in out.sections["chains"].collect()] == [("A", "B")]
    assert not {"identifiers", "phrases", "places"} & set(written)
