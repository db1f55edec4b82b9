"""A small drawing of our own, through parsing and normalization."""

from millrace.sources import drawings

XML = """<PlantModel><PlantInformation/>
<Equipment ID="Tank-1" ComponentClass="Tank"><GenericAttributes><GenericAttribute Name="TagNameAssignmentClass" Value="T100"/><GenericAttribute Name="DesignPressure" Value="6" Units="Bar"/></GenericAttributes>
 <Nozzle ID="Nozzle-1" ComponentClass="Nozzle"/></Equipment>
<Equipment ID="Section-1" ComponentClass="ColumnSection"><Association Type="is located in" ItemID="Tank-1"/></Equipment>
<PipingNetworkSystem ID="Line-1" ComponentClass="PipingNetworkSystem"><GenericAttributes><GenericAttribute Name="LineNumberAssignmentClass" Value="03"/><GenericAttribute Name="FluidCodeAssignmentClass" Value="W"/></GenericAttributes>
 <PipingNetworkSegment ID="Segment-1" ComponentClass="PipingNetworkSegment"><GenericAttributes><GenericAttribute Name="FluidCodeAssignmentClass" Value="S"/></GenericAttributes>
  <CenterLine/><PipingComponent ID="Valve-1" ComponentClass="GlobeValve"><GenericAttributes><GenericAttribute Name="PipingComponentNumberAssignmentClass" Value="C1"/></GenericAttributes></PipingComponent>
  <PipingComponent ID="Tee-1" ComponentClass="PipeTee"/><CenterLine/><Connection FromID="Nozzle-1"/></PipingNetworkSegment>
 <PipingNetworkSegment ID="Segment-2" ComponentClass="PipingNetworkSegment"><CenterLine/></PipingNetworkSegment>
</PipingNetworkSystem>
<ActuatingSystem ID="System-1" ComponentClass="ActuatingSystem"><Association Type="fulfills" ItemID="AF-1"/>
 <ActuatingSystemComponent ID="Reference-1" ComponentClass="OperatedValveReference"><Association Type="refers to" ItemID="Valve-1"/></ActuatingSystemComponent></ActuatingSystem>
<ProcessInstrumentationFunction ID="PIF-1" ComponentClass="ProcessInstrumentationFunction">
 <ProcessSignalGeneratingFunction ID="PSGF-1" ComponentClass="ProcessSignalGeneratingFunction"><Association Type="is located in" ItemID="Nozzle-1"/></ProcessSignalGeneratingFunction>
 <ActuatingFunction ID="AF-1" ComponentClass="ActuatingFunction"/>
 <InformationFlow ID="M-1" ComponentClass="MeasuringLineFunction"><Association Type="has logical start" ItemID="PSGF-1"/><Association Type="has logical end" ItemID="PIF-1"/></InformationFlow>
 <InformationFlow ID="S-1" ComponentClass="SignalConveyingFunction"><Association Type="has logical start" ItemID="PIF-1"/><Association Type="has logical end" ItemID="AF-1"/></InformationFlow>
 <InformationFlow ID="X-1" ComponentClass="OddFlow"/>
</ProcessInstrumentationFunction></PlantModel>"""


def test_drawing(spark, tmp_path):
    (tmp_path / "one.xml").write_text(XML)
    (tmp_path / "broken.xml").write_text("<PlantModel><open></PlantModel>")
    (tmp_path / "empty.xml").write_text("<PlantModel/>")
    objects = drawings.read_drawings(spark, str(tmp_path))
    plant = drawings.normalize(objects)
    kinds = {r.id: r.category for r in plant.entities.collect()}
    assert kinds == {"Tank-1": "equipment", "Line-1": "piping_line", "Valve-1": "piping_component", "Tee-1": "piping_component", "PIF-1": "instrumentation", "PSGF-1": "instrumentation", "AF-1": "instrumentation"}
    links = {r.id: (r.source, r.target, r.connection_type) for r in plant.connections.collect()}
    assert links == {
        "Segment-1/connections/1": ("Tank-1", "Valve-1", "pipe"),
        "Segment-1/connections/2": ("Valve-1", "Tee-1", "direct_piping_connection"),
        "Segment-1/connections/3": ("Tee-1", None, "open_end"),
        "Segment-2/connections/1": (None, None, "open_end"),
        "M-1": ("PSGF-1", "PIF-1", "measuring_line"),
        "S-1": ("PIF-1", "AF-1", "signal_line"),
        "PSGF-1/sensingLocation": ("PSGF-1", "Tank-1", "sensing_location"),
        "Reference-1": ("AF-1", "Valve-1", "operated_valve_reference"),
    }
    valve = plant.entities.where("id = 'Valve-1'").first()
    assert valve.line_number == "03" and valve.piping_context["fluidCode"] == "S" and "OperatedValve" in valve.type_hierarchy
    assert ("Valve-1", "lineComponent", "03/C1") in {(r.entity_id, r.field, r.value) for r in plant.identifiers.collect()}
    assert ("Tank-1", "designPressure", "6.0 bar", "own") in {(r.entity_id, r.property, r.value, r.scope) for r in plant.properties.collect()}
    assert {r.id for r in plant.sub_objects.where("owner_id = 'Tank-1'").collect()} == {"Nozzle-1", "Section-1"}
    assert {r.drawing_id for r in plant.warnings.collect()} == {"one", "broken", "empty"}
    matrix = {r.drawing_id: r for r in drawings.ingestion_matrix(objects, plant).collect()}
    assert matrix["one"].status == "ok" and matrix["one"].pipe == 1 and matrix["broken"].status == "failed" and matrix["empty"].error == "no objects"


def test_public_ids(spark):
    rows = [("d", "o", "nozzles", "N-1", 1), ("d", "o", "nozzles", None, 2), ("d", "o", "nozzles", None, 3), ("d", "p", "nozzles", None, 4)]
    out = drawings.number_siblings(spark.createDataFrame(rows, "drawing_id string, owner_id string, attr string, id string, ord long"))
    assert sorted(r.public_id for r in out.collect()) == ["N-1", "o/nozzles/2", "o/nozzles/3", "p/nozzles/1"]


def test_deep_objects_and_equal_names(spark, tmp_path):
    deep = "".join(f'<Part ID="P{i}" ComponentClass="Part">' for i in range(12)) + "</Part>" * 12
    text = f'<PlantModel><Equipment ID="E1" ComponentClass="Tank">{deep}</Equipment><Equipment ID="E2" ComponentClass="Gizmo"/></PlantModel>'
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.xml").write_text(text)
    plant = drawings.normalize(drawings.read_drawings(spark, str(tmp_path / "*" / "*.xml"), ids="path"))
    by_name = drawings.read_drawings(spark, str(tmp_path / "*" / "*.xml")).collect()
    assert [(r.drawing_id, r.error) for r in by_name] == [("same", "2 files have this name; read them with ids='path'")]
    owners = {(r.drawing_id[-10:], r.id, r.owner_id) for r in plant.sub_objects.collect()}
    assert owners == {(f"{folder}/same.xml", f"P{i}", "E1") for folder in "ab" for i in range(12)}
    assert all("Gizmo" in r.warning for r in plant.warnings.collect()) and plant.warnings.count() == 2
    assert {tuple(r.type_hierarchy) for r in plant.entities.collect()} == {("Tank", "Vessel", "Equipment"), ("Gizmo", "Equipment")}
