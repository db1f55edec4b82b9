"""Proteus XML drawings -> object rows -> entities, sub-objects, identifiers, connections, warnings.

Files are read as binary by Spark, many drawings in one job; each is parsed where it was read. A file that can't be parsed is a row with
an error, not a failed job. Normalization is a set of DataFrame steps partitioned by drawing_id, with document order kept in ord.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import UNITS
from millrace.operators import graph
from millrace.plans.storage import keep

LINK = "struct<n:int,kind:string,source:string,target:string>"
OBJECTS = f"drawing_id string, ord bigint, tag string, id string, owner_id string, type string, properties map<string,string>, associations array<struct<kind:string,item:string>>, links array<{LINK}>, error string"

#: Most repeated file names that are broadcast.
#: Elements that are topology nodes, by category.
PIPING_TAGS = ("PipingComponent", "PipeOffPageConnector")
INSTRUMENT_TYPES = ("ProcessInstrumentationFunction", "ProcessSignalGeneratingFunction", "ActuatingFunction")
OTHER_NODES = ("PipeOffPageConnectorReference",)
#: Class of an information flow -> connection type.
FLOWS = {"MeasuringLineFunction": "measuring_line", "SignalLineFunction": "signal_line", "SignalConveyingFunction": "signal_line"}
#: Properties that identify an object.
IDENTIFIER_FIELDS = ("tagName", "subTagName", "lineNumber", "segmentNumber", "pipingComponentName", "pipingComponentNumber", "positionNumber", "instrumentationLoopFunctionNumber", "processInstrumentationFunctionNumber", "deviceTypeName", "plantSystemIdentificationCode")
#: The published class tree, as far as it decides a role or a type phrase: class -> classes right below it.
CLASS_TREE = {
    "OperatedValve": "AngleBallValve AngleGlobeValve AnglePlugValve AngleValve BallValve ButterflyValve CustomOperatedValve GateValve GlobeValve NeedleValve PlugValve StraightwayValve",
    "CheckValve": "CustomCheckValve GlobeCheckValve SwingCheckValve",
    "SafetyValveOrFitting": "BreatherValve CustomSafetyValveOrFitting FlameArrestor RuptureDisc SpringLoadedAngleGlobeSafetyValve SpringLoadedGlobeSafetyValve",
    "PipeOffPageConnector": "FlowInPipeOffPageConnector FlowOutPipeOffPageConnector",
    "PipeFitting": "BlindFlange ClampedFlangeCoupling ConicalStrainer CustomPipeFitting Flange FlangedConnection Funnel Hose IlluminatedSightGlass InLineMixer LineBlind Penetration PipeCoupling PipeFlangeSpacer PipeFlangeSpade PipeReducer PipeTee SightGlass Silencer SteamTrap Strainer VentLineHood",
    "InlinePrimaryElement": "CustomInlinePrimaryElement ElectromagneticFlowMeter FlowMeasuringElement FlowNozzle MassFlowMeasuringElement PositiveDisplacementFlowMeter RestrictionOrifice TurbineFlowMeter VariableAreaFlowMeter VenturiTube VolumeFlowMeasuringElement",
    "PipingComponent": "OperatedValve CheckValve SafetyValveOrFitting PipeOffPageConnector PipeFitting InlinePrimaryElement",
    "Pump": "CentrifugalPump CustomPump EjectorPump ReciprocatingPump RotaryPump",
    "Compressor": "AirEjector AxialCompressor CentrifugalCompressor CustomCompressor ReciprocatingCompressor RotaryCompressor",
    "Blower": "AxialBlower CentrifugalBlower CustomBlower",
    "Fan": "AxialFan CustomFan RadialFan",
    "HeatExchanger": "CustomHeatExchanger PlateHeatExchanger SpiralHeatExchanger ThinFilmEvaporator TubularHeatExchanger",
    "Heater": "Boiler CustomHeater ElectricHeater Furnace SteamGenerator",
    "CoolingTower": "CustomCoolingTower DryCoolingTower SprayCooler WetCoolingTower",
    "Vessel": "CustomVessel PressureVessel Silo Tank",
    "Filter": "CustomFilter GasFilter LiquidFilter",
    "Separator": "CustomSeparator ElectricalSeparator GravitationalSeparator MechanicalSeparator ScrubbingSeparator",
    "Mixer": "CustomMixer Kneader RotaryMixer StaticMixer",
    "Motor": "AlternatingCurrentMotor CustomMotor DirectCurrentMotor",
    "Turbine": "CustomTurbine GasTurbine SteamTurbine",
    "Equipment": "Pump Compressor Blower Fan HeatExchanger Heater CoolingTower Vessel Filter Separator Mixer Motor Turbine Agglomerator Burner Centrifuge Chimney Crusher Dryer ElectricGenerator Engine Extruder Feeder Flare Grinder LoadingUnloadingSystem Mill PackagingSystem ProcessColumn Sieve StationaryTransportSystem TransportableContainer Weigher CustomEquipment",
}


def _chains() -> dict[str, list[str]]:
    """Class -> its ancestors, the nearest first."""
    above = {below: name for name, all_below in CLASS_TREE.items() for below in all_below.split()}
    out = {}
    for name in above:
        out[name] = [above[name]]
        while (last := out[name][-1]) in above:
            out[name].append(above[last])
    return out


ANCESTORS = _chains()
IDS = ("name", "path")


def read_drawings(spark: SparkSession, *paths: str, ids: str = "name") -> DataFrame:
    """One row per object of each drawing; a drawing without any, or that isn't XML, has one row with error.

    ids: what a drawing is called, always in the same way: name, its file's name without the ending, or path. Files of one name can't be told apart by it: they have one row with error, and none of objects.
    """
    if ids not in IDS:
        raise ValueError(f"ids must be one of {', '.join(IDS)}")
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    if ids == "path":
        return files.select(F.col("path").alias("drawing_id"), "content").mapInPandas(parsed, OBJECTS)
    named = files.select(drawing_name(F.col("path")).alias("drawing_id"), "content")
    several = named.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    once = named.join(several, "drawing_id", "left_anti").mapInPandas(parsed, OBJECTS)
    schema = {f.name: f.dataType for f in once.schema}
    given = {"drawing_id": F.col("drawing_id"), "ord": F.lit(0), "error": F.concat("k", F.lit(" files have this name; read them with ids='path'"))}
    return once.unionByName(several.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in schema.items())))


def drawing_name(path: F.Column) -> F.Column:
    """The file's name without its ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"[.][^.]*$", "")


def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["drawing_id", "ord", "tag", "id", "owner_id", "type", "properties", "associations", "links", "error"]
    for frame in frames:
        for drawing, content in zip(frame["drawing_id"], frame["content"], strict=True):
            try:
                rows = _objects(drawing, ElementTree.fromstring(content))
                error = None if rows else "no objects"
            except ElementTree.ParseError as e:
                rows, error = [], str(e)
            if error:
                rows = [(drawing, 0, None, None, None, None, {}, [], [], error)]
            yield pd.DataFrame(rows, columns=names)


def _objects(drawing: str, root: ElementTree.Element) -> list[tuple]:
    rows, todo = [], [(root, None)]
    while todo:
        element, owner = todo.pop()
        own = element.get("ID")
        if own and element.get("ComponentClass"):
            kinds = [{"kind": a.get("Type"), "item": a.get("ItemID")} for a in element.findall("Association")]
            links = _chain(element) if element.tag == "PipingNetworkSegment" else []
            rows.append((drawing, len(rows), element.tag, own, owner, element.get("ComponentClass"), _properties(element), kinds, links, None))
            owner = own
        todo += [(child, owner) for child in reversed(element)]
    return rows


def _properties(element: ElementTree.Element) -> dict[str, str]:
    out = {}
    for a in element.findall("GenericAttributes/GenericAttribute"):
        name, value, unit = a.get("Name", ""), a.get("Value"), a.get("Units")
        for end in ("AssignmentClass", "Specialization"):
            name = name.removesuffix(end)
        if value is not None and name:
            if unit:
                number = value if "." in value or not value.lstrip("+-").isdigit() else f"{value}.0"
                value = f"{number} {UNITS.get(unit, unit)}"
            out[name[0].lower() + name[1:]] = value
    return out


def _chain(segment: ElementTree.Element) -> list[dict]:
    """A segment's items in order with the pipes between them; a pipe that begins or ends with nothing has an open end."""
    nodes: list[tuple[str | None, bool]] = []  # (item, whether a centre line comes before it)
    connection = segment.find("Connection")
    ends = (connection.get("FromID"), connection.get("ToID")) if connection is not None else (None, None)
    line = False
    for child in segment:
        if child.tag == "CenterLine":
            line = True
        elif child.get("ID") and child.get("ComponentClass"):
            nodes.append((child.get("ID"), line))
            line = False
    first = nodes[0] if nodes else None
    if ends[0] and (first is None or first[0] != ends[0]):
        nodes.insert(0, (ends[0], False))
    elif first and first[1]:
        nodes.insert(0, (None, False))
    if not nodes and line:
        nodes.append((None, False))
    if ends[1] and nodes[-1:] != [] and nodes[-1][0] != ends[1]:
        nodes.append((ends[1], line))
    elif line and nodes:
        nodes.append((None, True))
    pairs = zip(nodes, nodes[1:], strict=False)
    return [{"n": k, "kind": "open_end" if a is None or b is None else "pipe" if piped else "direct_piping_connection", "source": a, "target": b} for k, ((a, _), (b, piped)) in enumerate(pairs, 1)]


@dataclass
class Plant:
    entities: DataFrame
    sub_objects: DataFrame
    identifiers: DataFrame
    connections: DataFrame
    properties: DataFrame
    warnings: DataFrame
    objects: DataFrame


def normalize(objects: DataFrame) -> Plant:
    """The tables of all drawings at once."""
    o = keep(objects.where("error is null"), "objects")
    located = o.select("drawing_id", F.col("id").alias("inner"), F.explode("associations").alias("a")).where("a.kind = 'is located in'").select("drawing_id", "inner", F.col("a.item").alias("outer"))
    kinds = o.select("drawing_id", F.col("id").alias("outer"), F.col("tag").alias("outer_tag"), F.col("type").alias("outer_type"))
    located = located.join(kinds, ["drawing_id", "outer"], "left")
    nested = located.where("outer_tag = 'Equipment'").select("drawing_id", F.col("inner").alias("id"), F.col("outer").alias("within"))
    parents = o.select("drawing_id", F.col("id").alias("owner_id"), F.col("tag").alias("owner_tag"))
    sensed = located.where("outer_tag = 'PipingNetworkSegment'").select("drawing_id", F.col("outer").alias("id")).distinct().withColumn("sensed", F.lit(True))
    own = o.join(parents, ["drawing_id", "owner_id"], "left").join(nested, ["drawing_id", "id"], "left").join(sensed, ["drawing_id", "id"], "left")
    equipment = (F.col("tag") == "Equipment") & F.col("within").isNull() & ~F.coalesce(F.col("owner_tag") == "Equipment", F.lit(False))
    category = F.when(equipment, "equipment").when(F.col("tag").isin(*PIPING_TAGS), "piping_component").when(F.col("type").isin(*INSTRUMENT_TYPES) | F.col("tag").isin(*OTHER_NODES) | F.col("sensed"), "instrumentation").when(F.col("tag") == "PipingNetworkSystem", "piping_line")
    own = own.withColumn("category", category)
    above = F.create_map(*(F.lit(x) for k, v in ANCESTORS.items() for x in (k, " ".join(v))))
    hierarchy = F.concat(F.array("type"), F.coalesce(F.split(F.element_at(above, F.col("type")), " "), F.when(F.col("tag") == "Equipment", F.array(F.lit("Equipment"))).when(F.col("tag").isin(*PIPING_TAGS), F.array(F.lit("PipingComponent"))).otherwise(F.expr("cast(array() as array<string>)"))))

    # A segment's bag is its line's, overridden by its own; a component has its segment's as context.
    line = o.where("tag = 'PipingNetworkSystem'").select("drawing_id", F.col("id").alias("line_id"), F.col("properties").alias("line_properties"))
    segment = o.where("tag = 'PipingNetworkSegment'").select("drawing_id", F.col("id").alias("segment_id"), F.col("owner_id").alias("line_id"), "properties", "links", F.col("ord").alias("segment_ord")).join(line, ["drawing_id", "line_id"], "left")
    overridden = F.map_concat(F.map_filter(F.coalesce("line_properties", F.expr("map()").cast("map<string,string>")), lambda k, v: ~F.map_contains_key("properties", k)), "properties")
    segment = keep(segment.withColumn("bag", overridden), "segments")

    context = segment.select("drawing_id", F.col("segment_id").alias("owner_id"), "line_id", "bag")
    found = own.where("category is not null").join(context, ["drawing_id", "owner_id"], "left")
    tag = F.col("properties")["tagName"]
    name = F.coalesce(tag, F.col("properties")["positionNumber"], F.col("properties")["lineNumber"], F.col("properties")["pipingComponentName"], F.col("id"))
    segment_id = F.when(F.col("category") == "piping_component", F.col("owner_id"))
    entities = keep(found.select("drawing_id", "id", "type", hierarchy.alias("type_hierarchy"), "category", tag.alias("tag"), name.alias("name"), "properties", F.col("bag").alias("piping_context"), F.when(F.col("category") == "piping_line", F.col("id")).otherwise(F.col("line_id")).alias("line_id"), segment_id.alias("segment_id"), F.coalesce(F.col("bag")["lineNumber"], F.when(F.col("category") == "piping_line", F.col("properties")["lineNumber"])).alias("line_number"), (F.col("category") != "piping_line").alias("in_topology"), "ord"), "entities")

    # Owner of any object: the nearest entity above it, or above what it is located in.
    up = own.select("drawing_id", F.col("id").alias("node"), F.coalesce("within", "owner_id").alias("up"))
    marks = entities.where("in_topology").select("drawing_id", F.col("id").alias("node"), F.lit(True).alias("entity"))
    reach = own.select("drawing_id", "id", F.col("id").alias("node"), F.lit(0).alias("depth"), F.array("id").alias("above"))
    owner = None
    while owner is None or not reach.isEmpty():
        here = reach.join(marks, ["drawing_id", "node"], "left")
        hit = here.where("entity").select("drawing_id", "id", F.col("node").alias("owner"), "depth")
        owner = hit if owner is None else owner.unionByName(hit)
        # Objects nest as deep as they like; one that lies within itself is not met again.
        higher = here.where("entity is null").join(up, ["drawing_id", "node"]).where("up is not null and not array_contains(above, up)")
        reach = higher.select("drawing_id", "id", F.col("up").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("above", F.array("up")).alias("above"))
        reach = keep(reach, "reach")
    owner = keep(owner, "owners")
    sub = own.join(owner.where("depth > 0"), ["drawing_id", "id"]).where("tag not in ('PipingNetworkSegment', 'PipingNetworkSystem', 'InformationFlow')")
    sub_objects = sub.select("drawing_id", F.col("owner").alias("owner_id"), "id", "type", "tag", "properties", "ord")

    connections = _connections(o, segment, located, owner)
    fields = F.array(*map(F.lit, IDENTIFIER_FIELDS))
    listed = lambda df, entity, prefix: df.select("drawing_id", F.col(entity).alias("entity_id"), prefix.alias("prefix"), F.explode(F.map_filter("properties", lambda k, v: F.array_contains(fields, k))).alias("field", "value"))
    identifiers = listed(entities, "id", F.lit("")).withColumns({"kind": F.lit("identifier"), "origin": F.lit("source")}).unionByName(listed(sub_objects, "owner_id", F.concat("type", F.lit("."))).withColumns({"kind": F.lit("alias"), "origin": F.lit("alias")}))
    identifiers = identifiers.select("drawing_id", "entity_id", F.concat("prefix", "field").alias("field"), "value", "kind", "origin")
    derive = lambda field, value: entities.select("drawing_id", F.col("id").alias("entity_id"), F.lit(field).alias("field"), value.alias("value"), F.lit("identifier").alias("kind"), F.lit("derived").alias("origin")).where("value is not null")
    p = F.col("properties")
    instrument = F.concat(p["processInstrumentationFunctionCategory"], F.coalesce(p["processInstrumentationFunctions"], F.lit("")), F.coalesce(p["processInstrumentationFunctionNumber"], F.lit("")))
    identifiers = identifiers.unionByName(derive("lineComponent", F.concat("line_number", F.lit("/"), p["pipingComponentNumber"]))).unionByName(derive("instrumentTag", instrument))
    scope = lambda df, entity, s, source, bag="properties": df.select("drawing_id", F.col(entity).alias("entity_id"), F.explode(bag).alias("property", "value"), s.alias("scope"), F.col(source).alias("source_object_id"))
    properties = scope(entities, "id", F.lit("own"), "id").unionByName(scope(entities.where("piping_context is not null"), "id", F.lit("owning_segment"), "segment_id", "piping_context"))
    properties = properties.unionByName(scope(sub_objects, "owner_id", F.concat(F.lit("child:"), F.col("type")), "id"))
    # Connections and other objects answer by their own ids.
    others = o.join(entities.select("drawing_id", "id"), ["drawing_id", "id"], "left_anti")
    properties = properties.unionByName(scope(connections, "id", F.lit("connection"), "id")).unionByName(scope(others, "id", F.lit("object"), "id"))
    found_objects = others.join(owner.where("depth > 0").select("drawing_id", "id", F.col("owner").alias("owner_entity_id")), ["drawing_id", "id"], "left").select("drawing_id", "id", "type", "owner_entity_id")
    known = [*FLOWS]
    strange = o.where((F.col("tag") == "InformationFlow") & ~F.col("type").isin(*known)).select("drawing_id", F.concat(F.lit("unknown link class "), F.col("type")).alias("warning"))
    unplaced = entities.where(F.col("in_topology") & F.col("category").isin("equipment", "piping_component") & ~F.col("type").isin(*ANCESTORS, *CLASS_TREE))
    strange = strange.unionByName(unplaced.select("drawing_id", F.concat(F.lit("class without a place in the class tree, its role is a guess: "), "type", F.lit(" ("), "id", F.lit(")")).alias("warning")).distinct())
    warnings = strange.unionByName(objects.where("error is not null").select("drawing_id", F.col("error").alias("warning")))
    return Plant(entities, sub_objects, identifiers, connections, properties, warnings, found_objects)


def _connections(o: DataFrame, segment: DataFrame, located: DataFrame, owner: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    owned = lambda end: owner.select("drawing_id", F.col("id").alias(f"{end}_object"), F.col("owner").alias(end))
    piping = segment.select("drawing_id", "segment_id", "bag", "segment_ord", F.explode("links").alias("l"))
    piping = piping.select("drawing_id", F.concat("segment_id", F.lit("/connections/"), F.col("l.n").cast("string")).alias("id"), F.lit("piping").alias("relationship"), F.col("l.kind").alias("connection_type"), F.col("l.source").alias("source_object"), F.col("l.target").alias("target_object"), F.map_concat(F.create_map(F.lit("segment_id"), F.col("segment_id")), F.map_filter("bag", lambda k, v: k != "segment_id")).alias("properties"), (F.col("segment_ord") * 1000 + F.col("l.n")).alias("ord"))
    role = lambda kind: F.get(F.filter("associations", lambda a: a["kind"] == kind), 0)["item"]
    empty = F.expr("cast(map() as map<string,string>)")
    link = lambda df, id_, kind, source, target: df.select("drawing_id", id_.alias("id"), F.lit("instrumentation").alias("relationship"), kind.alias("connection_type"), source.alias("source_object"), target.alias("target_object"), empty.alias("properties"), (F.col("ord") * 1000).alias("ord"))
    kinds = F.create_map(*(F.lit(x) for kv in FLOWS.items() for x in kv))
    flows = link(o.where(F.col("type").isin(*FLOWS)), F.col("id"), F.element_at(kinds, F.col("type")), role("has logical start"), role("has logical end"))
    sensors = o.where("type = 'ProcessSignalGeneratingFunction'").join(located.where("outer_tag <> 'PipingNetworkSegment'").select("drawing_id", F.col("inner").alias("id"), "outer"), ["drawing_id", "id"])
    sensing = link(sensors, F.concat("id", F.lit("/sensingLocation")), F.lit("sensing_location"), F.col("id"), F.col("outer"))
    acting = o.where("tag = 'ActuatingSystem'").select("drawing_id", F.col("id").alias("owner_id"), role("fulfills").alias("function"))
    valves = link(o.where("type = 'OperatedValveReference'").join(acting, ["drawing_id", "owner_id"]), F.col("id"), F.lit("operated_valve_reference"), F.col("function"), role("refers to"))
    every = piping.unionByName(flows).unionByName(sensing).unionByName(valves)
    every = every.join(owned("source"), ["drawing_id", "source_object"], "left").join(owned("target"), ["drawing_id", "target_object"], "left")
    chamber = located.where("outer_type = 'Chamber'").select("drawing_id", F.col("inner"), F.col("outer").alias("chamber"))
    by = lambda end: chamber.select("drawing_id", F.col("inner").alias(f"{end}_object"), F.col("chamber").alias(f"{end}_chamber"))
    every = every.join(by("source"), ["drawing_id", "source_object"], "left").join(by("target"), ["drawing_id", "target_object"], "left")
    nozzle = lambda end: F.when(F.col(f"{end}_object") != F.col(end), F.col(f"{end}_object")).otherwise(null)
    whole = F.col("connection_type") == "open_end"
    every = every.where(whole | (F.col("source").isNotNull() & F.col("target").isNotNull()))
    return every.select("drawing_id", "id", "source", "target", "relationship", "connection_type", "properties", nozzle("source").alias("source_nozzle"), nozzle("target").alias("target_nozzle"), "source_chamber", "target_chamber", F.when(whole, F.when(F.col("source").isNull(), "source").otherwise("target")).alias("open_end"), "ord")


def ingestion_matrix(objects: DataFrame, plant: Plant) -> DataFrame:
    """One row per drawing: status of each stage (parsed, normalized, connected), counts by category, tagged and not, by connection type, of links, warnings and connected parts."""
    status = objects.groupBy("drawing_id").agg(F.max("error").alias("error"), F.count_if(F.col("error").isNull()).alias("objects"))
    e = plant.entities.groupBy("drawing_id").agg(*(F.count_if(F.col("category") == c).alias(c) for c in ("equipment", "piping_component", "instrumentation", "piping_line")), F.count_if(F.col("tag").isNotNull()).alias("tagged"), F.count_if(F.col("tag").isNull()).alias("untagged"))
    kinds = ("pipe", "direct_piping_connection", "open_end", "measuring_line", "signal_line", "operated_valve_reference", "sensing_location")
    c = plant.connections.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("connections"), *(F.count_if(F.col("connection_type") == k).alias(k) for k in kinds))
    name = lambda x: F.struct("drawing_id", F.col(x).alias("node"))
    parts = graph.components(plant.entities.where("in_topology").select(name("id").alias("node")), plant.connections.where("source is not null and target is not null").select(name("source").alias("source"), name("target").alias("target")))
    parts = parts.groupBy(F.col("node.drawing_id").alias("drawing_id")).agg(F.count_distinct("component").alias("parts"))
    w = plant.warnings.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("warnings"))
    out = status
    for more in (e, c, parts, w):
        out = out.join(more, "drawing_id", "left")
    ok = lambda yes: F.when(yes, "ok").otherwise("failed")
    out = out.fillna(0).withColumns({"parsed": ok(F.col("error").isNull()), "normalized": ok(F.col("equipment") + F.col("piping_component") + F.col("instrumentation") > 0), "connected": ok(F.col("connections") > 0)})
    return out.withColumn("status", ok(F.col("parsed") == "ok"))


def graph_profile(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each drawing's objects: nodes, composition and reference edges; and a histogram of classes (drawing_id, type, n)."""
    o = objects.where("error is null")
    counts = o.groupBy("drawing_id").agg(F.count(F.lit(1)).alias("nodes"), F.count("owner_id").alias("compositions"), F.sum(F.size("associations")).alias("references"))
    return counts, o.groupBy("drawing_id", "type").agg(F.count(F.lit(1)).alias("n"))


def number_siblings(children: DataFrame) -> DataFrame:
    """drawing_id, owner_id, attr, id, ord. Adds public_id: the id, or owner/attr/n by place among its siblings."""
    n = F.row_number().over(Window.partitionBy("drawing_id", "owner_id", "attr").orderBy("ord"))
    return children.withColumn("public_id", F.coalesce("id", F.concat_ws("/", "owner_id", "attr", n.cast("string"))))
