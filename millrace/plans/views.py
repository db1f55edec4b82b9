"""Graph views of plain tables: (entities, connections) pairs that every graph operator takes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.storage import keep
from millrace.sources.drawings import ANCESTORS, Plant


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(c) -> F.Column:
    return F.lpad(c.cast("string"), 2, "0")


#: Trade graphs of this session, by application and folder: every graph query reads one.
_TRADE: dict[tuple[str, str], DataFrame] = {}


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph, made once for each session and folder."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _TRADE:
        _TRADE[at] = _trade(spark, sf_dir)
    return _TRADE[at]


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s, c, n: lines that suppliers of nation s sell to customers of another nation c."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("s"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("c"))
    # Nations are found before anything is summed: sums by order hold nearly as many rows as there are lines, sums by two nations a few hundred.
    made = lines.join(supplier, "l_suppkey").select("l_orderkey", "s")
    bought = orders.join(customer, "o_custkey").select("l_orderkey", "c")
    return made.join(bought, "l_orderkey").where("s <> c").groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"))


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connections between nations: from each supplier nation to the two customer nations that buy most lines of it, ties by key.

    Chambers follow from the keys: a nation whose key is a multiple of three has two, entered and left by the parity of the other end.
    """
    pairs = sold(spark, sf_dir)
    nth = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("n"), "c"))
    top = pairs.withColumn("nth", nth).where("nth <= 2")
    chamber = lambda own, other: F.when(F.col(own) % 3 == 0, F.concat(F.lit("C"), (F.col(other) % 2).cast("string")))
    # Written once: iterative operators read the edges at every level. At most two rows per nation.
    return keep(top.select(
        F.concat(F.lit("T"), node(F.col("s")), F.lit("-"), F.col("nth").cast("string")).alias("id"), node(F.col("s")).alias("source"), node(F.col("c")).alias("target"),
        chamber("s", "c").alias("source_chamber"), chamber("c", "s").alias("target_chamber"), F.lit("piping").alias("relationship"), (F.col("s") * 10 + F.col("nth")).cast("long").alias("ord"), F.col("n").cast("long").alias("n"),
    ), "trade")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the trade graph; the role follows from the key as a drawing's from the class."""
    n = table(spark, sf_dir, "nation")
    role = F.element_at(F.array(*map(F.lit, ["equipment", "fitting", "isolation_valve", "fitting", "check_valve", "fitting", "relief_device"])), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return n.select(node(F.col("n_nationkey")).alias("id"), F.col("n_name").alias("tag"), F.col("n_regionkey").alias("region"), role.alias("role"), F.col("n_nationkey").cast("long").alias("ord"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: region, nation, customer and supplier keys as names."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    customer = table(spark, sf_dir, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    supplier = table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("parent"), name("s", "s_suppkey").alias("child"))
    return nation.unionByName(customer).unionByName(supplier)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines: line, pos (components in order of all their columns), item, size."""
    own = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    return own.select(F.col("l_orderkey").alias("line"), pos.alias("pos"), F.col("l_partkey").alias("item"), F.concat(F.lit("DN "), F.col("l_quantity").cast("int").cast("string")).alias("size"))


def plant(spark: SparkSession, sf_dir: str) -> Plant:
    """The trade graph as a drawing named trade: nations are its items, with a class that follows from the role, and two instruments act on nation 4."""
    n = nations(spark, sf_dir)
    kinds = {"equipment": ("Tank", "equipment"), "fitting": ("PipeTee", "piping_component"), "isolation_valve": ("GlobeValve", "piping_component"), "check_valve": ("SwingCheckValve", "piping_component"), "relief_device": ("RuptureDisc", "piping_component")}
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for role, v in kinds.items() for x in (role, v[k]))), F.col("role"))
    above = F.create_map(*(x for name, _ in kinds.values() for x in (F.lit(name), F.array(*map(F.lit, [name, *ANCESTORS[name]])))))
    null, empty = F.lit(None).cast("string"), F.expr("cast(map() as map<string,string>)")
    columns = lambda df, **c: df.select(F.lit("trade").alias("drawing_id"), *(v.alias(k) for k, v in c.items()))
    items = columns(n, id=F.col("id"), type=pick(0), type_hierarchy=F.element_at(above, pick(0)), category=pick(1), tag=F.col("tag"), name=F.col("tag"), properties=F.create_map(F.lit("region"), F.col("region").cast("string")), piping_context=F.lit(None).cast("map<string,string>"), line_id=null, segment_id=null, line_number=null, in_topology=F.lit(True), ord=F.col("ord"))
    more = spark.createDataFrame([("I0", "ProcessInstrumentationFunction", 100), ("I1", "ProcessInstrumentationFunction", 101)], "id string, type string, ord long")
    more = columns(more, id=F.col("id"), type=F.col("type"), type_hierarchy=F.array("type"), category=F.lit("instrumentation"), tag=null, name=F.col("id"), properties=empty, piping_context=F.lit(None).cast("map<string,string>"), line_id=null, segment_id=null, line_number=null, in_topology=F.lit(True), ord=F.col("ord"))
    entities = items.unionByName(more)
    bag = F.create_map(F.lit("lineNumber"), (F.col("ord") % 3).cast("string"))
    end = {"source_nozzle": null, "target_nozzle": null, "open_end": null}
    pipes = columns(trade(spark, sf_dir), id=F.col("id"), source=F.col("source"), target=F.col("target"), relationship=F.lit("piping"), connection_type=F.lit("pipe"), properties=bag, source_chamber=F.col("source_chamber"), target_chamber=F.col("target_chamber"), ord=F.col("ord"), **end)
    links = spark.createDataFrame([("S0", "I0", "I1", "signal_line", 1000), ("O0", "I1", "04", "operated_valve_reference", 1001)], "id string, source string, target string, kind string, ord long")
    links = columns(links, id=F.col("id"), source=F.col("source"), target=F.col("target"), relationship=F.lit("instrumentation"), connection_type=F.col("kind"), properties=empty, source_chamber=null, target_chamber=null, ord=F.col("ord"), **end)
    connections = pipes.unionByName(links)
    identifiers = columns(entities.where("tag is not null"), entity_id=F.col("id"), field=F.lit("tagName"), value=F.col("tag"), kind=F.lit("identifier"), origin=F.lit("source"))
    bags = lambda df, scope: columns(df.select("id", F.explode("properties").alias("property", "value")), entity_id=F.col("id"), property=F.col("property"), value=F.col("value"), scope=F.lit(scope), source_object_id=F.col("id"))
    none = lambda ddl: spark.createDataFrame([], f"drawing_id string, {ddl}")
    return Plant(entities, none("owner_id string, id string, type string, tag string, properties map<string,string>, ord long"), identifiers, connections, bags(entities, "own").unionByName(bags(connections, "connection")), none("warning string"), none("id string, type string, owner_entity_id string"))


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events in order of time: user_id, event_id, pos (from 1), n (of the user's events), name."""
    own = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return e.select("user_id", "event_id", F.row_number().over(own.orderBy("ts", "event_id")).alias("pos"), F.count(F.lit(1)).over(own).alias("n"), F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("name"))


def signals(spark: SparkSession, sf_dir: str) -> Plant:
    """All users' events as a drawing named signals: each event is an instrument function that sends its signal to the user's next one; the last one operates the user's valve."""
    e = keep(histories(spark, sf_dir), "histories")
    valve = F.concat(F.lit("V-"), F.col("user_id").cast("string"))
    null, bag = F.lit(None).cast("string"), F.expr("cast(map() as map<string,string>)")
    item = lambda df, own, kind, above, category: df.select(F.lit("signals").alias("drawing_id"), own.alias("id"), F.lit(kind).alias("type"), F.array(*map(F.lit, (kind, *above))).alias("type_hierarchy"), F.lit(category).alias("category"), own.alias("tag"), own.alias("name"), bag.alias("properties"), F.lit(None).cast("map<string,string>").alias("piping_context"), null.alias("line_id"), null.alias("segment_id"), null.alias("line_number"), F.lit(True).alias("in_topology"), F.col("event_id").cast("long").alias("ord"))
    last = e.where("pos = n")
    entities = item(e, F.col("name"), "ProcessInstrumentationFunction", (), "instrumentation").unionByName(item(last, valve, "GlobeValve", ANCESTORS["GlobeValve"], "piping_component"))
    following = F.lead("name").over(Window.partitionBy("user_id").orderBy("pos"))
    links = e.select("event_id", F.col("name").alias("source"), F.coalesce(following, valve).alias("target"), F.when(following.isNull(), "operated_valve_reference").otherwise("signal_line").alias("connection_type"))
    links = links.select(F.lit("signals").alias("drawing_id"), F.concat(F.lit("S-"), F.col("event_id").cast("string")).alias("id"), "source", "target", F.lit("instrumentation").alias("relationship"), "connection_type", bag.alias("properties"), null.alias("source_chamber"), null.alias("target_chamber"), F.col("event_id").cast("long").alias("ord"), null.alias("source_nozzle"), null.alias("target_nozzle"), null.alias("open_end"))
    none = lambda ddl: spark.createDataFrame([], f"drawing_id string, {ddl}")
    entities, links = keep(entities, "entities"), keep(links, "signals")
    named = entities.select("drawing_id", F.col("id").alias("entity_id"), F.lit("tagName").alias("field"), F.col("tag").alias("value"), F.lit("identifier").alias("kind"), F.lit("source").alias("origin"))
    bags = none("entity_id string, property string, value string, scope string, source_object_id string")
    return Plant(entities, none("owner_id string, id string, type string, tag string, properties map<string,string>, ord long"), named, links, bags, none("warning string"), none("id string, type string, owner_entity_id string"))


def order_chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A graph that grows with the tables: every order, with a pipe to its customer's next one. Its edges, and its items (node, customer, pos, role: urgent orders are valves)."""
    o = table(spark, sf_dir, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    role = F.when(F.col("o_orderpriority").startswith("1"), "isolation_valve").otherwise("fitting")
    items = keep(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"), F.col("o_custkey").alias("customer"), pos.alias("pos"), F.col("o_orderkey").cast("long").alias("ord"), role.alias("role")), "orders")
    null = F.lit(None).cast("string")
    following = F.lead("node").over(Window.partitionBy("customer").orderBy("pos"))
    edges = items.select(F.concat(F.lit("L"), F.col("node")).alias("id"), F.col("node").alias("source"), following.alias("target"), null.alias("source_chamber"), null.alias("target_chamber"), F.lit("piping").alias("relationship"), "ord")
    return keep(edges.where("target is not null"), "chains"), items
