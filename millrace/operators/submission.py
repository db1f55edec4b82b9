"""Answers as cited rows: what each operation can answer, what is added to a composite analysis, whether all that was asked is covered;
fixed wording of results without rows, labels, transcripts, budgets of calls."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text

#: Kind of output -> operation -> semantics of routes that its result must have (null: any). Kinds that aren't here, any operation answers.
PRODUCERS: dict[str, dict[str, str | None]] = {
    "boundary": {"isolation_boundary": None},
    "signal_chain": {"trace_instrumentation": None},
    "line_structure": {"trace_line": None},
    "flow_reachability": {"traverse": "drawn_flow", "find_path": "drawn_flow"},
    "connectivity": {"find_path": None, "traverse": None, "get_connections": None, "trace_line": None, "isolation_boundary": None},
}
#: Kinds that no drawing holds, so that only an unknown answers them.
NOT_DRAWN = ("procedure_or_behaviour",)
#: Rows of a composite analysis that are taken together: operation -> (sections, predicates of derived rows).
CORE_ROWS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "isolation_boundary": ((), ("isolation_boundary_valve", "check_valve_on_boundary", "relief_device_on_boundary", "unisolated_connection", "fully_valve_bounded", "relief_path_inside_boundary")),
    "trace_instrumentation": (("connections",), ("signal_chain", "loop_measured_at", "loop_acts_on")),
    "trace_line": ((), ("line_run", "line_meets_line")),
    "find_path": (("paths", "status"), ()),
}
#: Turns, calls and repeats that one question may take.
MOST_TURNS, MOST_CALLS, MOST_REPEATS, MOST_MALFORMED = 8, 16, 2, 2


def capabilities(spark: SparkSession) -> DataFrame:
    """kind, operation, semantics (null: any): a row for each pair that can answer."""
    rows = [(kind, operation, semantics) for kind, by in PRODUCERS.items() for operation, semantics in by.items()]
    return spark.createDataFrame(rows, "kind string, operation string, semantics string")


def answers(kind: Column, operation: Column, semantics: Column) -> Column:
    """Whether a row of the operation, with such semantics, can answer an output of the kind."""
    out = F.lit(True)
    for name, by in PRODUCERS.items():
        fits = F.lit(False)
        for tool, needed in by.items():
            fits = fits | ((operation == tool) & (F.lit(needed is None) | (F.coalesce(semantics, F.lit("")) == F.lit(needed or ""))))
        out = F.when(kind == name, fits).otherwise(out)
    return F.when(kind.isin(*NOT_DRAWN), F.lit(False)).otherwise(F.coalesce(out, F.lit(False)))


def establishes(operation: Column, semantics: Column) -> Column:
    """The strict kinds that a row of the operation establishes, sorted."""
    return F.array_compact(F.array(*(F.when(answers(F.lit(kind), operation, semantics), F.lit(kind)) for kind in sorted(PRODUCERS))))


def core_rows(rows: DataFrame) -> DataFrame:
    """rows: run_id, ref, step, operation, section, predicate. The core rows of every composite analysis: run_id, step, ref."""
    core = F.lit(False)
    for operation, (sections, predicates) in CORE_ROWS.items():
        named = (F.col("section") == "derived") & F.col("predicate").isin(*predicates) if predicates else F.lit(False)
        core = core | ((F.col("operation") == operation) & (F.col("section").isin(*sections) | named if sections else named))
    return rows.where(F.coalesce(core, F.lit(False))).select("run_id", "step", "ref")


def submit(cited: DataFrame, rows: DataFrame, requested: DataFrame, unknowns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cited: run_id, ref, output_id (null: the run's only output). rows: run_id, ref, step, operation, semantics, section, predicate, text, as evidence.py gives them. requested: run_id, output_id,
    kind. unknowns: run_id, output_id, category.

    The answers' rows (run_id, output_id, ref, kind: direct or derived, text, added) and a verdict on each output and stray reference (run_id, output_id, ref, status):
    covered, unknown, wrong_operation, missing, unknown_reference, unknown_output. R<n> cites all main rows of a step. Whether a row is direct or derived is
    its section's matter; citing one row of a composite analysis adds its core rows.
    """
    outputs = requested.select("run_id", "output_id", F.col("kind").alias("asked"))
    only = outputs.groupBy("run_id").agg(F.when(F.count(F.lit(1)) == 1, F.first("output_id")).alias("only"))
    with_only = lambda df: df.join(only, "run_id", "left").withColumn("output_id", F.coalesce("output_id", "only")).drop("only")
    own = with_only(cited.select("run_id", F.trim("ref").alias("ref"), "output_id")).distinct()
    whole = F.concat(F.lit("R"), F.col("step").cast("string"))
    main = rows.where("main") if "main" in rows.columns else rows
    names = rows.select("run_id", "ref", F.col("ref").alias("row"), "step").unionByName(main.select("run_id", whole.alias("ref"), F.col("ref").alias("row"), "step")).distinct()
    hit = own.join(names, ["run_id", "ref"]).select("run_id", "output_id", F.col("row").alias("ref"), "step").distinct()
    every = names.select("run_id", "ref").unionByName(rows.select("run_id", whole.alias("ref"))).distinct()
    lost = own.join(every, ["run_id", "ref"], "left_anti").select("run_id", "output_id", "ref", F.lit("unknown_reference").alias("status"))
    more = hit.select("run_id", "output_id", "step").distinct().join(core_rows(rows), ["run_id", "step"]).select("run_id", "output_id", "ref").distinct().join(hit, ["run_id", "output_id", "ref"], "left_anti")
    taken = hit.select("run_id", "output_id", "ref", F.lit(False).alias("added")).unionByName(more.withColumn("added", F.lit(True))).join(rows, ["run_id", "ref"])
    derived = F.col("section").isin("paths", "boundaries", "derived") | ((F.col("section") == "entities") & F.col("operation").isin("traverse"))
    answer = taken.select("run_id", "output_id", "ref", F.when(derived, "derived").otherwise("direct").alias("kind"), "text", "added")

    said = taken.join(outputs, ["run_id", "output_id"]).withColumn("fits", answers(F.col("asked"), F.col("operation"), F.col("semantics")))
    by = said.groupBy("run_id", "output_id").agg(F.bool_or("fits").alias("fits"), F.count(F.lit(1)).alias("rows"))
    given_up = with_only(unknowns.select("run_id", "output_id")).distinct()
    judged = outputs.join(by, ["run_id", "output_id"], "left").join(given_up.withColumn("unknown", F.lit(True)), ["run_id", "output_id"], "left")
    status = F.when(F.coalesce("fits", F.lit(False)), "covered").when(F.coalesce("unknown", F.lit(False)), "unknown").when(F.coalesce("rows", F.lit(0)) > 0, "wrong_operation").otherwise("missing")
    null = F.lit(None).cast("string")
    stray = own.select("run_id", "output_id").unionByName(given_up).where("output_id is not null").distinct().join(outputs, ["run_id", "output_id"], "left_anti")
    verdict = judged.select("run_id", "output_id", null.alias("ref"), status.alias("status")).unionByName(lost).unionByName(stray.select("run_id", "output_id", null.alias("ref"), F.lit("unknown_output").alias("status")))
    return answer, verdict


def shown(names: DataFrame, questions: DataFrame, known: DataFrame) -> DataFrame:
    """names: id, name. questions: id, text. known: k, spelling. id, name, shown: how a status may print the name: as the graph spells it, else as whole words of the question, else null."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    edges = r"^[.,;:!?\"'()\[\]{}]+|[.,;:!?\"'()\[\]{}]+$"
    words = lambda c: F.filter(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.regexp_replace(w, edges, "")), lambda w: w != "")
    own = names.select("id", "name").where("length(name) >= 2").withColumn("k", fold(F.col("name"))).join(known, "k", "left").join(questions.select("id", words(F.col("text")).alias("asked")), "id", "left")
    want = F.transform(words(F.col("name")), F.lower)
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("asked") - F.size(want) + 1, F.lit(1))), lambda i: F.transform(F.slice("asked", i, F.size(want)), F.lower) == want)
    quoted = F.when((F.size(want) > 0) & (F.size(at) > 0), F.array_join(F.slice("asked", F.get(at, F.lit(0)), F.size(want)), " "))
    return names.join(own.select("id", "name", F.coalesce("spelling", quoted).alias("shown")), ["id", "name"], "left")


def status_text(results: DataFrame) -> DataFrame:
    """results: id, tool, status, item (a name that may be shown, or null), direction, truncated, limited, max_depth, candidates. Adds said: what a result without rows says, null if it has rows.

    A search that was cut off or limited never says that there is nothing.
    """
    item = F.coalesce("item", F.lit("the item asked for"))
    quoted = F.coalesce(F.concat(F.lit(" "), "item"), F.lit(""))
    way = F.when(F.col("direction") == "downstream", "downstream of ").when(F.col("direction") == "upstream", "upstream of ").otherwise("connected to ")
    nothing = (
        F.when(F.col("truncated"), F.concat(F.lit("Within "), F.col("max_depth").cast("string"), F.lit(" pipes nothing is "), way, item, F.lit("; what lies beyond was not searched.")))
        .when(F.col("limited"), F.concat(F.lit("The limited search found nothing "), way, item, F.lit("; that does not show that nothing is there.")))
        .otherwise(F.concat(F.lit("Nothing is "), way, item, F.lit("; all drawn piping that way was searched.")))
    )
    said = (
        F.when(~F.col("status").isin("not_found", "ambiguous", "empty", "error"), F.lit(None).cast("string"))
        .when(F.col("status") == "error", "A call was not valid.")
        .when(F.col("status") == "ambiguous", F.concat(F.lit("The name"), quoted, F.lit(" stands for several items, none of which was taken"), F.when(F.size("candidates") > 0, F.concat(F.lit(": "), F.array_join("candidates", ", "))).otherwise(""), F.lit(".")))
        .when(F.col("tool") == "find_path", F.concat(F.lit("No route "), F.coalesce(F.concat("direction", F.lit(" ")), F.lit("")), F.lit("is drawn for "), item, F.lit(".")))
        .when(F.col("tool") == "find_entities", F.concat(F.lit("Nothing in the drawing is called"), F.coalesce(quoted, F.lit(" so")), F.lit(".")))
        .when(F.col("tool") == "list_entities", F.concat(F.lit("The drawing has nothing of the type"), quoted, F.lit(" as asked for.")))
        .when(F.col("tool") == "get_properties", F.when(F.col("status") == "not_found", "None of the ids is in the drawing.").otherwise("The drawing does not give these properties."))
        .when(F.col("tool") == "trace_line", F.concat(F.lit("There is no line"), quoted, F.lit(" in the drawing.")))
        .when(F.col("status") == "not_found", F.concat(item, F.lit(" is not in the drawing.")))
        .when(F.col("tool") == "get_connections", F.concat(item, F.lit(" has no such connections.")))
        .when(F.col("tool") == "traverse", nothing)
        .when(F.col("tool") == "isolation_boundary", F.concat(item, F.lit(" has no piping, so nothing bounds it.")))
        .when(F.col("tool") == "trace_instrumentation", F.concat(item, F.lit(" has no instrument links.")))
        .otherwise("The call returned nothing.")
    )
    return results.withColumn("said", said)


def label(name: Column, own: Column) -> Column:
    """name (id), or the id alone where it is the name."""
    return F.when(name.isNull() | (name == own), own).otherwise(F.concat(name, F.lit(" ("), own, F.lit(")")))


def pipe_label(line: Column, size: Column) -> Column:
    """line n, size: without what is null."""
    return F.concat_ws(", ", F.concat(F.lit("line "), line), size)


def call_key(tool: str, arguments: dict | None) -> str:
    """The same for calls that differ only in the order of arguments and in those that are null."""
    return f"{tool}:{json.dumps({k: v for k, v in (arguments or {}).items() if v is not None}, sort_keys=True, default=str)}"


def stops_for(turns: int, calls: int, repeats: int, malformed: int) -> str | None:
    """Why a run has to come to an end, if it has."""
    for spent, most, what in ((repeats, MOST_REPEATS, "the same call again"), (malformed, MOST_MALFORMED, "calls that can't be read"), (calls, MOST_CALLS, "as many calls as are allowed"), (turns, MOST_TURNS, "as many turns as are allowed")):
        if spent >= most:
            return what
    return None


def reused(found: DataFrame) -> DataFrame:
    """found: run_id, step, tool, status, n, entity_id. Lookups that give one entity that an earlier step gave: run_id, step, entity_id, known_since."""
    first = F.min("step").over(Window.partitionBy("run_id", "entity_id"))
    return found.withColumn("known_since", first).where("tool = 'find_entities' and status = 'success' and n = 1 and known_since < step").select("run_id", "step", "entity_id", "known_since")


def transcript(steps: DataFrame) -> DataFrame:
    """steps: run_id, step, title, body. run_id, record: all steps of a run, in order, as one text."""
    line = F.concat(F.lit("## "), F.col("step").cast("string"), F.lit(". "), "title", F.lit("\n"), F.coalesce("body", F.lit("")))
    return steps.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("record"))


def usage(calls: DataFrame) -> DataFrame:
    """calls: run_id, prompt_tokens, completion_tokens, total_tokens. Counters of each run."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.groupBy("run_id").agg(F.count(F.lit(1)).alias("llm_calls"), total("prompt_tokens"), total("completion_tokens"), total("total_tokens"))


def head(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first `most` rows of each group, and how many more there are."""
    own = Window.partitionBy(by)
    nth = F.row_number().over(own.orderBy(order))
    return rows.withColumns({"nth": nth, "left_out": F.greatest(F.lit(0), F.count(F.lit(1)).over(own) - most)}).where(F.col("nth") <= most)


def anchors_missing(anchors: DataFrame, results: DataFrame) -> DataFrame:
    """anchors: question_id, item. results: question_id, item (what any result names). Items that a question names and no result does."""
    return anchors.select("question_id", "item").distinct().join(results.select("question_id", "item").distinct(), ["question_id", "item"], "left_anti")


def facts_of_rows(facts: DataFrame) -> DataFrame:
    """facts with run_id and ref. run_id, ref, said: the canonical facts of each row, sorted."""
    q = F.transform_values(F.coalesce("qualifiers", F.expr("cast(map() as map<string,array<string>>)")), lambda k, v: F.array_join(v, "|"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    said = text.fact_key(F.col("predicate"), F.col("subject"), blank("object"), blank("value"), q)
    return facts.where("ref is not null").groupBy("run_id", "ref").agg(F.sort_array(F.collect_set(said)).alias("said"))


#: Columns of a result's sections that a reader needs: operation -> section -> columns.
COMPACT: dict[str, dict[str, tuple[str, ...]]] = {
    "find_entities": {"entities": ("id", "name", "type", "tag", "tier", "confidence", "ambiguous")},
    "list_entities": {"entities": ("id", "name", "type", "tag"), "attributes": ("entity_id", "property", "value", "scope"), "types": ("type", "n"), "categories": ("category", "n")},
    "get_entity": {"entities": ("id", "name", "type", "tag", "category", "properties", "piping_context"), "sub_objects": ("id", "type")},
    "get_connections": {"entities": ("id", "name", "type"), "connections": ("id", "side", "other", "other_name", "other_type", "other_category", "relationship", "connection_type")},
    "traverse": {"entities": ("id", "name", "type", "distance", "via", "terminal", "through_equipment"), "boundaries": ("node", "entered", "blocked"), "endpoints": ("id", "name", "kind"), "frontier": ("node",), "open_ends": ("node", "id")},
    "find_path": {"paths": ("nth", "length", "nodes", "shut_off_valves", "check_valves", "relief_devices", "equipment", "pipes_against_flow", "one_way_devices_against_flow", "more")},
    "get_properties": {"properties": ("entity_id", "name", "status", "property", "value", "scope"), "errors": ("asked", "error")},
    "isolation_boundary": {"derived": ("predicate", "object", "value", "side", "line", "size"), "summary": ("region_size", "valves", "checks", "unisolated", "relieving")},
    "trace_instrumentation": {"derived": ("predicate", "subject", "object", "elements", "fail_action"), "members": ("node",)},
    "trace_line": {"derived": ("predicate", "subject", "object", "value", "elements", "sizes", "ends_at")},
}


def compact(sections: dict[str, DataFrame], tool: str) -> dict[str, DataFrame]:
    """A result's sections with the columns that a reader needs; routes as their nodes instead of their steps, and no sections that only further calls need."""
    out = {}
    for section, columns in COMPACT[tool].items():
        if (rows := sections.get(section)) is not None:
            if "nodes" in columns and "path" in rows.columns:
                rows = rows.withColumn("nodes", F.concat(F.array(F.get("path", F.lit(0))["from"]), F.transform("path", lambda s: s["to"])))
            out[section] = rows.select(*(c for c in columns if c in rows.columns))
    return out
