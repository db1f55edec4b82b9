"""Scoring of answers and consistency of repeated runs, as aggregations."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import evidence, facts, submission

if TYPE_CHECKING:
    from millrace.plans.service import Service


def answer_scores(judged: DataFrame) -> DataFrame:
    """judged: question_id, kind (required or forbidden), matched, answered, failed. question_id, found, required, wrong, score, outcome.

    The score is the share of required facts, less one for each wrong statement; null for an infrastructure failure.
    """
    need = F.col("kind") == "required"
    out = judged.groupBy("question_id").agg(F.count_if(need & F.col("matched")).alias("found"), F.count_if(need).alias("required"), F.count_if(~need & F.col("matched")).alias("wrong"), F.bool_or("answered").alias("answered"), F.bool_or("failed").alias("failed"))
    raw = F.round(F.greatest(F.lit(0), F.col("found") - F.col("wrong")) / F.greatest(F.col("required"), F.lit(1)), 3)
    score = F.when(~F.col("failed"), F.when(F.col("answered"), raw).otherwise(0.0))
    return out.withColumn("score", score).withColumn("outcome", outcome()).select("question_id", "found", "required", "wrong", "score", "outcome")


def outcome():
    return F.when(F.col("failed"), "infrastructure").when(~F.col("answered"), "abstained").when(F.col("score") >= 1, "correct").when(F.col("score") > 0, "partial").otherwise("incorrect")


def histogram(scored: DataFrame) -> DataFrame:
    return scored.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def latency(runs: DataFrame, by: str, value: str) -> DataFrame:
    v = F.col(value)
    return runs.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.round(F.sum(v), 3).alias("total"), F.round(F.median(v), 6).alias("median"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.95), 6).alias("p95"), F.min(v).alias("least"), F.max(v).alias("most"))


def profiles(facts: DataFrame) -> DataFrame:
    """facts: grp, phrasing, run, fact. One row per run: its facts as a sorted, distinct list."""
    return facts.groupBy("grp", "phrasing", "run").agg(F.array_sort(F.collect_set("fact")).alias("facts"))


def repeat_consistency(profile: DataFrame) -> DataFrame:
    each = profile.groupBy("grp", "phrasing").agg(F.count(F.lit(1)).alias("runs"), F.count_distinct("facts").alias("profiles"))
    return each.withColumn("consistent", F.col("profiles") == 1)


def pair_agreement(profile: DataFrame) -> DataFrame:
    """Runs of a group in pairs: mean Jaccard index and share of equal profiles.

    Only distinct profiles are paired, and count as often as there are pairs of their runs.
    """
    own = profile.groupBy("grp", "facts").agg(F.count(F.lit(1)).alias("n"))
    a, b = own.alias("a"), own.alias("b")
    pairs = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.facts") < F.col("b.facts")))
    union = F.size(F.array_union("a.facts", "b.facts"))
    apart = pairs.select(F.col("a.grp").alias("grp"), (F.col("a.n") * F.col("b.n")).alias("k"), (F.size(F.array_intersect("a.facts", "b.facts")) / union).alias("j"), F.lit(0.0).alias("e"))
    alike = own.select("grp", (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("k"), F.lit(1.0).alias("j"), F.lit(1.0).alias("e"))
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("k")) / F.sum("k"), 6)
    return apart.unionByName(alike).where("k > 0").groupBy("grp").agg(F.sum("k").alias("pairs"), mean("j").alias("jaccard"), mean("e").alias("equal"))


def mode(values: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group, ties by first seen."""
    counted = values.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "seen"))
    return counted.withColumn("nth", nth).where("nth = 1").select(by, value, "n")


def contradictions(slots: DataFrame) -> DataFrame:
    """slots: grp, run, slot, value. Slots with several values across runs, but never within one."""
    inside = slots.groupBy("grp", "run", "slot").agg(F.count_distinct("value").alias("n")).groupBy("grp", "slot").agg(F.max("n").alias("within"))
    across = slots.groupBy("grp", "slot").agg(F.count_distinct("value").alias("values"))
    return across.where("values > 1").join(inside.where("within = 1"), ["grp", "slot"]).select("grp", "slot", "values")


def match_gold(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """facts: question_id, p, s, o, v. patterns: question_id, item, p, s, o, v, null where anything fits. question_id, item, found."""
    f = facts.alias("f")
    g = patterns.alias("g")
    fits = lambda c: F.col(f"g.{c}").isNull() | (F.col(f"g.{c}") == F.col(f"f.{c}"))
    on = (F.col("f.question_id") == F.col("g.question_id")) & (F.col("f.p") == F.col("g.p")) & fits("s") & fits("o") & fits("v")
    hit = g.join(f, on, "left_semi").select("question_id", "item").distinct().withColumn("found", F.lit(True))
    return patterns.select("question_id", "item").distinct().join(hit, ["question_id", "item"], "left").fillna({"found": False})


def causes(rows: DataFrame, cascade: list[tuple[str, str]], other: str = "other") -> DataFrame:
    """Histogram of the first condition (SQL text) that holds for each row."""
    out = F.lit(other)
    for name, condition in reversed(cascade):
        out = F.when(F.expr(condition), name).otherwise(out)
    return rows.groupBy(out.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def gold_facts(service: Service, calls: list[tuple[str, str, str | dict]]) -> DataFrame:
    """calls: (question_id, operation, arguments) as a suite gives them. question_id, fact: the canonical facts that each question's calls give, as a run's own evidence has them."""
    made = [evidence.of(service.call(tool, arguments), service, question, step).facts for step, (question, tool, arguments) in enumerate(calls, 1)]
    every = facts.union(*made) if made else service.spark.createDataFrame([], ", ".join(f"{k} {v}" for k, v in facts.COLUMNS.items()))
    return submission.facts_of_rows(every).select(F.col("run_id").alias("question_id"), F.explode("said").alias("fact")).distinct()


def grounding_counters(runs: DataFrame) -> DataFrame:
    """runs: run_id, failed, steps (array of tool, status), outputs (array of output_id, status; null if nothing was submitted), repaired (null, or whether a repair worked). One row of counts over all runs."""
    given = F.col("outputs").isNotNull()
    of = lambda status: F.sum(F.when(given, F.size(F.filter("outputs", lambda o: o["status"] == status))).otherwise(0)).alias(status)
    rejected = F.size(F.filter("steps", lambda s: (s["tool"] == "submit_answer") & (s["status"] == "rejected")))
    return runs.agg(
        F.count_if(given).alias("structured_answers"), F.count_if(~given & ~F.col("failed")).alias("withheld"), F.count_if("failed").alias("provider_failures"), F.sum(F.coalesce(F.greatest(rejected, F.lit(0)), F.lit(0))).alias("rejected_submissions"),
        F.count_if(F.col("repaired").isNotNull()).alias("repairs_attempted"), F.count_if("repaired").alias("repairs_succeeded"), F.sum(F.when(given, F.size("outputs")).otherwise(0)).alias("requested_outputs"), of("covered"), of("unknown"), of("missing"),
    )
