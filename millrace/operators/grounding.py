"""Checks of texts against a corpus, references of rows, absences, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text

#: Order of sections in a result's row numbers.
SECTIONS = ("entities", "connections", "paths", "properties", "missing", "boundaries", "derived")
SHOWN_ROWS, SHOWN_FACTS = 40, 12


def number_rows(rows: DataFrame) -> DataFrame:
    """rows: (run_id,) step, section, ord. Adds ref, E<step>.<n>, over the fixed order of sections, for each run apart."""
    rank = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    n = F.row_number().over(Window.partitionBy(*(c for c in ("run_id", "step") if c in rows.columns)).orderBy(rank, "ord"))
    return rows.withColumn("ref", F.concat(F.lit("E"), F.col("step").cast("string"), F.lit("."), n.cast("string")))


def absence_facts(flags: DataFrame, reached: DataFrame, limited: bool) -> DataFrame:
    """Nothing reached is a fact only if the search was complete: no depth cut, no stop, no unknown type."""
    none = flags.join(reached.select("query_id").distinct(), "query_id", "left_anti")
    p = F.when(F.col("truncated") | F.lit(limited), "found_nothing_within_search_limits").otherwise("reaches_nothing")
    return none.select(p.alias("predicate"), F.col("start").alias("subject"))


def terms_of(c: Column) -> Column:
    """Identifier-like words of a text that hold a digit, in comparison form."""
    words = text.identifier_tokens(c)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w.rlike("[0-9]")), text.key))


def check_terms(answers: DataFrame, corpus: DataFrame, questions: DataFrame, terms=terms_of) -> DataFrame:
    """answers: id, text. corpus and questions: id, text. id, term, status: supported by the corpus, by the question only, or unsupported."""
    spread = lambda df: df.select("id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    have, asked = spread(corpus).withColumn("have", F.lit(True)), spread(questions).withColumn("asked", F.lit(True))
    out = spread(answers).join(have, ["id", "term"], "left").join(asked, ["id", "term"], "left")
    return out.select("id", "term", F.when(F.col("have"), "supported").when(F.col("asked"), "question_only").otherwise("unsupported").alias("status"))


def grounding_level(checked: DataFrame) -> DataFrame:
    n = checked.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("status") == "unsupported").alias("unsupported"), F.count_if(F.col("status") == "question_only").alias("question_only"))
    return n.withColumn("level", F.when(F.col("unsupported") > 0, "insufficient_evidence").when(F.col("question_only") > 0, "limited").otherwise("grounded"))


def evidence_rows(rows: DataFrame, most: int = SHOWN_ROWS) -> DataFrame:
    """rows: kind, id, statement, ord. Distinct by (kind, id) in order, the first `most`, and how many are left out."""
    first = F.row_number().over(Window.partitionBy("kind", "id").orderBy("ord"))
    once = rows.withColumn("k", first).where("k = 1").drop("k")
    total = once.count()
    shown = once.orderBy("ord").limit(most)
    return shown.withColumn("n", F.row_number().over(Window.orderBy("ord"))).withColumns({"total": F.lit(total), "left_out": F.lit(max(0, total - most))})


def leaks(answers: DataFrame, prompt: str, width: int = 80) -> DataFrame:
    """answers: id, text. Ids whose text repeats `width` characters of the prompt: windows of both are joined, not compared one with all."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    windows = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.xxhash64(F.substring(c, i, F.lit(width))))
    own = answers.select("id", plain(F.col("text")).alias("t")).where(F.length("t") >= width).select("id", F.explode(windows(F.col("t"))).alias("h"))
    secret = answers.sparkSession.createDataFrame([(" ".join(prompt.lower().split()),)], "t string").where(F.length("t") >= width).select(F.explode(windows(F.col("t"))).alias("h"))
    return own.join(F.broadcast(secret.distinct()), "h", "left_semi").select("id").distinct()
