"""Question suites, runs and reports: JSON in, JSON, Parquet and Markdown out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text

FACT = "struct<fact:string,any_of:array<string>,evidence:array<string>>"
#: Arguments of gold calls differ by operation, so they stay JSON text.
SUITE = f"description string, pid string, questions array<struct<id:string,category:string,question:string,required:array<{FACT}>,forbidden:array<{FACT}>,gold_calls:array<struct<tool:string,args:string>>>>"


def read_questions(spark: SparkSession, *paths: str) -> DataFrame:
    """One row per question: pid, question_id, category, question, required, forbidden."""
    suites = spark.read.schema(SUITE).json(list(paths), multiLine=True)
    return suites.select("pid", F.explode("questions").alias("q")).select("pid", F.col("q.id").alias("question_id"), "q.category", "q.question", "q.required", "q.forbidden")


def read_gold_calls(spark: SparkSession, *paths: str) -> DataFrame:
    """question_id, step, tool, args (JSON): the calls whose facts a question is judged by, as evaluate.gold_facts() takes them."""
    suites = spark.read.schema(SUITE).json(list(paths), multiLine=True)
    each = suites.select(F.explode("questions").alias("q")).select(F.col("q.id").alias("question_id"), F.posexplode("q.gold_calls").alias("step", "call"))
    return each.select("question_id", (F.col("step") + 1).alias("step"), "call.tool", "call.args")


def patterns(questions: DataFrame) -> DataFrame:
    """question_id, kind, item, pattern: one row per alternative. Plain text is quoted; texts that begin with re: are regular expressions."""
    sides = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("facts")) for k in ("required", "forbidden")))
    each = questions.select("question_id", F.explode(sides).alias("s")).select("question_id", "s.kind", F.posexplode("s.facts").alias("item", "f")).select("question_id", "kind", "item", F.explode("f.any_of").alias("want"))
    # White space and hyphens between the words of a plain text may be written in any way, or not at all.
    words = F.filter(F.split(F.lower(text.fold_typography(F.regexp_replace("want", "[*_`]", ""))), r"[\s\-]+"), lambda w: w != "")
    quoted = F.concat(F.lit("(?<![a-z0-9])"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), r"[\s\-]*"), F.lit("(?![a-z0-9])"))
    return each.select("question_id", "kind", "item", F.when(F.col("want").startswith("re:"), F.concat(F.lit("(?i)"), F.expr("substring(want, 4)"))).otherwise(quoted).alias("pattern"))


def judge(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """answers: question_id, answer, failed. The rows that answer_scores() takes: a fact is matched if any of its patterns is found in the answer."""
    said = answers.withColumn("plain", F.regexp_replace(F.regexp_replace(F.lower(text.fold_typography(F.col("answer"))), r"[*_`]", ""), r"\s+", " "))
    hits = patterns(questions).join(said, "question_id")
    found = F.coalesce(F.regexp_like("plain", F.col("pattern")), F.lit(False))
    return hits.groupBy("question_id", "kind", "item").agg(F.bool_or(found).alias("matched"), F.bool_or(F.coalesce(F.length("answer") > 0, F.lit(False))).alias("answered"), F.bool_or("failed").alias("failed"))


def unanswered(questions: DataFrame, run: DataFrame) -> DataFrame:
    """What a resumed run still has to ask: questions without an answer that isn't an infrastructure failure."""
    return questions.join(run.where("not failed").select("question_id").distinct(), "question_id", "left_anti")


def header(spark: SparkSession, *paths: str) -> DataFrame:
    """path, application, version, originating_system of each drawing, from the first 4000 bytes."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.expr("decode(substring(content, 1, 4000), 'UTF-8')").alias("head"))
    attribute = lambda name: F.nullif(F.regexp_extract("head", rf'\b{name}="([^"]*)"', 1), F.lit(""))
    return files.select("path", attribute("Application").alias("application"), attribute("ApplicationVersion").alias("version"), attribute("OriginatingSystem").alias("originating_system"))


def write_markdown(table: DataFrame, path: str) -> None:
    """A small report (one row per drawing or question) as a Markdown table, in one file."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in table.columns)), F.lit(" |"))
    top = f"| {' | '.join(table.columns)} |\n|{' --- |' * len(table.columns)}"
    body = table.orderBy(table.columns[0]).select(F.lit(1).alias("k"), F.monotonically_increasing_id().alias("n"), cells.alias("value"))
    head = table.sparkSession.createDataFrame([(0, 0, top)], "k int, n long, value string")
    head.unionByName(body).coalesce(1).sortWithinPartitions("k", "n").select("value").write.text(path)


def write_run(results: DataFrame, path: str) -> None:
    """Results of a run (question_id, answer, failed and whatever else) as JSON lines, and read_run() for a run that is taken up again."""
    results.write.mode("overwrite").json(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question_id string, answer string, failed boolean").json(path)
