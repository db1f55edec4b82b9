"""Operators on properties in long form: entity_id, property, value, scope, ord."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text

#: A wanted name shorter than this matches whole names only.
PARTIAL = 4


def report(properties: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: entity_id, name. One row per property found, or one with status missing: entity_id, name, status, property, value, scope, and source_object_id (what the property is of, the entity itself where properties don't say).

    A normalized name that is equal beats names that contain the wanted one or all of its words.
    """
    norm = text.normalize_identifier
    own = properties.withColumns({"norm": norm(F.col("property")), "tokens": text.camel_tokens(F.col("property"))})
    want = wanted.select("entity_id", "name").distinct().withColumns({"want": norm(F.col("name")), "words": text.camel_tokens(F.col("name"))})
    rank = F.when(F.col("norm") == F.col("want"), 1).when((F.length("want") >= PARTIAL) & (F.contains("norm", "want") | (F.size(F.array_except("words", "tokens")) == 0)), 2)
    hits = want.join(own, "entity_id").withColumn("rank", rank).where("rank is not null")
    least = Window.partitionBy("entity_id", "name")
    hits = hits.withColumn("least", F.min("rank").over(least)).where("rank = least")
    source = F.coalesce("source_object_id", "entity_id") if "source_object_id" in properties.columns else F.col("entity_id")
    found = hits.select("entity_id", "name", F.lit("found").alias("status"), "property", "value", "scope", source.alias("source_object_id"))
    null = F.lit(None).cast("string")
    missing = want.join(hits.select("entity_id", "name").distinct(), ["entity_id", "name"], "left_anti").select("entity_id", "name", F.lit("missing").alias("status"), null.alias("property"), null.alias("value"), null.alias("scope"), F.col("entity_id").alias("source_object_id"))
    return found.unionByName(missing)


def having(properties: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """entity_id of entities that have every wanted (property, value), by same_value: one pass, no join per condition."""
    norm = text.normalize_identifier(F.col("property"))
    hits = [F.bool_or((norm == F.lit("".join(c for c in name.lower() if c.isascii() and c.isalnum()))) & text.same_value(F.col("value"), F.lit(value))).alias(f"w{k}") for k, (name, value) in enumerate(wanted)]
    out = properties.groupBy("entity_id").agg(*hits)
    for k in range(len(wanted)):
        out = out.where(F.col(f"w{k}"))
    return out.select("entity_id")


def catalogue(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
