"""Constraints of a catalog: all rules of a table in one scan of it, all references to a table in one join with it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Databases of the system, whose tables don't belong into a catalog.
SYSTEM_DATABASES = ("DBC", "SYSLIB", "SystemFe")
# Tables of a catalog and the columns that each must have.
EXPECTED = {
    "OL_NAMESPACE": "namespace_id namespace_uri description spec_version created_at", "OL_DATASET": "dataset_id namespace_id name description source_type",
    "OL_DATASET_FIELD": "field_id dataset_id field_name field_type nullable",
    "OL_COLUMN_PROVENANCE": "provenance_id source_dataset source_field target_dataset target_field transformation_type confidence_score is_active",
    "OL_JOB": "job_id namespace_id name description job_type", "OL_RUN": "run_id job_id event_type event_time", "OL_RUN_INPUT": "run_id dataset_id", "OL_RUN_OUTPUT": "run_id dataset_id",
    "OL_SCHEMA_VERSION": "version_id openlineage_spec_version schema_version",
}


def outside(name: Column, databases: tuple[str, ...] | list[str] = SYSTEM_DATABASES) -> Column:
    """Whether a database.table lies in none of the databases; whole names, in the case of letters that is given."""
    return ~F.substring_index(name, ".", 1).isin(*databases)


def domain_report(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, checked, violated: how many rows of ``table`` each rule is not true for (null is not true).

    A row's rules become bits of one number. Rows are counted by it, of which there are as few as ways to break the rules
    together, so one scan and one small shuffle serve all rules (63 at most).
    """
    mask = reduce(Column.bitwiseOR, [F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1 << k).cast("long") for k, rule in enumerate(rules.values())])
    counts = table.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    bits = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, name in enumerate(rules)])
    each = counts.select("n", "mask", F.explode(bits).alias("b"))
    found = each.groupBy("b.rule").agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("mask").bitwiseAND(F.col("b.bit")) != 0, F.col("n")).otherwise(0)).alias("violated"))
    # A table without rows breaks no rule.
    names = table.sparkSession.createDataFrame([(name,) for name in rules], "rule string")
    return names.join(found, "rule", "left").select("rule", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("violated", F.lit(0)).alias("violated"))


def reference_report(table: DataFrame, rules: dict[str, Column], known: DataFrame, key: str) -> DataFrame:
    """rule, checked, violated: how many rows of ``table`` have a value, for each rule's column, that the ``key`` of ``known`` lacks. All
    columns that refer to one table are counted by value first and meet it in one join; null values refer to nothing."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), column.cast("string").alias("value")) for name, column in rules.items()])
    values = table.select(F.explode(each).alias("r")).filter("r.value is not null").groupBy("r.rule", "r.value").agg(F.count(F.lit(1)).alias("n"))
    have = known.select(F.col(key).cast("string").alias("value"), F.lit(True).alias("have")).distinct()
    found = values.join(have, "value", "left").groupBy("rule").agg(F.sum("n").alias("checked"), F.sum(F.when(F.col("have").isNull(), F.col("n")).otherwise(0)).alias("violated"))
    names = table.sparkSession.createDataFrame([(name,) for name in rules], "rule string")
    return names.join(found, "rule", "left").select("rule", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("violated", F.lit(0)).alias("violated"))


def presence_report(spark: SparkSession, tables: dict[str, DataFrame], expected: dict[str, str] = EXPECTED) -> DataFrame:
    """rule, checked, violated: for each expected table, how many columns it must have and how many it lacks (all, if there is no table).
    Names in any case of letters; only schemas are read."""
    rows = []
    for name, columns in expected.items():
        have = {c.lower() for c in tables[name].columns} if name in tables else set()
        rows.append((f"columns of {name}", len(columns.split()), sum(c not in have for c in columns.split())))
    return spark.createDataFrame(rows, "rule string, checked long, violated long")
