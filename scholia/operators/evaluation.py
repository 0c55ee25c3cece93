"""Evaluation: cases with expectations, their coverage, and what was observed against what was expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metadata of a case; other fields of its file are ignored.
CASE = "name string, kind string, modes array<string>, accepted_categories array<string>, minimum_severity string, level int, capability string, target_identifier string, family string, notes string"


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 2).when(severity == "warning", 1).otherwise(0)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a folder tree: each ``x.json`` with the text of ``x.tex`` beside it.

    Raises if there are none, if a case has no text, or if a name comes twice.
    """

    def stems(pattern: str) -> DataFrame:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
        return raw.select(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem"), F.decode("content", "UTF-8").alias("text"))

    meta = stems("*.json").select("stem", F.from_json("text", CASE).alias("case")).where("case.name is not null")
    held = meta.join(stems("*.tex").withColumnRenamed("text", "raw"), "stem", "left").select("stem", "case.*", "raw")
    names = held.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").isNull()).alias("bare")).agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("n") > 1).alias("twice"), F.sum("bare").alias("bare")).first()
    if not names["cases"] or names["twice"] or names["bare"]:
        raise ValueError(f"{names['cases']} cases, {names['twice']} names more than once, {names['bare'] or 0} without a text")
    return held


def load_expectations(spark: SparkSession, path: str) -> DataFrame:
    """(name, rules) from a JSON file that maps each case to its expected rules."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return text.select(F.explode("m").alias("name", "rules"))


def coverage(observed: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, difference) of names on one side only; none if both name the same."""
    seen, wanted = observed.select(key).distinct(), expected.select(key).distinct()
    extra = seen.exceptAll(wanted).withColumn("difference", F.lit("not expected"))
    return extra.unionByName(wanted.exceptAll(seen).withColumn("difference", F.lit("not observed")))


def evaluate(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases (project_id, accepted rules, minimum severity) with passed: a finding matches, or none is expected and none is there."""
    held = cases.join(findings.select("project_id", "rule", "severity"), "project_id", "left")
    hit = F.array_contains("accepted", F.col("rule")) & (severity_rank(F.col("severity")) >= severity_rank(F.col("minimum")))
    grouped = held.groupBy("project_id", "accepted").agg(F.count_if(hit).alias("matched"), F.count("rule").alias("observed"))
    return grouped.select("project_id", "matched", "observed", F.when(F.size("accepted") == 0, F.col("observed") == 0).otherwise(F.col("matched") > 0).alias("passed"))


def evaluate_exactly(findings: DataFrame, expected: DataFrame) -> DataFrame:
    """(project_id, rules, observed, passed): whether a case's findings are exactly the expected rules, each as often as expected."""
    found = findings.groupBy("project_id").agg(F.array_sort(F.collect_list("rule")).alias("observed"))
    held = expected.join(found, "project_id", "left")
    observed = F.coalesce("observed", F.array().cast("array<string>"))
    return held.select("project_id", F.array_sort("rules").alias("rules"), observed.alias("observed"), (F.array_sort("rules") == observed).alias("passed"))
