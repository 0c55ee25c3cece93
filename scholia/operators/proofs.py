"""Typed claims, obligations, packets, keys for reuse and the project report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.functions import formula as fx
from scholia.functions.text import normal_math
from scholia.operators import support

RESULT, CLAIM = support.RESULT, support.CLAIM


def lowered(df: DataFrame, column: str) -> DataFrame:
    """Add the canonical expression, its bracketed text, status and alpha key of a formula; null stays null."""
    names = ["expression", "rendered", "expression_status", "alpha_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            rows = []
            for text in batch.column(column).to_pylist():
                if text is not None and text not in memo:
                    x = fx.parse(text)
                    memo[text] = fx.canonical(x), fx.render(x), fx.status(x), fx.canonical(fx.alpha(x))
                rows.append(memo.get(text, (None,) * 4))
            if len(memo) > 100_000:
                memo.clear()
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in zip(*rows))], [*batch.schema.names, *names]) if rows else batch

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} string" for n in names]
    return df.mapInArrow(run, ", ".join(fields))


def atoms(manuscript) -> DataFrame:
    """Claims with their first formula in normal text, null without one."""
    found = manuscript.claims
    first = F.regexp_extract("claim", r"(?s)(\$\$.*?\$\$|\$[^$]*\$|\\\[.*?\\\]|\\\(.*?\\\))", 1)
    return found.withColumn("atom", F.when(first != "", normal_math(first)))


def formulas(manuscript) -> DataFrame:
    """Distinct formulas of the manuscripts, lowered."""
    return lowered(manuscript.facts.where("kind = 'math'").select(F.trim("text").alias("formula")).distinct(), "formula")


def steps(manuscript) -> DataFrame:
    """A typed step for each support edge; a step from an implication to its conclusion whose premise is known eliminates it."""
    edges = manuscript.support
    rule = F.when(F.col("kind").isin("result_reference", "equation_reference"), "apply_result").when(F.col("kind") == "definition", "definition_use")
    rule = rule.when(F.col("kind") == "named_property", "named_property_application")
    typed = lowered(atoms(manuscript).select(*CLAIM, "atom"), "atom").select(*CLAIM, "expression")
    parts = F.from_json("expression", "array<string>")
    shape = typed.withColumn("parts", parts).select(*CLAIM, "expression", F.when(F.col("parts")[0] == "implies", F.col("parts")[1]).alias("premise"), F.when(F.col("parts")[0] == "implies", F.col("parts")[2]).alias("conclusion"))
    source = shape.select(*RESULT, F.col("idx").cast("string").alias("source"), "premise", F.col("conclusion").alias("wanted"))
    held = edges.join(shape.select(*CLAIM, F.col("expression").alias("reached")), CLAIM, "left").join(source, [*RESULT, "source"], "left")
    context = typed.groupBy(*RESULT).agg(F.collect_set("expression").alias("known"))
    held = held.join(context, RESULT, "left")
    eliminated = (F.col("kind") == "prior_claim") & F.col("wanted").isNotNull() & (F.col("wanted") == F.col("reached")) & F.array_contains("known", F.col("premise"))
    return held.select(*CLAIM, "kind", "source", "status", rule.when(eliminated, "implication_elimination").otherwise("unknown").alias("rule"))


def obligations(manuscript) -> DataFrame:
    """One for each claim in the slice or with a formula: discharged if it is understood and a confident step enters it."""
    typed = lowered(atoms(manuscript).select(*CLAIM, "atom"), "atom").select(*CLAIM, "expression_status")
    sure = manuscript.support.where("status = 'confident'").select(*CLAIM, F.lit(True).alias("entered")).distinct()
    kinds = support.proof_slice(manuscript).where("kind <> 'pruned'")
    joined = kinds.join(typed, CLAIM).join(sure, CLAIM, "left")
    done = (F.col("kind") == "C") & (F.col("expression_status") != "opaque") & F.col("entered")
    return joined.select(*CLAIM, "kind", F.when(done, "discharged").otherwise("open").alias("status"))


def contexts(manuscript) -> DataFrame:
    """The earlier claims that each claim may use, as a running list."""
    before = Window.partitionBy(*RESULT).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return manuscript.claims.select(*CLAIM, F.array_join(F.collect_list(F.concat(F.lit("C"), F.col("idx"))).over(before), " ").alias("context"))


def packets(manuscript) -> DataFrame:
    """Each proof as numbered lines."""
    line = F.struct("idx", F.concat(F.lit("C"), F.col("idx"), F.lit(" "), F.col("claim")).alias("line"))
    grouped = manuscript.claims.groupBy(*RESULT).agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return grouped.select(*RESULT, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("packet"))


def nearest(paths: DataFrame, k: int) -> DataFrame:
    """Each source's k nearest reachable targets by distance, then number, of ``Manuscript.paths``."""
    order = Window.partitionBy("project_id", "source").orderBy("distance", "target")
    return paths.select("project_id", "source", "target", "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lean_statements(manuscript) -> DataFrame:
    """The closing implication of each proof as a Lean statement with a hole; unsupported shapes have no text."""
    found = atoms(manuscript)
    last = found.groupBy(*RESULT).agg(F.max_by("atom", "idx").alias("atom"))
    typed = lowered(last, "atom")
    a, b = F.regexp_extract("rendered", r"^\((\w+) => (\w+)\)$", 1), F.regexp_extract("rendered", r"^\((\w+) => (\w+)\)$", 2)
    name = F.concat(F.lit("t"), F.col("project_id"), F.lit("_"), F.col("node"))
    text = F.concat(F.lit("theorem "), name, F.lit(" ("), a, F.lit(" "), b, F.lit(" : Prop) : "), a, F.lit(" -> "), b, F.lit(" := by sorry"))
    return typed.select(*RESULT, F.when(a != "", text).alias("lean"), F.when(a != "", "partial").otherwise("unsupported").alias("lean_status"))


def report_counts(manuscript) -> DataFrame:
    """Per project: results, findings, open obligations, results that need attention and clean ones."""
    m = manuscript
    per_result = m.results.select("project_id", "node", F.col("identifier").alias("unit"), "ord")
    found = m.findings().groupBy("project_id", "unit", "ord").agg(F.count(F.lit(1)).alias("findings"))
    # a finding names its result by identifier and file; of results that share both, the first bears it
    first = Window.partitionBy("project_id", "unit", "ord").orderBy("node")
    per_result = per_result.withColumn("nth", F.row_number().over(first)).join(found.withColumn("nth", F.lit(1)), ["project_id", "unit", "ord", "nth"], "left")
    todo = obligations(m).groupBy("project_id", "node").agg(F.count_if(F.col("status") == "open").alias("open"))
    joined = per_result.join(todo, ["project_id", "node"], "left").fillna(0, ["findings", "open"])
    attention = (F.col("findings") > 0) | (F.col("open") > 0)
    return joined.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("results"),
        F.sum("findings").alias("findings"),
        F.sum("open").alias("open_obligations"),
        F.count_if(attention).alias("attention"),
        F.count_if(~attention).alias("clean"),
    )
