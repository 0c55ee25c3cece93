"""Review experiments: what each arm sends, inventories and their drift, manifests with hashed inputs, and targeted selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import ir, proofs, review
from scholia.operators.support import RESULT

#: What a review is given: plain text, numbered claims, or the addressed IR.
ARMS = ("raw", "skeleton", "ir")
MANIFEST = "experiment string, model string, inputs array<struct<path:string,sha256:string>>, cases array<struct<name:string,target:string>>"


def arms(manuscript, lines: DataFrame | None = None) -> DataFrame:
    """(result, arm, content) of every proved result in every arm."""
    m = manuscript
    lines = ir.proof_ir(m) if lines is None else lines
    proved = m.results.where("proof is not null").select("project_id", "ord", F.col("s").alias("result_s"), "node", F.concat_ws("\n\n", "statement", "proof").alias("content"))
    raw = proved.withColumn("arm", F.lit("raw"))
    skeleton = proofs.packets(m).select(*RESULT, F.col("packet").alias("content"), F.lit("skeleton").alias("arm"))
    packed = ir.packets(lines).join(proved.select(*RESULT), RESULT, "left_semi").select(*RESULT, F.col("packet").alias("content"), F.lit("ir").alias("arm"))
    return raw.select(*RESULT, "arm", "content").unionByName(skeleton.select(*RESULT, "arm", "content")).unionByName(packed.select(*RESULT, "arm", "content"))


def sizes(rendered: DataFrame) -> DataFrame:
    """Per project and arm: results, characters, and bytes on the wire."""
    return rendered.groupBy("project_id", "arm").agg(F.count(F.lit(1)).alias("results"), F.sum(F.length("content")).alias("chars"), F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def inventory(lines: DataFrame) -> DataFrame:
    """Per result the number of lines of its IR by kind, and of edges by status."""
    kinds = (*ir.NODE_KINDS.values(), "quantifier", "qualifier")
    counts = [F.count_if(F.col("target").isNull() & (F.col("kind") == k) if k in ir.NODE_KINDS.values() else F.col("kind") == k).alias(k) for k in dict.fromkeys(kinds)]
    edges = [F.count_if(F.col("target").isNotNull() & (F.col("status") == s)).alias(f"{s}_edges") for s in ("confident", "ambiguous", "unresolved")]
    return lines.groupBy(*RESULT).agg(*counts, *edges, F.count_if("opaque").alias("opaque"))


def preflight(manuscript, targets: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Inventory of targeted results (project_id, identifier): how many of that name there are, its lines, unsure groups and open source.

    A target is ready if exactly one result has its name and it has a proof.
    """
    m = manuscript
    lines = ir.proof_ir(m) if lines is None else lines
    named = m.results.select(*[c if c != "result_s" else F.col("s").alias("result_s") for c in RESULT], "identifier", F.col("proof").isNotNull().alias("proved"))
    groups = review.review_groups(m).groupBy(*RESULT).agg(F.count(F.lit(1)).alias("groups"), F.sum("edges").alias("unsure_edges"))
    held = targets.join(named, ["project_id", "identifier"], "left").join(inventory(lines), RESULT, "left").join(groups, RESULT, "left").fillna(0, ["groups", "unsure_edges"])
    found = targets.join(named, ["project_id", "identifier"], "left").groupBy("project_id", "identifier").agg(F.count("node").alias("candidates"))
    held = held.join(found, ["project_id", "identifier"])
    return held.withColumn("ready", F.coalesce((F.col("candidates") == 1) & F.col("proved"), F.lit(False)))


def select_target(results: DataFrame, targets: DataFrame) -> DataFrame:
    """The results named by ``targets`` (project_id, identifier); names that no result or several have are left out."""
    held = targets.join(results, ["project_id", "identifier"])
    one = held.groupBy("project_id", "identifier").count().where("count = 1").select("project_id", "identifier")
    return held.join(one, ["project_id", "identifier"], "left_semi")


def dispatch(rendered: DataFrame, strategies: DataFrame) -> DataFrame:
    """Each case (project_id, strategy) with the content of its strategy's arm; an unknown strategy raises."""
    unknown = strategies.where(~F.col("strategy").isin(*ARMS)).limit(1).collect()
    if unknown:
        raise ValueError(f"unknown strategy {unknown[0]['strategy']}")
    return strategies.join(rendered.withColumnRenamed("arm", "strategy"), ["project_id", "strategy"])


def drift(expected: DataFrame, observed: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, expected, observed) where an inventory's value differs or only one side has the key."""
    held = expected.select(*key, F.col(value).alias("expected")).join(observed.select(*key, F.col(value).alias("observed")), key, "full")
    return held.where(~F.col("expected").eqNullSafe(F.col("observed")))


def load_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The cases of a frozen manifest, after all its inputs under ``root`` have their recorded sha256; raises if one is missing or has changed."""
    read = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    inputs = read.select(F.explode("inputs").alias("i")).select("i.path", "i.sha256")
    names = [r["path"] for r in inputs.collect()]  # as many as the manifest lists
    held = spark.read.format("binaryFile").load([f"{root}/{n}" for n in names]).select("path", F.sha2("content", 256).alias("found")) if names else None
    if held is not None:
        tail = held.join(inputs.withColumnRenamed("path", "name"), F.col("path").endswith(F.concat(F.lit("/"), "name")), "right")
        bad = [r["name"] for r in tail.where(~F.col("found").eqNullSafe(F.col("sha256"))).select("name").collect()]
        if bad:
            raise ValueError(f"changed inputs: {', '.join(sorted(bad))}")
    return read.select("experiment", "model", F.explode("cases").alias("c")).select("experiment", "model", "c.*")


def guarded(turns: DataFrame, *, attempts: int, input_tokens: int, output_tokens: int) -> DataFrame:
    """Turns (run, turn, input_bound, output_cap) with whether the run's budget allows each, counting all turns before it."""
    from pyspark.sql.window import Window

    running = Window.partitionBy("run").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    spent = {"attempts": F.count(F.lit(1)).over(running), "input_spent": F.sum("input_bound").over(running), "output_spent": F.sum("output_cap").over(running)}
    return turns.withColumns(spent).withColumn("allowed", (F.col("attempts") <= attempts) & (F.col("input_spent") <= input_tokens) & (F.col("output_spent") <= output_tokens))
