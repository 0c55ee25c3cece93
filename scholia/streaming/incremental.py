"""Incremental recheck: a stream of manuscripts keeps a table of results' keys up to date.

An extension: each micro-batch of whole projects is scanned, compared with the
stored keys, and the newest keys are written as the next version of the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from scholia.operators.review import REVIEWED, decisions, snapshot
from scholia.operators.structure import Manuscript
from scholia.sources.sinks import upsert

SCHEMA = "project_id long, ord int, file string, raw string"


def read_state(spark: SparkSession, path: str, version: int) -> DataFrame | None:
    """A version of the state, or none if it was never written; one that can't be read raises."""
    try:
        return spark.read.parquet(f"{path}/v{version}")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def recheck(spark: SparkSession, source: str, state: str, log: str, checkpoint: str) -> StreamingQuery:
    """Process the Parquet files that are in ``source`` now; decisions go to ``log``, keys to ``state``.

    A batch that is run again writes the same version again, so the result
    doesn't depend on failures.
    """

    def step(batch: DataFrame, number: int) -> None:
        held = Manuscript(batch)
        now = snapshot(held).persist()
        old = read_state(spark, state, number - 1)
        stored = now.limit(0) if old is None else old.select(*now.columns)
        decisions(now, stored).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{log}/b{number}")
        keyed = now.withColumn("version", F.lit(number))
        upsert(old, keyed, REVIEWED, "version").write.mode("overwrite").parquet(f"{state}/v{number}")
        now.unpersist()
        held.release()

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
