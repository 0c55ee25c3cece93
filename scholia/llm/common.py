"""Helpers that several operators share: materialisation in shared storage, tables, Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from scholia.sources.store import release, scratch, shared_dir

__all__ = ["SLICE_BYTES", "drop_table", "materialise", "release", "scratch", "shared_dir", "slices", "table"]

#: Text bytes that one numpy or tokenizer step holds at a time.
SLICE_BYTES = 1 << 19


def drop_table(spark: SparkSession, name: str) -> None:
    """Take a scratch table out of the catalog; silent if the session has gone."""
    if spark.sparkContext._jsc is None:
        return
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the gateway may be closing
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write to Parquet in the shared folder and read it again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    schema = df.schema
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes in each piece.

    A single longer value forms a piece of its own: values are never cut.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        first = held = 0
        for i, n in enumerate(sizes.tolist()):
            if held and held + n > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        yield batch.slice(first)
