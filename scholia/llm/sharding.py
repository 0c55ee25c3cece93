"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scholia.llm.common import table

#: Rows of a shard that one task numbers.
SLOT_ROWS = 20_000
SHARDS = 40


def _scores(key: Column, shards: Column) -> Column:
    """Struct (score, -shard) of each shard; the highest wins, ties go to the smaller shard."""

    def one(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, shard["id"]), 11)
        u = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-shard["weight"] / F.ln(u)).alias("score"), (-shard["id"]).alias("neg"))

    return F.transform(shards, one)


def _shards(weights: Sequence[float]) -> Column:
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    return F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: the one with the highest ``-weight / ln(hash)``.

    Only key and shard decide a score, so one more shard takes rows only into
    itself and one less gives up only its own. A null key is a key like others.
    """
    return (-F.array_max(_scores(key, _shards(weights)))["neg"]).cast("int")


def shard_records(
    df: DataFrame, key: str, weights: Sequence[float], *, grown_weight: float | None = None, order: Sequence[str] = (), slot_rows: int = SLOT_ROWS
) -> DataFrame:
    """Add shard, slot (gapless from 0 in each shard) and grown_shard.

    grown_shard is the shard when one of ``grown_weight`` is added (null without).
    Rows are numbered in (shard, bucket) groups of about ``slot_rows`` rows, and
    the groups' counts give each its first slot: no shard meets in one task.
    Null and repeated keys share their key's shard; ``order`` breaks their ties.
    An empty table stays empty. Input columns of the added names are replaced,
    also where key or order has such a name. Rows equal in key and order are
    interchangeable: they share a bucket.
    """
    n = df.count()
    buckets = max(1, -(-n // (slot_rows * len(weights))))
    by = [key, *[c for c in order if c != key]]
    added = ("shard", "slot", "grown_shard")
    # what rows are ranked by is held aside, as it may have the name of an added column
    out = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added], F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)]).alias("__by"))
    names = [c for c in out.columns if c != "__by"]
    own = F.col("__by.k0")
    out = out.withColumn("__best", F.array_max(_scores(own, _shards(weights)))).withColumn("shard", (-F.col("__best")["neg"]).cast("int"))
    if grown_weight is None:
        out = out.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        extra = F.struct(F.lit(len(weights)).alias("id"), F.lit(float(grown_weight)).alias("weight"))
        new = _scores(own, F.array(extra))[0]["score"]
        out = out.withColumn("grown_shard", F.when(new > F.col("__best")["score"], len(weights)).otherwise(F.col("shard")).cast("int"))
    salt = F.xxhash64(*[F.col(f"__by.k{i}") for i in range(len(by))], F.lit("slot"))
    out = out.drop("__best").withColumn("__bucket", F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = out.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # shards x buckets rows: one small row for each SLOT_ROWS rows of data
    first = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*[F.col(f"__by.k{i}").asc_nulls_first() for i in range(len(by))])
    numbered = out.withColumn("__row", F.row_number().over(within))
    slot = (F.col("__first") + F.col("__row") - 1).cast("long")
    return numbered.join(first, ["shard", "__bucket"]).select(*names, "shard", "grown_shard", slot.alias("slot"))


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    out = shard_records(docs, "doc_id", [1.0] * SHARDS, grown_weight=1.0, order=("text_crc32", "size"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
