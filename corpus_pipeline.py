"""A corpus pipeline in five stages, each one operator of scholia.llm over all that the stage before kept.

Stages take (spark, docs, sf_dir). All but the last return the columns of
``documents``; each is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import materialise, table
from scholia.llm.decontamination import decontaminate
from scholia.llm.language import UNKNOWN, identify, learn
from scholia.llm.packing import pack_documents
from scholia.llm.simhash import first_of_groups
from scholia.llm.substring import substring_dedup
from scholia.llm.tokens import default_tokenizer
from scholia.llm.toxicity import held_out

#: Least certainty for four languages, of which each has a quarter without evidence; ``least_sure`` gives it for others.
MIN_LANGUAGE_SCORE = 0.35


def least_sure(languages: int) -> float:
    """Least mean of the words' best chances: as far above an even share of ``languages`` as MIN_LANGUAGE_SCORE is above a quarter."""
    even = 1 / max(1, languages)
    return even + (MIN_LANGUAGE_SCORE - 0.25) / 0.75 * (1 - even) - 1e-9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: null, letterless and undecided texts go; those that switch languages stay."""
    model = learn(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), "text", "lang"))
    found = identify(docs, model, sure="sure")
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("sure") >= least_sure(len(model.languages) if model else 0))).select(*docs.columns)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the row with the smallest doc_id, or one of a group of rows without any.

    Rows that share a doc_id, or have none, are judged each; rows equal in all
    columns are copies. Null and wordless texts are one group.
    """
    return first_of_groups(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one has; untouched texts stay as they are, emptied ones go.

    Rows without a doc_id neither lose words nor make others lose them.
    """
    found = substring_dedup(docs).where("n_removed = 0 or kept <> ''")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    size = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"n_chars": size, "text": text}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item of ``benchmark``; rows are judged each, also repeated ones and those without a doc_id."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; rows that share a doc_id, or have none, are packed each, a null text as its end id alone."""
    return pack_documents(docs, tokenizer=default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash),
    ("substring_dedup", substring),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Language models, fingerprint components and token files can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
