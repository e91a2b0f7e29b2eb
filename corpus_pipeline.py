"""The corpus pipeline: language ID, near-duplicates, decontamination, personal data, packing.

STAGES are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import decontaminate, langid, minhash, packing, pii
from loomgrid.llm.common import picked, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter go, and those where no language has a third of the words.

    A null lang becomes the language that was found.
    """
    langs, table = langid.train(docs.where(~langid.held_out()))
    own = {c: f"_own_{c}" for c in ("lang_pred", "score", "languages") if c in docs.columns}
    found = langid.predict(docs.withColumnsRenamed(own), langs, table)
    found = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > 1 / 3)).withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.drop("lang_pred", "score", "languages").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, and one row of each document; rows without a doc_id are alone and stay."""
    found = stored(minhash.near_duplicates(docs).where("doc_id IS NOT NULL"), "groups")
    several = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    single = picked(docs.where("doc_id IS NOT NULL"), several.where("NOT kept OR n > 1").select("doc_id"), "left_anti")
    # texts move only where a doc_id has several rows
    repeated = picked(docs, several.where("kept AND n > 1").select("doc_id")).withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h")
    return single.unionByName(repeated).unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    own = {"leaks": "_own_leaks"} if "leaks" in docs.columns else {}
    found = decontaminate.flag(docs.withColumnsRenamed(own), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("leaks") == 0).drop("leaks").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Tokenising and the learned stages have no SQL form; a test compares run() on a planted table with the stages in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
