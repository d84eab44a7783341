"""The corpus pipeline: quality classifier, SimHash near-dedup, benchmark decontamination, secret scan, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet and rereads as the next one's docs.
All stages but the last return the columns of documents. Secrets are cut out of their texts (n_chars follows); contaminated
documents go; of near-duplicates the one with the smallest doc_id stays; the mix adds how often and how many words it takes
and leaves out documents that it doesn't take.

SQL can't express the trained stages, so ORACLE_SQL is None and the tests hold each stage against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tensorloom.llm import decontam, mixing, pu_quality, secrets, simhash
from tensorloom.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pu_quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs).filter("copies > 0")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("mixing sources to target weights", mix)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
