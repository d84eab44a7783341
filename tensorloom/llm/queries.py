"""The registered queries of the corpus operators, thin over the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat_hmm, decontam, dual_tree, edit_embed, mixing, pii, pu_quality, quality_rules, secrets, simhash, source_audit, suffix_tree, url_filter
from .common import table


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_embed.likeness_and_classes(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's text is parsed for speaker markers; roles are recovered without looking at the column that names them."""
    turns = table(spark, sf_dir, "conversations")
    units = chat_hmm.spoken_units(turns.select("conv_id", "turn", "text"))
    out = chat_hmm.recover_roles(units, turns, text="unit_text", within="unit_piece")
    return out.select("conv_id", "turn", "unit_piece", "unit_text", "recovered", "bare", "rendered")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_documents(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


def op12_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pu_quality, op2_decontaminate, op3_simhash, op4_suffix_tree, op5_secret_scan, op6_edit_embedding, op7_chat_format, op8_personal_data, op9_mixing, op10_url_filter, op11_source_audit, op12_dual_tree_clusters, op13_quality_rules)}
ORACLE_SQL = {"op2_decontaminate": decontam.ORACLE, "op9_mixing": mixing.ORACLE, "op10_url_filter": url_filter.ORACLE, "op11_source_audit": source_audit.ORACLE, "op12_dual_tree_clusters": dual_tree.ORACLE}
