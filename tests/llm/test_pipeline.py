"""The pipeline's stages against plain versions on small inputs, and the guard of the entry module."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tensorloom.llm import decontam, mixing, pu_quality, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "mixing sources to target weights"]


def test_run_is_the_stages_one_after_another(spark, docs):
    out, cols = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == cols
    want = sorted(map(tuple, out.select("doc_id", "text", "copies", "taken").collect()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "text", "copies", "taken").collect()))
    assert got == want and got


def test_quality_stage_drops_what_scores_low(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in pu_quality.quality_scores(docs, labels).collect()}
    assert ids(corpus_pipeline.quality(spark, docs, SF)) == sorted(d for d, s in scores.items() if s >= 0.3)


def test_dedup_stage_keeps_the_smallest_of_each_component(spark, docs):
    again = docs.union(docs.filter("doc_id < 5")).union(docs.filter("doc_id = 7").withColumn("doc_id", F.lit(10_000).cast("long")))
    found = simhash.near_duplicates(again).collect()
    assert ids(corpus_pipeline.near_dedup(spark, again, SF)) == sorted({r["component_id"] for r in found})


def test_decontamination_stage_drops_hit_documents(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontam.score_documents(docs, bench).filter("contaminated").collect()}
    assert ids(corpus_pipeline.decontamination(spark, docs, SF)) == sorted(set(ids(docs)) - bad)


def test_secret_stage_keeps_documents_and_cuts_texts(spark, docs):
    odd = docs.limit(3).select("doc_id", F.lit("a token = \"1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae\" b").alias("text"), "lang", "source", "n_chars")
    out = corpus_pipeline.secret_scan(spark, odd, SF).collect()
    assert {(r["text"], r["n_chars"]) for r in out} == {('a token = "[SECRET]" b', 22)}
    spans = {r["doc_id"]: r["n_secrets"] for r in secrets.scan_secrets(docs).collect()}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()}
    for r in docs.collect():
        assert cut[r["doc_id"]].count("[SECRET]") == spans[r["doc_id"]] and (spans[r["doc_id"]] or cut[r["doc_id"]] == r["text"])


def test_mix_stage_takes_what_the_operator_takes(spark, docs):
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_documents(docs).filter("copies > 0").collect()}
    assert {r["doc_id"]: r["copies"] for r in corpus_pipeline.mix(spark, docs, SF).collect()} == want


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, docs, stage):
    """Empty tables, nulls in every column, and extra columns with the names operators use."""
    assert stage(spark, docs.limit(0), SF).count() == 0
    nulls = spark.createDataFrame([(None,) * 5, (1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0)], docs.schema)
    assert stage(spark, nulls, SF).count() <= 4
    names = ["size", "row", "word", "u", "fp", "target", "copies", "host", "tries", "found", "score", "label"]
    wide = docs.select("*", *[F.lit(1).alias(n) for n in names])
    assert ids(stage(spark, wide, SF)) == ids(stage(spark, docs, SF))


def test_entry_imports_without_the_subpackage(tmp_path):
    root = Path(__file__).parents[2]
    code = f"""
import sys, importlib.abc
sys.path.insert(0, {str(root)!r})
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tensorloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "fit_gaussian" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and "gram_1d" in e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).returncode == 0
