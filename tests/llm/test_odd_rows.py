"""Every operator on empty tables, nulls in every column, repeated rows, long texts and clashing column names."""

import pytest
from pyspark.sql import functions as F

from tensorloom.llm import chat_hmm, decontam, edit_embed, mixing, pii, pu_quality, secrets, simhash, suffix_tree, url_filter

SF = "/root/testdata/sf0.001"
CLASH = ["text_", "row", "size", "word", "n", "x", "fp", "found", "score", "host", "rule", "verdict", "c", "k", "o", "t", "rest", "range", "copy", "u", "q", "b_host", "bad_id", "kept_id", "url_row", "recovered", "secret_found", "pii_text", "spans", "copies", "target", "path", "hash", "held"]


def on_docs(f):
    return lambda spark, df: f(df, spark)


#: Secrets are here what has 12 characters: odd rows are tested, not the forest.
TREE = [(0, 11.5, 0.0, 1.0)]
DOCS = {
    "quality": on_docs(lambda d, s: pu_quality.quality_scores(d, s.read.parquet(f"{SF}/labels.parquet"))),
    "keep_quality": on_docs(lambda d, s: pu_quality.keep_quality(d, s.read.parquet(f"{SF}/labels.parquet"))),
    "decontaminated": on_docs(lambda d, s: decontam.score_documents(d, s.read.parquet(f"{SF}/benchmark.parquet"))),
    "spans_removed": on_docs(lambda d, s: decontam.decontaminate(d, s.read.parquet(f"{SF}/benchmark.parquet"), remove="spans")),
    "near_duplicates": on_docs(lambda d, s: simhash.near_duplicates(d)),
    "suffix_tree": on_docs(lambda d, s: suffix_tree.score_texts(d)),
    "secrets": on_docs(lambda d, s: secrets.scan_secrets(d, forest=TREE)),
    "redact_secrets": on_docs(lambda d, s: secrets.redact_secrets(d, forest=TREE)),
    "edit": on_docs(lambda d, s: edit_embed.edit_likeness(d)),
    "edit_near": on_docs(lambda d, s: edit_embed.near_duplicates(d)),
    "pii": on_docs(lambda d, s: pii.find_personal_data(d)),
    "redact_pii": on_docs(lambda d, s: pii.redact(d)),
    "mix": on_docs(lambda d, s: mixing.mix_documents(d)),
}
KEEPS_ROWS = set(DOCS) - {"keep_quality"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(60).cache()


def odd(spark, docs):
    long_ = "word42 " * 4000 + "a1" * 6000
    rows = [(None,) * 5, (None, "only text", None, None, None), (-1, None, None, None, None), (-2, "", "en", None, 0), (-3, long_, "en", "a", 1), (-3, long_, "en", "a", 1), (-4, "\U0001f600\x00 \ufffd", "", "", None)]
    return docs.union(spark.createDataFrame(rows, docs.schema))


@pytest.mark.parametrize("name", sorted(DOCS))
def test_documents(spark, docs, name):
    run = DOCS[name]
    assert run(spark, docs.limit(0)).count() == 0
    df = odd(spark, docs)
    out = run(spark, df)
    assert len(out.columns) == len(set(out.columns))
    n = len(out.collect())
    assert n == 67 if name in KEEPS_ROWS else n <= 67
    wide = df.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    assert run(spark, wide).count() == n


def test_pages(spark):
    rules = url_filter.rules_frame(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    more = pages.union(spark.createDataFrame([(None, None, None), (1, "x://" + "a." * 5000 + "com/fr/" + "b" * 50_000, None), (1, None, "h")], pages.schema))
    assert url_filter.filter_urls(more, rules).count() == pages.count() + 3
    wide = more.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    assert url_filter.filter_urls(wide, rules).count() == pages.count() + 3
    none = url_filter.filter_urls(more, rules.filter("false"))
    assert none.filter("rule is not null or verdict <> 'allow'").count() == 0


def test_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert chat_hmm.recover_roles(turns.limit(0), turns).count() == 0
    assert chat_hmm.recover_roles(turns, turns.limit(0)).count() == turns.count()
    more = turns.union(spark.createDataFrame([(None, None, None, None), (None, 1, "user", ""), (5, 0, "what", "x" * 100_000), (5, 0, "what", "x" * 100_000), (6, None, None, "user: hi")], turns.schema))
    out = chat_hmm.recover_roles(more, more)
    assert out.count() == turns.count() + 5 and out.filter("recovered is null").count() == 0
    wide = more.select("*", *[F.lit("clash").alias(c) for c in CLASH])
    assert chat_hmm.recover_roles(wide, more).count() == turns.count() + 5
