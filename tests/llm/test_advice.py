"""Cases in which an operator did less than the whole job."""

import hashlib

import numpy as np
import pytest

from tensorloom.llm import decontam, edit_embed, simhash


PROSE = {k: " ".join(f"{k}{i * i % 97}" for i in range(40)) for k in "abcde"}


def test_dedup_drops_rows_and_not_ids(spark):
    """One row of each component stays, also where ids are repeated or null over different texts."""
    rows = [(1, "a"), (5, "a"), (5, "b"), (6, "b"), (None, "a"), (None, "c"), (None, "d"), (None, "d"), (7, "e"), (7, "e")]
    docs = spark.createDataFrame([(i, PROSE[k]) for i, k in rows], "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"][0]) for r in simhash.drop_near_duplicates(docs).collect()), key=lambda x: x[1])
    assert got == [(1, "a"), (5, "b"), (None, "c"), (None, "d"), (7, "e")]


def test_decontamination_drops_rows_and_not_ids(spark):
    bench = spark.createDataFrame([(1, PROSE["a"])], "item_id long, text string")
    docs = spark.createDataFrame([(None, PROSE["a"]), (None, PROSE["b"]), (3, PROSE["a"]), (3, PROSE["c"]), (4, PROSE["d"])], "doc_id long, text string").repartition(3)
    assert sorted(r["text"][0] for r in decontam.decontaminate(docs, bench).collect()) == ["b", "c", "d"]
    cut = {r["text"] for r in decontam.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {" ", PROSE["b"], PROSE["c"], PROSE["d"]}


@pytest.mark.parametrize("tile", [16, 512])
def test_band_links_against_brute_force(spark, monkeypatch, tile):
    """All that meet in a bucket and are alike are linked, also in a bucket whose smallest member is a stranger to them."""
    monkeypatch.setattr(edit_embed, "TILE", tile)
    rng, bands = np.random.default_rng(5), edit_embed.band_slots()
    fps = rng.integers(0, 256, (150, edit_embed.SLOTS), dtype=np.uint8)
    fps[:, bands[0]] = 7  # one bucket holds all
    more = fps.copy()
    for row in more:
        row[rng.choice(np.setdiff1d(np.arange(edit_embed.SLOTS), bands[0]), 12, replace=False)] ^= 255
    fps = np.unique(np.concatenate([fps, more]), axis=0)  # in the order of their digits
    meet = np.logical_or.reduce([(fps[:, None, ks] == fps[None, :, ks]).all(axis=2) for ks in bands])
    link = meet & ((fps[:, None] == fps[None]).mean(axis=2) >= edit_embed.ALIKE)
    root = np.arange(len(fps))
    while (low := np.where(link, root[None], len(fps)).min(axis=1)).tolist() != root.tolist():
        root = low
    names = [x.tobytes().hex() for x in fps]
    links = edit_embed.band_links(spark.createDataFrame([(x,) for x in names], "fingerprint string"))
    for r in links.collect():
        i, j = names.index(r["a"]), names.index(r["b"])
        assert i < j and link[i, j] and r["near"] == (fps[i] == fps[j]).mean()
    found = {r["node"]: r["root"] for r in simhash.components(links.select("a", "b")).collect()}
    assert [found.get(x, x) for x in names] == [names[k] for k in root]


def test_decontamination_counts_items_without_an_id(spark):
    bench = spark.createDataFrame([(None, PROSE["a"]), (2, PROSE["b"])], "item_id long, text string")
    docs = spark.createDataFrame([(1, PROSE["a"]), (2, PROSE["a"] + " " + PROSE["b"]), (3, PROSE["c"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.score_documents(docs, bench).collect()}
    assert {d: (r["n_hit"], r["n_items"], r["contaminated"]) for d, r in got.items()} == {1: (40, 1, True), 2: (80, 2, True), 3: (0, 0, False)}
    assert [got[d]["items_sha256"] for d in (1, 2)] == [hashlib.sha256(x).hexdigest() for x in (b"", b"2")]
    assert [r["doc_id"] for r in decontam.decontaminate(docs, bench).collect()] == [3]


def test_band_recall_on_edited_texts(spark):
    """Near copies of whole texts: pairs that brute force finds alike end in one class, at least nine of ten."""
    import random

    r = random.Random(8)
    base = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 400").limit(120).collect()]
    texts = []
    for t in base:
        texts.append(t)
        for _ in range(2):
            u = list(t)
            for _ in range(max(1, len(u) // 100)):
                u[r.randrange(len(u))] = r.choice("abcdefgh ")
            texts.append("".join(u))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fps = edit_embed.fingerprints(texts)
    near = (fps[:, None] == fps[None]).mean(axis=2) >= edit_embed.ALIKE
    pairs = [(i, j) for i, j in zip(*np.nonzero(near)) if i < j]
    got = {x["doc_id"]: x["class_fingerprint"] for x in edit_embed.likeness_and_classes(docs).collect()}
    assert len(pairs) > 100
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.9 * len(pairs)
    # No class holds what no chain of alike fingerprints joins.
    root = np.arange(len(texts))
    while (low := np.where(near, root[None], len(texts)).min(axis=1)).tolist() != root.tolist():
        root = low
    for i in range(len(texts)):
        for j in range(i):
            assert got[i] != got[j] or root[i] == root[j]


def test_recall_against_edit_distance(spark):
    """Texts within an edit distance of a thousandth of their length, by insertions and deletions alone: nine of ten pairs in one class."""
    import random

    r = random.Random(12)
    base = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 400").orderBy("doc_id").limit(200).collect()]
    texts = []
    for t in base:
        u = list(t)
        for _ in range(max(1, len(t) // 1000)):
            if r.random() < 0.5:
                del u[r.randrange(len(u))]
            else:
                u.insert(r.randrange(len(u) + 1), r.choice("abcdefgh "))
        texts += [t, "".join(u)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x["doc_id"]: x["class_fingerprint"] for x in edit_embed.likeness_and_classes(docs).collect()}
    assert sum(got[i] == got[i + 1] for i in range(0, len(texts), 2)) >= 0.9 * len(base)


def test_edit_likeness_of_string_and_wide_ids(spark):
    texts = [f"text number {i} " * (i + 2) for i in range(40)]
    for ids, kind in (([f"id-{i:03d}" for i in range(40)], "string"), ([(1 << 60) + i for i in range(40)], "long")):
        docs = spark.createDataFrame([(d, t) for d, t in zip(ids, texts)] + [(None, "none")], f"doc_id {kind}, text string").repartition(3)
        got = {x["doc_id"]: x for x in edit_embed.edit_likeness(docs).collect()}
        order = [None, *ids]
        whole = dict(zip(ids, texts)) | {None: "none"}
        assert len(got) == 41
        for i, d in enumerate(order):
            e = edit_embed.edited(whole[d], whole[order[(i + 1) % 41]])
            assert got[d]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()


def test_row_keys_of_file_scans(spark, tmp_path):
    """Rows of a written table have keys of their own that agree between scans and partitionings; dedup and decontamination by them equal those by written numbers."""
    from tensorloom.llm.common import number_rows

    rows = [(1, "a"), (5, "a"), (5, "b"), (6, "b"), (None, "a"), (None, "c"), (None, "d"), (None, "d"), (7, "e"), (7, "e")]
    frame = spark.createDataFrame([(i, PROSE[k]) for i, k in rows], "doc_id long, text string")
    frame.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    numbered, row = number_rows(docs, "t")
    one = {(x[row], x["text"]) for x in numbered.collect()}
    two = {(x[row], x["text"]) for x in numbered.coalesce(1).filter("text is not null").collect()}
    assert len({k for k, _ in one}) == len(rows) and one == two and "Row" in type(next(iter(one))[0]).__name__
    bench = spark.createDataFrame([(1, PROSE["a"])], "item_id long, text string")
    for f in (simhash.drop_near_duplicates, lambda d: decontam.decontaminate(d, bench), lambda d: decontam.decontaminate(d, bench, remove="spans")):
        key = lambda x: (x["doc_id"] is None, x["doc_id"] or 0, x["text"])
        assert sorted(f(docs).collect(), key=key) == sorted(f(frame.repartition(2)).collect(), key=key)
