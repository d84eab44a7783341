"""The suffix tree against a plain one, and against what a model of the whole corpus must tell apart."""

import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from tensorloom.llm import suffix_tree

ODD = [(-1, None), (-2, ""), (-3, "\0ab a\0b abc\0"), (-4, "é" * 20), (None, "never seen zzzzqqqq"), (-5, "a a a a a a a a"), (-5, "a a a a a a a a"), (-6, "\n\r \n")]


def plain_scores(texts: list, held: list[bool], depth: int, least: int, divergence: float, weight: float) -> tuple[list[float], int]:
    """Scores by the definition: counts of whole contexts as tuples, states by the deleted divergence, longest states."""
    docs = [["<first>", *((t or "").encode().lower().split()), "<end>"] for t in texts]
    grams, total = Counter(), Counter()
    for ws, h in zip(docs, held):
        if not h:
            for i in range(1, len(ws)):
                for d in range(min(i, depth) + 1):
                    grams[tuple(ws[i - d : i + 1])] += 1
                    total[tuple(ws[i - d : i])] += 1
    n, v = total[()], sum(len(g) == 1 for g in grams)
    states: set = set()

    def chance(gram: tuple) -> float:
        p = (grams[gram[-1:]] + 0.1) / (n + 0.1 * (v + 1))
        for d in range(1, len(gram)):
            if gram[-1 - d : -1] in states:
                p = (grams[gram[-1 - d :]] + weight * p) / (total[gram[-1 - d : -1]] + weight)
        return p

    for d in range(1, depth + 1):
        gain: dict = defaultdict(int)
        for g, c in list(grams.items()):
            if len(g) == d + 1 and total[g[:-1]] >= least:
                q = chance(g[1:])
                gain[g[:-1]] += c * round(suffix_tree.SCALE * math.log((c - 1 + weight * q) / (total[g[:-1]] - 1 + weight) / q))
        states |= {ctx for ctx, x in gain.items() if 2 * x >= divergence * suffix_tree.SCALE}
    return [sum(math.log10(chance(tuple(ws[max(0, i - depth) : i + 1]))) for i in range(1, len(ws))) for ws in docs], len(states)


@pytest.mark.parametrize(("size", "depth", "least"), [(1_000_000, 3, 2), (2_000, 2, 3), (500, 4, 2)])
def test_against_a_plain_tree(spark, monkeypatch, size, depth, least):
    monkeypatch.setattr(suffix_tree, "CHUNK", size)
    monkeypatch.setattr(suffix_tree, "BUCKET", 5 * size)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(80)
    docs = docs.union(spark.createDataFrame(ODD, docs.schema)).repartition(3)
    rows = docs.collect()
    held = [r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    want, states = plain_scores([r["text"] for r in rows], held, depth, least, suffix_tree.DIVERGENCE, suffix_tree.WEIGHT)
    assert states > 20
    got = suffix_tree.score_texts(docs, depth=depth, least=least).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for (d, x), (e, y) in zip(sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(((r["doc_id"], s) for r, s in zip(rows, want)), key=key), strict=True):
        assert d == e and x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_a_text_that_occurs_twice_scores_apart_however_large_the_corpus(spark):
    """Contexts seen twice are states beside any number of other tokens."""
    import random

    r = random.Random(1)
    vocabulary = ["w" + str(i) for i in range(400)]
    text = lambda: " ".join(r.choice(vocabulary) for _ in range(40))
    twice = text()
    for n in (50, 1500):
        texts = [text() for _ in range(n)] + [twice, twice]
        docs = spark.createDataFrame([(10 * i + 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {x["doc_id"]: x["score"] - x["base_score"] for x in suffix_tree.score_texts(docs, mod=1 << 30).collect()}
        both = [got[10 * n + 3], got[10 * n + 13]]
        assert both[0] == both[1] > max(v for k, v in got.items() if k < 10 * n) + 10


def test_held_out_text_gains_from_contexts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [x for x in suffix_tree.score_texts(docs).collect() if x["held_out"]]
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got) + 0.2 * sum(x["n_tokens"] for x in got)


@pytest.mark.parametrize("bits", [20, 40, 64])
def test_distinct_keys(monkeypatch, bits):
    """Keys sorted with their places as one number, also where both together have over 64 bits and keys differ in the last ones alone."""
    r = np.random.default_rng(bits)
    some = r.integers(0, 1 << bits, 3000, dtype=np.uint64, endpoint=bits < 64) if bits < 64 else r.integers(0, 1 << 64, 3000, dtype=np.uint64)
    near = (r.integers(0, 7, 3000, dtype=np.uint64) << np.uint64(61)) + r.integers(0, 30, 3000, dtype=np.uint64)
    for x in (some, near, some << np.uint64(64 - bits), some[:1], some[:0], np.full(5, (1 << 64) - 1, np.uint64)):
        values, back = suffix_tree.distinct(x)
        want, number = np.unique(x, return_inverse=True)
        assert np.array_equal(values, want) and np.array_equal(back, number)
    # What the CPU budget rests on: no argsort for the keys of a chunk.
    monkeypatch.setattr(suffix_tree.np, "argsort", None)
    assert len(suffix_tree.distinct(r.integers(0, 1 << 44, 50_000, dtype=np.uint64))[0]) > 49_000


def test_words_of_odd_texts():
    texts = [b" a  b\t\n\x0b\x0c\rC ", None, b"", b"   ", b"\x00A\x1cb\x1f c\x85d \xc2\xa0x", b"\xff\xfe Z", "É é\u2003x ".encode(), b"x"]
    for kind in (pa.binary(), pa.large_binary()):
        for part in (pa.array(texts, kind), pa.array([b"no", *texts, b"no"], kind).slice(1, len(texts)), pa.array([], kind)):
            words, n = suffix_tree.tokens(part)
            want = [(t or b"").lower().split() for t in part.to_pylist()]
            assert [w.as_buffer().to_pybytes() for w in words] == sum(want, []) and n.tolist() == [len(w) for w in want]


def test_chunks_filled_by_bytes_and_pieces_give_the_same_scores(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame(ODD, docs.schema)).coalesce(1)
    got = lambda: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], round(r["score"], 6)) for r in suffix_tree.score_texts(docs).collect()))
    want = got()
    monkeypatch.setattr(suffix_tree, "BYTES", 3_000)
    monkeypatch.setattr(suffix_tree, "PIECE", 500)
    assert suffix_tree.chunks(docs, "doc_id", "text", 10).count() > 5 and got() == want
