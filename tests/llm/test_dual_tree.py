"""Dual-tree clustering against plain rounds, cover trees against their definition, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from tensorloom.llm import dual_tree as dt

NAN, INF = float("nan"), float("inf")


def plain(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cs = [r[1] for r in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(cs)), key=lambda j: (far(v, cs[j]), j))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for j in range(len(cs)):
            part = [v for (_, v), o in zip(kept, own) if o == j]
            if part:
                cs[j] = [sum(x) // len(part) for x in zip(*part)]
    own = [near(v) for _, v in kept]
    d = [far(v, cs[o]) for (_, v), o in zip(kept, own)]
    return sorted(((i, o, x, sum(y for y, p in zip(d, own) if p == o), sum(d), hashlib.sha256(",".join(map(str, cs[o])).encode()).hexdigest()) for (i, _), o, x in zip(kept, own, d)), key=repr)


def clouds(rng, n, size, spread):
    return (rng.normal(0, 1, (6, size))[rng.integers(0, 6, n)] + rng.normal(0, spread, (n, size))).tolist()


@pytest.mark.parametrize(("spread", "chunk", "k"), [(0.05, 64, 6), (1.0, 100, 9), (0.3, 1024, 3)])
def test_against_plain_rounds(spark, spread, chunk, k):
    rng = np.random.default_rng(chunk)
    rows = list(enumerate(clouds(rng, 400, 5, spread)))
    rows += [(0, rows[3][1]), (500, rows[4][1]), (501, [0.0] * 4), (502, [0.0, NAN, 0.0, 0.0, 0.0]), (503, [0.0, INF, 0.0, 0.0, 0.0]), (504, None), (505, [0.0, None, 0.0, 0.0, 0.0]), (506, []), (None, [1.0] * 5), (507, [-0.0001] * 5), (508, [1e5, 0.0, 0.0, 0.0, 0.0])]
    rows += [(600 + i, [2.0] * 5) for i in range(150)]  # one hot vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = dt.cluster_vectors(df, k, 4, size=5, chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, k, 4, 5)


def test_ties_few_and_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [0.5, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    assert sorted(map(tuple, dt.cluster_vectors(df, 8, 3, size=2).collect())) == plain(rows, 8, 3, 2)
    assert dt.cluster_vectors(df.limit(0), size=2).collect() == []
    assert dt.cluster_vectors(df, size=3).collect() == []


def test_large_components(spark):
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate([(3e4, 1), (-3e4, 2), (2e5, -1), (-2e5, 0), (5e6, 3), (5e6, 4), (1e6, 1)])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [(*r[:2], *(x if x < 2**63 else None for x in r[2:5]), r[5]) for r in plain(rows, 3, 3, 2)]
    assert sorted(map(tuple, dt.cluster_vectors(df, 3, 3, size=2).collect())) == want
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [5e13, 0.0]), (3, [-5e13, 1.0])], "vec_id long, embedding array<double>")
    out = dt.cluster_vectors(huge, 1, 1, size=2).collect()
    assert sorted(r["vec_id"] for r in out) == [2, 3] and all(r["distance"] is None for r in out)


def test_cover_tree():
    rng = np.random.default_rng(2)
    x = np.floor(1024 * np.array(clouds(rng, 700, 3, 0.2)))
    t = dt.CoverTree(x, leaf=8)
    assert sorted(t.order) == list(range(700)) and len(t.centre) > 30
    for i in range(len(t.centre)):
        own = t.order[t.start[i] : t.end[i]]
        assert t.centre[i] in own
        assert np.linalg.norm(x[own] - x[t.centre[i]], axis=1).max() == t.radius[i]
        kids = range(t.first[i], t.first[i] + t.many[i])
        if kids:
            assert [t.start[c] for c in kids] == [t.start[i], *(t.end[c] for c in kids)][:-1] and t.end[kids[-1]] == t.end[i]
            cs = x[[t.centre[c] for c in kids]]
            apart = np.linalg.norm(cs[:, None] - cs[None], axis=2)[np.triu_indices(len(cs), 1)]
            assert t.centre[i] == t.centre[kids[0]] and (not len(apart) or apart.min() > t.radius[i] / dt.BASE)
            assert max(t.radius[c] for c in kids) <= t.radius[i] / dt.BASE


def test_pruning_takes_nodes_whole():
    rng = np.random.default_rng(3)
    x = np.floor(1024 * np.array(clouds(rng, 900, 4, 0.01))).astype(np.int64)
    t = dt.CoverTree(x)
    heads = np.unique(np.round(x / 512).astype(np.int64) * 512, axis=0)
    whole, places, owners = dt.assign(t, x[t.order], heads)
    assert sum(b - a for a, b, _ in whole) > 400
    assert (dt.owners_of(t, x[t.order], heads) == dt.squared(x[t.order], heads).argmin(axis=1)).all()
