"""The source audit against a plain version, with many seats and blocks, and on odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tensorloom.llm import source_audit as sa

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["été", "Straße", "ÉTÉ"]


def plain(rows, min_docs):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        groups = {s: Counter(w for d in own if d[1] == s for w in d[2] if df[w] >= min_docs) for s in {d[1] for d in own}}
        total = sum(groups.values(), Counter())
        of = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p, q = {s: of(c) for s, c in groups.items()}, of(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = sorted((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in groups if t != s)
            best = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if groups[s][w] and p[s][w] > q[w])[:10]
            out += [(lang, s, part, t.decode(), -v, i + 1) for part, x in (("pair", pairs), ("term", best)) for i, (v, t) in enumerate(x)]
    return sorted(out)


@pytest.mark.parametrize(("seat", "block", "sources"), [(1, 5, 5), (2, 9, 7), (3, 1000, 8), (16, 16384, 3)])
def test_against_plain(spark, seat, block, sources):
    rng = random.Random(seat)
    rows = [(rng.choice(["en", "de", "DE", None]), rng.choice([*(f"s{i}" for i in range(sources)), None]), rng.choice([" ", ", ", "\n1"]).join(rng.choices(WORDS, k=rng.randrange(1, 30)))) for _ in range(150)]
    rows += [("xx", "alone", "rare words"), ("yy", "a", ""), ("yy", "b", None), (None, None, None), ("en", "empty", ""), ("en", "big", "waa " * 3000), ("en", "big", "waa " * 3000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(4)
    got = sorted(map(tuple, sa.audit_sources(df, 4, seat, block).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain(rows, 4)
    assert {r[:5] for r in got if r[0] == "yy"} == {("yy", "a", "pair", "b", 0), ("yy", "b", "pair", "a", 0)}
    assert not [r for r in got if r[0] == "xx"]


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "en", "s", "a b", "x"), (1, "en", "s", "a b", "x"), (None, "en", "t", "b", None)], "doc_id long, lang string, source string, text string, seat string")
    assert sa.audit_sources(df.limit(0)).collect() == []
    out = sorted(map(tuple, sa.audit_sources(df, min_docs=2).collect()))
    assert [r[:4] for r in out] == [("en", "s", "pair", "t"), ("en", "s", "term", "a"), ("en", "t", "pair", "s"), ("en", "t", "term", "b")]


def test_every_two_seats_meet_once(spark):
    from pyspark.sql import functions as F

    for seats in range(1, 12):
        rows = spark.range(seats).select(F.col("id").cast("int").alias("i"), F.explode(sa._visits(F.col("id").cast("int"), F.lit(seats))).alias("v")).select("i", "v.host", "v.round").collect()
        assert sorted(tuple(sorted(r[:2])) for r in rows) == [(i, j) for i in range(seats) for j in range(i + 1, seats)]
        busy = Counter((r["round"], x) for r in rows for x in r[:2])
        assert max(busy.values(), default=1) == 1


def test_long_division_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randrange(1, 9 * 10 ** rng.randrange(1, 16))
        c = rng.randrange(0, n + 1)
        assert int(sa.scaled(np.array([c]), n + 2)[0]) == 1 + 10**9 * (c + 2) // (n + 2)
