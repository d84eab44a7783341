"""Exact quantiles in bounded memory: order statistics by counts over ever narrower ranges.

A pass counts, for each order statistic that is still open, the rows of its range by equal bins, with the least and greatest value of each; the bin that holds
the statistic is the next range. It ends where a range is one value, or has so few rows that their values are counted one by one. Each pass is one
map-side-combined aggregation of at most BINS rows for each open range, so neither a task nor the driver ever holds the rows of a bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a range, and distinct values of a range that are counted one by one.
BINS, FEW = 512, 1_024


def _finite(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def order_statistics(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value} for ranks from 0 among the column's values; nulls, NaN and infinities are left out."""
    columns = [c for c, ranks in wanted.items() if ranks]
    names = {c: f"q{i}" for i, c in enumerate(columns)}
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])
    if not columns:
        return {}
    known = lambda n: F.when(_finite(n), F.col(n))
    ends = rows.agg(*[f(known(n)).alias(f"{k}{n}") for n in names.values() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    done: dict[tuple[str, int], float] = {}
    # An open range: its ends and how many rows of the column lie below it.
    ranges = {(c, r): (ends[f"lo{names[c]}"], ends[f"hi{names[c]}"], 0) for c in columns for r in wanted[c]}
    few: dict[tuple[str, int], tuple] = {}
    while ranges:
        done |= {key: lo for key, (lo, hi, _) in ranges.items() if lo == hi}
        few |= {key: x for key, x in ranges.items() if x[0] != x[1] and not x[1] / 2 - x[0] / 2}  # neighbours among the smallest numbers
        ranges = {key: x for key, x in ranges.items() if x[1] / 2 - x[0] / 2}
        spans = sorted({(key[0], lo, hi) for key, (lo, hi, _) in ranges.items()})
        if not spans:
            break

        def tag(i: int, c: str, lo: float, hi: float):
            x = F.col(names[c])
            at = F.least(F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS), F.lit(BINS - 1)).cast("int")
            return F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("span"), at.alias("bin"), x.alias("v")))

        tagged = rows.select(F.explode(F.array_compact(F.array(*[tag(i, *s) for i, s in enumerate(spans)]))).alias("t")).select("t.*")
        counts = tagged.groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()  # BINS rows for each range
        by: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["span"], r["bin"])):
            by.setdefault(r["span"], []).append(r)
        closer = {}
        for key, (lo, hi, below) in ranges.items():
            for r in by[spans.index((key[0], lo, hi))]:
                if key[1] < below + r["n"]:
                    (few if r["n"] <= FEW and r["lo"] != r["hi"] else closer)[key] = (r["lo"], r["hi"], below)
                    break
                below += r["n"]
        ranges = closer
    if few:
        spans = sorted({(key[0], lo, hi) for key, (lo, hi, _) in few.items()})
        pick = [F.when(F.col(names[c]).between(lo, hi), F.struct(F.lit(i).alias("span"), F.col(names[c]).alias("v"))) for i, (c, lo, hi) in enumerate(spans)]
        values: dict[int, list] = {}
        for r in rows.select(F.explode(F.array_compact(F.array(*pick))).alias("t")).select("t.*").groupBy("span", "v").count().collect():  # FEW rows for each range
            values.setdefault(r["span"], []).append((r["v"], r["count"]))
        for key, (lo, hi, below) in few.items():
            for v, n in sorted(values[spans.index((key[0], lo, hi))]):
                below += n
                if key[1] < below:
                    done[key] = v
                    break
    return done


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between the two nearest order statistics; None where it holds no number."""
    n = df.agg(*[F.count(F.when(_finite(F.col(f"`{c}`").cast("double")), 1)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    size = {c: n[f"n{i}"] for i, c in enumerate(columns)}
    place = lambda c, p: p * (size[c] - 1)
    found = order_statistics(df, {c: sorted({f(place(c, p)) for p in probabilities for f in (math.floor, math.ceil)}) if size[c] else [] for c in columns})

    def at(c: str, p: float) -> float | None:
        if not size[c]:
            return None
        a, b = (found[c, f(place(c, p))] for f in (math.floor, math.ceil))
        return a + (b - a) * (place(c, p) - math.floor(place(c, p)))

    return {c: [at(c, p) for p in probabilities] for c in columns}
