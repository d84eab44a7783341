"""Test surfaces as Column expressions, and simulators on spark.range with seeds that do not depend on partitioning."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOBOL_A = (0.0, 0.5, 3.0, 9.0)


def ishigami(x1: Column, x2: Column, x3: Column, a: float = 7.0, b: float = 0.1) -> Column:
    return F.sin(x1) + F.lit(a) * F.sin(x2) * F.sin(x2) + F.lit(b) * x3 * x3 * x3 * x3 * F.sin(x1)


def sobol_g(xs: list[Column], a=SOBOL_A) -> Column:
    a = [a[i % len(a)] for i in range(len(xs))]
    if min(a) < 0:
        raise ValueError("a must not be negative")
    return reduce(lambda p, q: p * q, [(F.abs(4 * x - 2) + F.lit(float(v))) / F.lit(1.0 + v) for x, v in zip(xs, a, strict=True)])


def friedman(x1: Column, x2: Column, x3: Column, x4: Column, x5: Column) -> Column:
    return 10 * F.sin(F.lit(math.pi) * x1 * x2) + 20 * (x3 - 0.5) * (x3 - 0.5) + 10 * x4 + 5 * x5


def uniform(key: Column, seed: int, stream: int) -> Column:
    """Uniform in (0, 1) from a hash of (row, seed, stream)."""
    h = F.xxhash64(key, F.lit(seed), F.lit(stream))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(key: Column, seed: int, stream: int) -> Column:
    return F.sqrt(-2 * F.ln(uniform(key, seed, stream))) * F.cos(F.lit(2 * math.pi) * uniform(key, seed, stream + 1000))


def simulate(spark: SparkSession, n: int, d: int, surface, lo: float = 0.0, hi: float = 1.0, sigma: float = 0.1, seed: int = 1, family: str = "gaussian") -> DataFrame:
    """row_id, x1..xd, y, f. surface: a function of the list of Columns. Poisson: eta = f - mean + ln 3; Bernoulli: 1.2 (f - mean) / sd."""
    key = F.col("row_id")
    df = spark.range(n).withColumnRenamed("id", "row_id")
    df = df.select("row_id", *[(F.lit(lo) + F.lit(hi - lo) * uniform(key, seed, j)).alias(f"x{j + 1}") for j in range(d)])
    df = df.withColumn("f", surface([F.col(f"x{j + 1}") for j in range(d)]))
    if family == "gaussian":
        return df.withColumn("y", F.col("f") + F.lit(sigma) * normal(key, seed, 100)).select("row_id", *[f"x{j + 1}" for j in range(d)], "y", "f")
    m = df.agg(F.avg("f").alias("m"), F.stddev_samp("f").alias("s")).first()
    u = uniform(key, seed, 100)
    if family == "poisson":
        rate = F.exp(F.col("f") - F.lit(m["m"]) + math.log(3.0))
        # Inverse distribution function: the number of partial sums of the probabilities below u, over 0..60.
        start = F.struct(F.lit(0).alias("y"), F.exp(-F.col("rate")).alias("p"), F.exp(-F.col("rate")).alias("c"))
        step = lambda s, k: F.when(s["c"] >= F.col("u"), s).otherwise(F.struct((s["y"] + 1).alias("y"), (s["p"] * F.col("rate") / k).alias("p"), (s["c"] + s["p"] * F.col("rate") / k).alias("c")))
        df = df.withColumn("rate", F.least(rate, F.lit(300.0))).withColumn("u", u)
        df = df.withColumn("y", F.aggregate(F.sequence(F.lit(1), F.lit(600)), start, step)["y"].cast("double"))
    else:
        df = df.withColumn("y", (u < 1 / (1 + F.exp(-1.2 * (F.col("f") - F.lit(m["m"])) / F.lit(m["s"])))).cast("double"))
    return df.select("row_id", *[f"x{j + 1}" for j in range(d)], "y", "f")


def simulate_ishigami(spark, n=800, sigma=0.15, seed=1, family="gaussian"):
    return simulate(spark, n, 3, lambda x: ishigami(*x), -math.pi, math.pi, sigma, seed, family)


def simulate_sobol_g(spark, n=800, d=4, a=SOBOL_A, sigma=0.05, seed=1, family="gaussian"):
    return simulate(spark, n, d, lambda x: sobol_g(x, a), 0.0, 1.0, sigma, seed, family)


def simulate_friedman(spark, n=800, sigma=1.0, seed=1, family="gaussian"):
    return simulate(spark, n, 5, lambda x: friedman(*x), 0.0, 1.0, sigma, seed, family)


#: The named example sets: 800 rows of each surface, and a grid of counts.
DATASETS = ("ishigami", "sobol_g", "friedman", "glam_poisson")


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """A named example set, made anew from its seed: the same rows in every run."""
    made = {
        "ishigami": lambda: simulate_ishigami(spark, 800, 0.15, 1),
        "sobol_g": lambda: simulate_sobol_g(spark, 800, 4, SOBOL_A, 0.05, 2),
        "friedman": lambda: simulate_friedman(spark, 800, 1.0, 3),
        "glam_poisson": lambda: age_year_counts(spark, 41, 31, seed=44),
    }
    if name not in made:
        raise ValueError(f"no data set {name!r}; there are {', '.join(DATASETS)}")
    return made[name]()


def grid_truth(xs: list[Column]) -> Column:
    """An interactive surface on the unit cube for 2 to 7 columns."""
    if not 2 <= len(xs) <= 7:
        raise ValueError("2 to 7 columns")
    tau = F.lit(2 * math.pi)
    out = F.sin(tau * xs[0]) * F.cos(tau * xs[1]) + 0.5 * F.sin(tau * xs[min(2, len(xs) - 1)]) + 0.35 * (xs[0] - 0.5) * (xs[1] - 0.5)
    more = (
        lambda x: 0.25 * F.sin(tau * x[3]) * F.cos(tau * x[1]),
        lambda x: 0.2 * x[4] * F.sin(tau * x[0]),
        lambda x: 0.15 * F.cos(tau * x[5]) * (x[1] - 0.5),
        lambda x: 0.12 * F.sin(tau * x[6]) * F.cos(tau * x[2]),
    )
    return reduce(lambda total, term: total + term(xs), more[: max(0, len(xs) - 3)], out)


def age_year_mean(spark: SparkSession, n_age: int = 41, n_year: int = 31) -> DataFrame:
    """A mortality-like grid: i1, i2, age 20..60, year 1980..2010, exposure, eta (log rate) and mu; ages vary fastest."""
    df = spark.range(n_age * n_year).select("id", (F.col("id") % n_age + 1).cast("int").alias("i1"), (F.floor(F.col("id") / n_age) + 1).cast("int").alias("i2"))
    df = df.withColumn("age", F.lit(20.0) + F.lit(40.0 / (n_age - 1)) * (F.col("i1") - 1)).withColumn("year", F.lit(1980.0) + F.lit(30.0 / (n_year - 1)) * (F.col("i2") - 1))

    def scaled(c: str, lo: float, hi: float, n: int) -> Column:  # mean and sample deviation of n even steps
        return (F.col(c) - F.lit((lo + hi) / 2)) / F.lit((hi - lo) / (n - 1) * math.sqrt(n * (n + 1) / 12))

    a, y, tau = scaled("age", 20.0, 60.0, n_age), scaled("year", 1980.0, 2010.0, n_year), 2 * math.pi
    eta = (0.15 * a + 0.35 * a * a) * (-0.25 * y) + F.sin(F.lit(tau / 40) * (F.col("age") - 20)) * 0.4 * F.cos(F.lit(tau / 30) * (F.col("year") - 1980))
    df = df.withColumn("eta", eta).withColumn("exposure", 200.0 * (1 + 0.02 * (F.col("year") - 1980)))
    mean = df.agg(F.avg("eta")).first()[0]
    df = df.withColumn("eta", F.col("eta") - F.lit(mean) + F.lit(math.log(2.0)))
    return df.withColumn("mu", F.col("exposure") * F.exp("eta"))


def age_year_counts(spark: SparkSession, n_age: int = 41, n_year: int = 31, seed: int = 44) -> DataFrame:
    """`age_year_mean` with Poisson counts y, each drawn from a generator of its own cell."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("double")
    def draw(cell, mu):
        return pd.Series([float(np.random.default_rng([seed, int(i)]).poisson(m)) for i, m in zip(cell, mu, strict=True)])

    return age_year_mean(spark, n_age, n_year).withColumn("y", draw("id", "mu")).drop("id")


def lab_truth(scenario: str, d: int):
    """(truth as a function of the columns, noise) of a laboratory design on the unit cube.

    d = 2: smooth_smooth, smooth_rough, strong_aniso, weak_signal; more columns: smooth_smooth and strong_aniso, whose second column is rough.
    """
    pi, tau = F.lit(math.pi), F.lit(2 * math.pi)
    rough = lambda x: F.sin(4 * tau * x[1]) * F.cos(pi * x[0])
    total = lambda terms: reduce(lambda a, b: a + b, terms)
    designs = {
        2: {
            "smooth_smooth": (lambda x: F.sin(tau * x[0]) + F.cos(tau * x[1]), 0.35),
            "smooth_rough": (lambda x: 0.8 * F.sin(tau * x[0]) + 1.2 * F.sin(3 * tau * x[1]), 0.40),
            "strong_aniso": (lambda x: 0.4 * x[0] + rough(x), 0.45),
            "weak_signal": (lambda x: 0.15 * (F.sin(tau * x[0]) + F.sin(tau * x[1])), 1.0),
        },
        3: {
            "smooth_smooth": (lambda x: F.sin(tau * x[0]) + F.cos(tau * x[1]) + 0.7 * F.sin(tau * x[2]), 0.40),
            "strong_aniso": (lambda x: 0.3 * x[0] + rough(x) + 0.5 * F.cos(tau * x[2]), 0.50),
        },
    }
    many = {
        "smooth_smooth": (lambda x: total([F.sin(tau * v + 0.3 * j) / math.sqrt(j) for j, v in enumerate(x, 1)]), 0.45),
        "strong_aniso": (lambda x: total([0.25 * F.sin(tau * x[0]) + 1.2 * rough(x) + 0.5 * F.cos(tau * x[2])] + [0.35 / math.sqrt(j) * F.sin(tau * v) for j, v in enumerate(x, 1) if j > 3]), 0.55),
    }
    known = designs.get(d, many) if d >= 2 else {}
    if scenario not in known:
        raise ValueError(f"unknown scenario {scenario!r} for {d} columns")
    return known[scenario]


def lab_design(spark: SparkSession, scenario: str, n: int | None = None, d: int = 2, seed: int = 1) -> DataFrame:
    """Rows of a laboratory design: uniform columns, the truth f and y with its noise."""
    f, sigma = lab_truth(scenario, d)
    return simulate(spark, n or (200 if d == 2 else 250), d, f, 0.0, 1.0, sigma, seed)


def packaged(spark: SparkSession, name: str) -> DataFrame:
    """The named example tables: ishigami, sobol_g and friedman (800 rows each), glam_poisson (41 x 31 cells)."""
    known = {"ishigami": simulate_ishigami, "sobol_g": simulate_sobol_g, "friedman": simulate_friedman, "glam_poisson": age_year_counts}
    if name not in known:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(known)}")
    return known[name](spark)
