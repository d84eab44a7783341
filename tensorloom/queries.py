"""The registered queries of the spline engine, and equivalent SQL where SQL can express them.

Aggregates and transcendental values are quantised by q() on both sides, since sums in parallel differ in the last digits.
"""

from __future__ import annotations

import math
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import families as fam_
from .functions import surfaces
from .functions.basis import Knots, difference_penalty, domains
from .functions.quantiles import exact_quantiles
from .operators import grid, lab, lab_adaptive, lag, null_space, selection
from .operators.control import Control, boundary_status, damped_step
from .operators.control import scale_anisotropy as split_scale
from .operators.optimizers import frozen_curves, propose
from .operators.spline import SmoothTerm, TensorSpline
from .plans import tensor
from .plans.backends import Request, State, build
from .sources import io

QUERIES: dict = {}
ORACLE_SQL: dict = {}
QTY, DISC, TAX = Knots(1.0, 50.0, 6), Knots(0.0, 0.1, 5), Knots(0.0, 0.08, 4)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(x, digits: int = 6):
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)).cast("double") / F.lit(10.0**digits)


def sq(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE)"


# SQL for a basis: one CTE for each degree of the recursion.


def basis_sql(kn: Knots, source: str, x: str, keep: str, prefix: str) -> tuple[str, str]:
    """(CTEs, name of the last): columns keep, prefix1..prefixk."""
    s, d = kn.sequence.tolist(), kn.degree
    n = len(s) - 1
    last = n if kn.cyclic else max(i for i in range(n) if s[i + 1] > s[i])
    num = lambda v: f"{v!r}::DOUBLE"
    raw = f"greatest(least({x}::DOUBLE, {num(kn.hi)}), {num(kn.lo)})" if kn.cyclic else f"{x}::DOUBLE"
    level = [f"CASE WHEN v >= {num(s[i])} AND v {'<=' if i >= last else '<'} {num(s[i + 1])} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS b0_{i}" if s[i + 1] > s[i] else f"0.0::DOUBLE AS b0_{i}" for i in range(n)]
    out = [f"{prefix}_0 AS (SELECT {keep}, v, {', '.join(level)} FROM (SELECT {keep}, {raw} AS v FROM {source}))"]
    for k in range(1, d + 1):
        terms = []
        for i in range(n - k):
            e = ["0.0::DOUBLE"]
            if s[i + k] > s[i]:
                e.append(f"(v - {num(s[i])}) / {num(s[i + k] - s[i])} * b{k - 1}_{i}")
            if s[i + k + 1] > s[i + 1]:
                e.append(f"({num(s[i + k + 1])} - v) / {num(s[i + k + 1] - s[i + 1])} * b{k - 1}_{i + 1}")
            terms.append(f"{' + '.join(e)} AS b{k}_{i}")
        out.append(f"{prefix}_{k} AS (SELECT {keep}, v, {', '.join(terms)} FROM {prefix}_{k - 1})")
    cols = [f"b{d}_{i}" + (f" + b{d}_{kn.k + i}" if kn.cyclic and i < d else "") + f" AS {prefix}{i + 1}" for i in range(kn.k)]
    out.append(f"{prefix}_f AS (SELECT {keep}, {', '.join(cols)} FROM {prefix}_{d})")
    return ", ".join(out), f"{prefix}_f"


# Bases.

SIZE = Knots(1.0, 50.0, 7)
_SIZE, _SIZE_T = basis_sql(SIZE, "part", "p_size", "p_partkey", "b")
HOUR = Knots(0.0, 24.0, 6, cyclic=True)
_HOUR, _HOUR_T = basis_sql(HOUR, "(SELECT event_id, extract(hour FROM ts) AS h FROM events)", "h", "event_id", "b")


@query(f"WITH {_SIZE} SELECT p_partkey, {', '.join(sq(f'b{i}', 9) + f' AS b{i}' for i in range(1, 8))} FROM {_SIZE_T}")
def basis_open(spark, sf_dir):
    df = SIZE.columns(t(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size"), "b")
    return df.select("p_partkey", *[q(F.col(f"b{i}"), 9).alias(f"b{i}") for i in range(1, 8)])


@query(f"WITH {_HOUR} SELECT event_id, {', '.join(sq(f'b{i}', 9) + f' AS b{i}' for i in range(1, 7))} FROM {_HOUR_T}")
def basis_cyclic(spark, sf_dir):
    df = HOUR.columns(t(spark, sf_dir, "events").select("event_id", F.hour("ts").alias("h")), F.col("h"), "b")
    return df.select("event_id", *[q(F.col(f"b{i}"), 9).alias(f"b{i}") for i in range(1, 7)])


@query("""
SELECT c AS "column", CASE WHEN lo >= -1e-9 AND hi <= 1 + 1e-9 THEN 0.0::DOUBLE ELSE lo END AS lo, CASE WHEN lo >= -1e-9 AND hi <= 1 + 1e-9 THEN 1.0::DOUBLE ELSE hi END AS hi FROM (
  SELECT 'l_quantity' AS c, min(l_quantity)::DOUBLE AS lo, max(l_quantity)::DOUBLE AS hi FROM lineitem
  UNION ALL SELECT 'l_discount', min(l_discount)::DOUBLE, max(l_discount)::DOUBLE FROM lineitem
  UNION ALL SELECT 'l_extendedprice', min(l_extendedprice)::DOUBLE, max(l_extendedprice)::DOUBLE FROM lineitem)
""")
def basis_domain(spark, sf_dir):
    cols = ["l_quantity", "l_discount", "l_extendedprice"]
    return spark.createDataFrame([(c, *d) for c, d in zip(cols, domains(t(spark, sf_dir, "lineitem"), cols))], "column string, lo double, hi double")


@query("SELECT sum(CASE WHEN l_quantity < 5 OR l_quantity > 45 THEN 1 ELSE 0 END)::BIGINT AS l_quantity FROM lineitem")
def outside_span(spark, sf_dir):
    k = Knots(5.0, 45.0, 6)
    return t(spark, sf_dir, "lineitem").agg(F.sum(k.outside(F.col("l_quantity").cast("double")).cast("long")).alias("l_quantity"))


@query("""
WITH g AS (SELECT extract(month FROM o_orderdate) AS m, count(*)::DOUBLE AS n FROM orders GROUP BY 1), a AS (SELECT m, n - lag(n) OVER (ORDER BY m) AS d FROM g), b AS (SELECT m, d - lag(d) OVER (ORDER BY m) AS d FROM a), c AS (SELECT m, d - lag(d) OVER (ORDER BY m) AS d FROM b)
SELECT 1::INT AS "order", sum(d * d) AS roughness FROM a UNION ALL SELECT 2, sum(d * d) FROM b UNION ALL SELECT 3, sum(d * d) FROM c
""")
def difference_penalty_matrix(spark, sf_dir):
    """g'Pg for the counts of orders by month: the penalty matrix of each order against sums of squared differences."""
    rows = t(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("m")).count().orderBy("m").collect()  # 12 months
    g = np.array([r["count"] for r in rows], float)
    return spark.createDataFrame([(i, float(g @ difference_penalty(len(g), i) @ g)) for i in (1, 2, 3)], "`order` int, roughness double")


def truth_row(spark, **checks) -> DataFrame:
    """One row of properties that a right fit has; SQL holds the same row."""
    kinds = {bool: "boolean", int: "bigint", float: "double"}
    vals = {k: v.item() if isinstance(v, np.generic) else v for k, v in checks.items()}
    return spark.createDataFrame([tuple(vals.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in vals.items()))


def descends(history: list[dict], tol: float = 1e-9) -> bool:
    v = [h["objective"] for h in history]
    return len(v) > 1 and all(b <= a + tol * (1 + abs(a)) for a, b in zip(v, v[1:]))


# Tensor-train contraction at cores that need no fit.

_CORES = tensor.formula_cores([QTY.k, DISC.k], 2)
_Q2, _Q2T = basis_sql(QTY, "lineitem", "l_quantity", "l_returnflag, l_discount, l_extendedprice", "a")
_D2, _D2T = basis_sql(DISC, _Q2T, "l_discount", "l_returnflag, l_extendedprice, " + ", ".join(f"a{i}" for i in range(1, 7)), "b")


def _surface_sql() -> str:
    bonds = []
    for r in range(2):
        left = " + ".join(f"a{j + 1} * {float(_CORES[0][0, j, r])!r}::DOUBLE" for j in range(QTY.k))
        right = " + ".join(f"b{j + 1} * {float(_CORES[1][r, j, 0])!r}::DOUBLE" for j in range(DISC.k))
        bonds.append(f"(({left}) * ({right}))")
    return " + ".join(bonds)


def _two_bases(spark, sf_dir, keep=("l_returnflag", "l_extendedprice")):
    df = t(spark, sf_dir, "lineitem").select(*keep, "l_quantity", "l_discount")
    return DISC.columns(QTY.columns(df, F.col("l_quantity"), "a"), F.col("l_discount"), "b")


@query(f"WITH {_Q2}, {_D2}, s AS (SELECT l_returnflag, l_extendedprice, {_surface_sql()} AS f FROM {_D2T}) SELECT l_returnflag, count(*) AS n, {sq('avg(f)', 8)} AS mean_fit, {sq('sum((l_extendedprice / 1e5::DOUBLE - f) * (l_extendedprice / 1e5::DOUBLE - f)) / count(*)', 8)} AS mse FROM s GROUP BY l_returnflag")
def surface_contraction(spark, sf_dir):
    """The surface as a projection in the JVM."""
    df = _two_bases(spark, sf_dir).select("l_returnflag", "l_extendedprice", tensor.surface_column(_CORES, ["a", "b"]).alias("f"))
    r = F.col("l_extendedprice") / 1e5 - F.col("f")
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), q(F.avg("f"), 8).alias("mean_fit"), q(F.sum(r * r) / F.count("*"), 8).alias("mse"))


@query(f"WITH {_Q2}, {_D2} SELECT l_returnflag, {sq('avg(' + _surface_sql() + ')', 8)} AS mean_fit FROM {_D2T} GROUP BY l_returnflag")
def surface_arrow(spark, sf_dir):
    """The same contraction by Arrow batches, as models with larger tensors are scored."""
    from .operators.spline import TensorSplineModel

    m = TensorSplineModel(TensorSpline(["l_quantity", "l_discount"]), "gaussian", [QTY, DISC], State(_CORES, np.zeros(1)), np.ones(2), "none", True, 0, 0, 0, 0, [], [], [], [])
    out = m.transform(t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount"))
    return out.groupBy("l_returnflag").agg(q(F.avg("fit"), 8).alias("mean_fit"))


_theta = [f"({i + 1}, {j + 1}, {float(v)!r}::DOUBLE)" for (i, j), v in np.ndenumerate(tensor.dense(_CORES))]


@query(f"""
WITH th AS (SELECT l_linenumber::INT AS i, round(l_discount * 100)::INT AS j, avg(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2),
a AS (SELECT x.i, x.j, x.v - 2 * y.v + z.v AS dv FROM th x JOIN th y ON y.i = x.i + 1 AND y.j = x.j JOIN th z ON z.i = x.i + 2 AND z.j = x.j),
b AS (SELECT x.i, x.j, x.v - 2 * y.v + z.v AS dv FROM th x JOIN th y ON y.j = x.j + 1 AND y.i = x.i JOIN th z ON z.j = x.j + 2 AND z.i = x.i)
SELECT {sq('0.5 * (0.7 * (SELECT sum(dv * dv) FROM a) + 1.9 * (SELECT sum(dv * dv) FROM b))')} AS penalty
""")
def penalty_value(spark, sf_dir):
    """The penalty of a train that holds the mean quantities by line number and discount, by its cores' environments."""
    means = t(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("i"), F.round(F.col("l_discount").cast("double") * 100).cast("int").alias("j")).agg(F.avg(F.col("l_quantity").cast("double")).alias("v"))
    rows = means.orderBy("i", "j").collect()  # 77 cells
    sizes = [len({r["i"] for r in rows}), len({r["j"] for r in rows})]
    cores = grid.dense_train(np.array([r["v"] for r in rows]), sizes)
    v = tensor.penalty_value(cores, [difference_penalty(p) for p in sizes], np.array([0.7, 1.9]))
    return spark.range(1).select(q(F.lit(v)).alias("penalty"))


@query("""
WITH p AS (SELECT count(DISTINCT l_linenumber)::DOUBLE AS p1, count(DISTINCT l_discount)::DOUBLE AS p2, count(DISTINCT l_tax)::DOUBLE AS p3 FROM lineitem)
SELECT r::INT AS rank, p1 * p2 * p3 AS "full", p1 * r + p2 * r * r + p3 * r AS stored, 2.0::DOUBLE * r * r AS gauge, p1 * r + p2 * r * r + p3 * r - 2 * r * r AS intrinsic FROM p, range(1, 5) x(r)
""")
def complexity(spark, sf_dir):
    """Sizes of trains with a coefficient for each distinct value of three columns."""
    r = t(spark, sf_dir, "lineitem").agg(*[F.count_distinct(c).alias(c) for c in ("l_linenumber", "l_discount", "l_tax")]).first()
    rows = []
    for rank in range(1, 5):
        c = tensor.complexity(tensor.formula_cores(list(r), rank))
        rows.append((rank, *(float(c[k]) for k in ("full", "stored", "gauge", "intrinsic"))))
    return spark.createDataFrame(rows, "rank int, full double, stored double, gauge double, intrinsic double")


# Sums of products.


def _gram_sql(weight: str = "1.0::DOUBLE", group: str = "") -> str:
    lat = f"lat AS (SELECT {group + ', ' if group else ''}l_quantity, sum({weight}) AS w, sum(({weight}) * l_extendedprice) AS wy FROM lineitem GROUP BY {group + ', ' if group else ''}l_quantity)"
    ctes, last = basis_sql(QTY, "lat", "l_quantity", f"{group + ', ' if group else ''}w, wy", "a")
    keys = f"{group}, " if group else ""
    pairs = " UNION ALL ".join([f"SELECT {keys}{i}::INT AS i, {j}::INT AS j, sum(w * a{i} * a{j}) AS v FROM {last} GROUP BY {keys}i" for i in range(1, 7) for j in range(i, 7)] + [f"SELECT {keys}{i}::INT AS i, 0::INT AS j, sum(wy * a{i}) / 1e3 AS v FROM {last} GROUP BY {keys}i" for i in range(1, 7)])
    pairs = pairs.replace("GROUP BY i", "").replace(f"GROUP BY {keys}i", f"GROUP BY {group}") if group else pairs.replace("GROUP BY i", "")
    return f"WITH {lat}, {ctes}, g AS ({pairs}) SELECT {keys}i, j, {sq('v', 3)} AS value FROM g"


_ONE = Knots(0.0, 1.0, 1, 0)


def _margin_rows(spark, df: DataFrame, weight: str | None = None, fold: str | None = None) -> DataFrame:
    """Gram matrix and right-hand side of one margin, from a backend's answer, in long form."""
    df = df.withColumn("one", F.lit(0.5))
    be = build(df, [QTY, _ONE], ["l_quantity", "one"], "l_extendedprice", "gaussian", weight, None, [], fold, "moments")
    rows = []
    for f in be.folds or [None]:
        m = (be if f is None else be.part(f, True)).total(Request("tensor"))
        sums = [(i + 1, j + 1, float(m["S"][i, j])) for i in range(6) for j in range(i, 6)] + [(i + 1, 0, float(m["b"][i]) / 1e3) for i in range(6)]
        rows += [(f or 0, *r) for r in sums]
    out = spark.createDataFrame(rows, "fold int, i int, j int, v double").select("fold", "i", "j", q(F.col("v"), 3).alias("value"))
    return out if fold else out.drop("fold")


@query(_gram_sql())
def gram_1d(spark, sf_dir):
    return _margin_rows(spark, t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"))


@query(_gram_sql("1.0::DOUBLE + l_discount * 10"))
def gram_weighted(spark, sf_dir):
    return _margin_rows(spark, t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (F.lit(1.0) + F.col("l_discount") * 10).alias("w")), "w")


@query(_gram_sql(group="fold").replace("FROM lineitem", "FROM (SELECT *, (l_orderkey % 3)::INT AS fold FROM lineitem)"))
def gram_by_fold(spark, sf_dir):
    return _margin_rows(spark, t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 3).cast("int").alias("fold"), "l_quantity", "l_extendedprice"), None, "fold")


def _moment_rows(spark, be) -> DataFrame:
    m = be.total(Request("tensor", states=[State([np.zeros((1, p, 1)) for p in be.sizes], np.zeros(1))]))
    n = len(m["b"])
    rows = [(i + 1, j + 1, float(m["S"][i, j])) for i in range(n) for j in range(i, n)] + [(i + 1, 0, float(m["b"][i]) / 1e3) for i in range(n)]
    return spark.createDataFrame(rows, "i int, j int, value double").select("i", "j", q(F.col("value"), 3).alias("value"))


_LAT2 = "lat AS (SELECT l_quantity, l_discount, count(*)::DOUBLE AS w, sum(l_extendedprice) AS wy FROM lineitem GROUP BY ALL)"
_T1, _T1T = basis_sql(QTY, "lat", "l_quantity", "l_discount, w, wy", "a")
_T2, _T2T = basis_sql(DISC, _T1T, "l_discount", "w, wy, " + ", ".join(f"a{i}" for i in range(1, 7)), "b")


@query(f"""
WITH {_LAT2}, {_T1}, {_T2},
r AS (SELECT row_number() OVER () AS id, w, wy, [{', '.join(f'a{i} * b{j}' for i in range(1, 7) for j in range(1, 6))}] AS x FROM {_T2T}),
u AS (SELECT id, w, wy, k, x[k] AS v FROM r, range(1, 31) g(k)),
g AS (SELECT a.k::INT AS i, b.k::INT AS j, sum(a.w * a.v * b.v) AS value FROM u a JOIN u b ON a.id = b.id AND a.k <= b.k GROUP BY a.k, b.k UNION ALL SELECT k::INT, 0::INT, sum(wy * v) / 1e3 FROM u GROUP BY k)
SELECT i, j, {sq('value', 3)} AS value FROM g
""")
def gram_tensor(spark, sf_dir):
    """Moments of a two-margin tensor basis by one Arrow pass over the rows."""
    spec = TensorSpline(["l_quantity", "l_discount"], "l_extendedprice", knots=[QTY, DISC], backend="moments")
    return _moment_rows(spark, spec.prepare(t(spark, sf_dir, "lineitem")).backend)


# Families.

_ETA = "(0.3 * value / 50.0 - 0.4)"


def _eta():
    return 0.3 * F.col("value") / 50.0 - 0.4


@query(f"""
WITH e AS (SELECT event_id, value::DOUBLE AS value, (event_id % 4)::DOUBLE AS y FROM events), m AS (SELECT *, {_ETA} AS eta, exp(greatest(least({_ETA}, 20.0), -20.0)) AS mu FROM e)
SELECT event_id, {sq('mu')} AS w, {sq('eta + (y - mu) / mu')} AS z, {sq('2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))')} AS deviance, {sq('(y - mu) / sqrt(mu)')} AS pearson FROM m
""")
def glm_poisson(spark, sf_dir):
    df = t(spark, sf_dir, "events").select("event_id", F.col("value").cast("double").alias("value"), (F.col("event_id") % 4).cast("double").alias("y"))
    w, z = fam_.working("poisson", F.col("y"), _eta())
    mu = fam_.inverse_link("poisson", _eta())
    return df.select("event_id", q(w).alias("w"), q(z).alias("z"), q(fam_.unit_deviance("poisson", F.col("y"), mu)).alias("deviance"), q(fam_.residual("poisson", F.col("y"), mu, "pearson")).alias("pearson"))


@query(f"""
WITH e AS (SELECT doc_id, toxic::DOUBLE AS y, n_chars::DOUBLE / 5000.0 - 1.0 AS eta FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL),
m AS (SELECT *, 1.0 / (1.0 + exp(-eta)) AS raw FROM e), c AS (SELECT *, greatest(least(raw, 1 - 1e-5), 1e-5) AS mu FROM m), v AS (SELECT *, greatest(mu * (1 - mu), 1e-4) AS v FROM c)
SELECT doc_id, {sq('v')} AS w, {sq('eta + (y - mu) / v', 4)} AS z, {sq('-2 * (y * ln(greatest(least(raw, 1 - 1e-12), 1e-12)) + (1 - y) * ln(1 - greatest(least(raw, 1 - 1e-12), 1e-12)))', 4)} AS deviance FROM v
""")
def glm_bernoulli(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    df = t(spark, sf_dir, "labels").filter("toxic is not null").join(docs, "doc_id").select("doc_id", F.col("toxic").cast("double").alias("y"), (F.col("n_chars").cast("double") / 5000.0 - 1.0).alias("eta"))
    w, z = fam_.working("bernoulli", F.col("y"), F.col("eta"))
    return df.select("doc_id", q(w).alias("w"), q(z, 4).alias("z"), q(fam_.unit_deviance("bernoulli", F.col("y"), fam_.inverse_link("bernoulli", F.col("eta"))), 4).alias("deviance"))


@query(f"""
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*)::DOUBLE AS y, avg(value) AS v FROM events GROUP BY 1)
SELECT {sq('avg(y)')} AS gaussian, {sq('ln(sum(y) / sum(exp(v / 100.0)))')} AS poisson, {sq('ln(greatest(least(avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END), 0.95), 0.05) / (1 - greatest(least(avg(CASE WHEN v > 50 THEN 1.0 ELSE 0.0 END), 0.95), 0.05)))')} AS bernoulli FROM h
""")
def start_intercepts(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    r = h.agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.sum(F.exp(F.col("v") / 100.0)).alias("e"), F.sum((F.col("v") > 50).cast("double")).alias("b")).first()
    vals = [fam_.start_intercept("gaussian", r["n"], r["y"]), fam_.start_intercept("poisson", r["n"], r["y"], r["e"]), fam_.start_intercept("bernoulli", r["n"], r["b"])]
    return spark.range(1).select(*[q(F.lit(float(v))).alias(n) for v, n in zip(vals, ("gaussian", "poisson", "bernoulli"))])


def _hourly(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").cast("double").alias("y"), F.avg("value").alias("v"))


# Lags.


@query(f"""
WITH h AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT h, {', '.join(f'lag(v, {i}) OVER (ORDER BY h) AS l{i}' for i in range(4))} FROM h)
SELECT strftime(h, '%Y-%m-%d %H') AS h, {', '.join(sq(f'l{i}') + f' AS l{i}' for i in range(4))} FROM w WHERE {' AND '.join(f'l{i} IS NOT NULL' for i in range(4))}
""")
def lag_windows(spark, sf_dir):
    df = lag.lag_windows(_hourly(spark, sf_dir), ["v"], 3, "h")
    return df.select(F.date_format("h", "yyyy-MM-dd HH").alias("h"), *[q(F.col(f"v__lag{i}")).alias(f"l{i}") for i in range(4)])


_LAGK = Knots(0.0, 100.0, 5)
_LB = _LAGK.sequence.tolist()
_LAGB = basis_sql(_LAGK, "(SELECT h, 0 AS l, l0 AS v FROM w UNION ALL SELECT h, 1, l1 FROM w UNION ALL SELECT h, 2, l2 FROM w)", "v", "h, l", "b")


@query(f"""
WITH hh AS (SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1), w0 AS (SELECT h, {', '.join(f'lag(v, {i}) OVER (ORDER BY h) AS l{i}' for i in range(3))} FROM hh), w AS (SELECT * FROM w0 WHERE l2 IS NOT NULL), {_LAGB[0]}
SELECT strftime(h, '%Y-%m-%d %H') AS h, {', '.join(sq(f'sum(b{i})') + f' AS s{i}' for i in range(1, 6))} FROM {_LAGB[1]} GROUP BY h
""")
def lag_summed_basis(spark, sf_dir):
    """Bases summed over the lags, by the estimator's own bases."""
    spec = lag.DistributedLagSpline(["v"], "y", "h", lag=2)
    rows = lag.lag_windows(_hourly(spark, sf_dir), ["v"], 2, "h").select(F.date_format("h", "yyyy-MM-dd HH").alias("h"), *spec.lag_names())

    def run(batches):
        for b in batches:
            x = sum(bases[0] for bases in spec.bases(b, [_LAGK, Knots(0.0, 2.0, 3, 2)]))
            yield pa.RecordBatch.from_arrays([b.column("h"), *[pa.array(x[:, j]) for j in range(5)]], ["h", *[f"s{j}" for j in range(1, 6)]])

    out = rows.mapInArrow(run, "h string, " + ", ".join(f"s{j} double" for j in range(1, 6)))
    return out.select("h", *[q(F.col(f"s{j}")).alias(f"s{j}") for j in range(1, 6)])


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*)::DOUBLE AS y, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT y, lag(v, 3) OVER (ORDER BY h) AS l3 FROM h)
SELECT count(*) AS n, round(sum(y), 1) AS total_fit, true AS descends, true AS converged, 1.0::DOUBLE AS rr_at_centre FROM w WHERE l3 IS NOT NULL
""")
def fit_distributed_lag(spark, sf_dir):
    """Poisson counts over two lagged series: with the canonical link fitted and observed totals agree."""
    df = _hourly(spark, sf_dir).withColumn("v2", F.col("v") * F.col("v") / 100)
    m = lag.DistributedLagSpline(["v", "v2"], "y", "h", lag=3, k=4, k_lag=3, lam=1.0).fit(df)
    total = m.transform(df).agg(F.count("fit").alias("n"), F.sum("fit").alias("s")).first()
    return truth_row(spark, n=total["n"], total_fit=round(total["s"], 1), descends=descends(m.history[1:], 1e-6), converged=m.converged, rr_at_centre=m.effect_rows("v", at=[m.centre["v"]])[0][4])


# Test surfaces.


@query(f"""
WITH x AS (SELECT id, -3.0 + 0.006 * i AS x1, sin(i::DOUBLE) * 3 AS x2, cos(i::DOUBLE) * 3 AS x3, (i % 10) / 10.0::DOUBLE AS u1, (i % 7) / 7.0::DOUBLE AS u2, (i % 11) / 11.0::DOUBLE AS u3, (i % 13) / 13.0::DOUBLE AS u4, (i % 3) / 3.0::DOUBLE AS u5 FROM (SELECT o_orderkey AS id, o_orderkey % 1000 AS i FROM orders))
SELECT id, {sq('sin(x1) + 7.0 * sin(x2) * sin(x2) + 0.1 * x3 * x3 * x3 * x3 * sin(x1)')} AS ishigami, {sq('(abs(4*u1-2)+0.0)/1.0 * (abs(4*u2-2)+0.5)/1.5 * (abs(4*u3-2)+3.0)/4.0 * (abs(4*u4-2)+9.0)/10.0')} AS sobol_g,
  {sq('10 * sin(pi() * u1 * u2) + 20 * (u3 - 0.5) * (u3 - 0.5) + 10 * u4 + 5 * u5')} AS friedman FROM x
""")
def test_surfaces(spark, sf_dir):
    """The surfaces at points that the orders' keys spread over their domains."""
    i = F.col("i").cast("double")
    df = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1000).alias("i"))
    df = df.select("id", (-3.0 + 0.006 * i).alias("x1"), (F.sin(i) * 3).alias("x2"), (F.cos(i) * 3).alias("x3"), *[((F.col("i") % m).cast("double") / float(m)).alias(f"u{j}") for j, m in enumerate((10, 7, 11, 13, 3), 1)])
    u = [F.col(f"u{j}") for j in range(1, 6)]
    return df.select("id", q(surfaces.ishigami(F.col("x1"), F.col("x2"), F.col("x3"))).alias("ishigami"), q(surfaces.sobol_g(u[:4])).alias("sobol_g"), q(surfaces.friedman(*u)).alias("friedman"))


@query("SELECT i AS surface, (SELECT count(*) FROM orders) AS n, true AS noise_as_named, true AS counts_are_whole FROM range(4) r(i)")
def simulate_surfaces(spark, sf_dir):
    """Simulated tables with a row for each order."""
    n = t(spark, sf_dir, "orders").count()
    parts = [(surfaces.simulate_ishigami(spark, n), 0.15), (surfaces.simulate_sobol_g(spark, n), 0.05), (surfaces.simulate_friedman(spark, n), 1.0), (surfaces.simulate_friedman(spark, n, family="poisson"), None)]
    out = None
    for i, (p, sigma) in enumerate(parts):
        noise = F.lit(True) if sigma is None else F.abs(F.stddev_samp(F.col("y") - F.col("f")) / sigma - 1) < 0.1
        r = p.agg(F.lit(i).cast("long").alias("surface"), F.count("*").alias("n"), noise.alias("noise_as_named"), (F.lit(True) if sigma else F.bool_and(F.col("y") == F.floor("y"))).alias("counts_are_whole"))
        out = r if out is None else out.union(r)
    return out


_G = "WITH g AS (SELECT i AS id, " + ", ".join(f"((i * {a} + 3) % 97) / 97.0::DOUBLE AS x{j}" for j, a in enumerate((7, 11, 13, 17, 19, 23, 29), 1)) + " FROM (SELECT o_orderkey AS i FROM orders))"
_S, _C = (lambda m, x: f"sin({m} * pi() * {x})"), (lambda m, x: f"cos({m} * pi() * {x})")
_GT = f"{_S(2, 'x1')} * {_C(2, 'x2')} + 0.5 * {_S(2, 'x3')} + 0.35 * (x1 - 0.5) * (x2 - 0.5)"
_GT7 = f"{_GT} + 0.25 * {_S(2, 'x4')} * {_C(2, 'x2')} + 0.2 * x5 * {_S(2, 'x1')} + 0.15 * {_C(2, 'x6')} * (x2 - 0.5) + 0.12 * {_S(2, 'x7')} * {_C(2, 'x3')}"
_ROUGH = f"{_S(8, 'x2')} * {_C(1, 'x1')}"
_LAB = {
    ("smooth_smooth", 2): f"{_S(2, 'x1')} + {_C(2, 'x2')}", ("smooth_rough", 2): f"0.8 * {_S(2, 'x1')} + 1.2 * {_S(6, 'x2')}", ("strong_aniso", 2): f"0.4 * x1 + {_ROUGH}", ("weak_signal", 2): f"0.15 * ({_S(2, 'x1')} + {_S(2, 'x2')})",
    ("smooth_smooth", 3): f"{_S(2, 'x1')} + {_C(2, 'x2')} + 0.7 * {_S(2, 'x3')}", ("strong_aniso", 3): f"0.3 * x1 + {_ROUGH} + 0.5 * {_C(2, 'x3')}",
    ("smooth_smooth", 5): " + ".join(f"sin(2 * pi() * x{j} + 0.3 * {j}) / sqrt({j})" for j in range(1, 6)), ("strong_aniso", 5): f"0.25 * {_S(2, 'x1')} + 1.2 * {_ROUGH} + 0.5 * {_C(2, 'x3')} + 0.35 / sqrt(4) * {_S(2, 'x4')} + 0.35 / sqrt(5) * {_S(2, 'x5')}",
}


def _unit_points(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).select("id", *[(((F.col("id") * a + 3) % 97) / F.lit(97.0)).alias(f"x{j}") for j, a in enumerate((7, 11, 13, 17, 19, 23, 29), 1)])


@query(f"{_G} SELECT id, {sq(_GT.replace('x3', 'x2'))} AS d2, {sq(_GT)} AS d3, {sq(_GT7)} AS d7 FROM g")
def grid_truths(spark, sf_dir):
    x = [F.col(f"x{j}") for j in range(1, 8)]
    return _unit_points(spark, sf_dir).select("id", *[q(surfaces.grid_truth(x[:d])).alias(f"d{d}") for d in (2, 3, 7)])


@query(f"{_G} SELECT id, {', '.join(sq(v) + f' AS {k}_{d}' for (k, d), v in _LAB.items())} FROM g")
def lab_truths(spark, sf_dir):
    x = [F.col(f"x{j}") for j in range(1, 8)]
    return _unit_points(spark, sf_dir).select("id", *[q(surfaces.lab_truth(k, d)[0](x[:d])).alias(f"{k}_{d}") for k, d in _LAB])


_AGES = "k AS (SELECT (SELECT count(DISTINCT l_quantity) FROM lineitem) AS na, (SELECT count(DISTINCT extract(year FROM o_orderdate)) FROM orders) AS ny)"


def _ages(spark, sf_dir) -> tuple[int, int]:
    """As many ages as there are quantities, as many years as there are years of orders."""
    return t(spark, sf_dir, "lineitem").select("l_quantity").distinct().count(), t(spark, sf_dir, "orders").select(F.year("o_orderdate")).distinct().count()


@query(f"""
WITH {_AGES}, g AS (SELECT i1::INT AS i1, i2::INT AS i2, 20.0 + 40.0::DOUBLE / (na - 1) * (i1 - 1) AS age, 1980.0 + 30.0::DOUBLE / (ny - 1) * (i2 - 1) AS year FROM k, range(1, 500) a(i1), range(1, 500) b(i2) WHERE i1 <= na AND i2 <= ny),
z AS (SELECT *, (age - 40) / (SELECT stddev_samp(age) FROM g WHERE i2 = 1) AS a, (year - 1995) / (SELECT stddev_samp(year) FROM g WHERE i1 = 1) AS t FROM g),
e AS (SELECT *, (0.15 * a + 0.35 * a * a) * (-0.25 * t) + sin(2 * pi() * (age - 20) / 40) * 0.4 * cos(2 * pi() * (year - 1980) / 30) AS raw, 200 * (1 + 0.02 * (year - 1980)) AS exposure FROM z)
SELECT i1, i2, {sq('exposure')} AS exposure, {sq('exposure * exp(raw - avg(raw) OVER () + ln(2))', 4)} AS mu FROM e
""")
def age_year_truth(spark, sf_dir):
    return surfaces.age_year_mean(spark, *_ages(spark, sf_dir)).select("i1", "i2", q(F.col("exposure")).alias("exposure"), q(F.col("mu"), 4).alias("mu"))


@query(f"WITH {_AGES} SELECT na * ny AS n, true AS whole, true AS mean_is_variance FROM k")
def age_year_draws(spark, sf_dir):
    """Counts around their means as Poisson draws lie: squared deviations over means average to one."""
    z = (F.col("y") - F.col("mu")) * (F.col("y") - F.col("mu")) / F.col("mu")
    return surfaces.age_year_counts(spark, *_ages(spark, sf_dir)).agg(F.count("*").alias("n"), F.bool_and(F.col("y") == F.floor("y")).alias("whole"), (F.abs(F.avg(z) - 1) < 0.3).alias("mean_is_variance"))


@query(f"""
WITH a AS (SELECT x1, row_number() OVER (ORDER BY x1) AS i1, count(*) OVER () AS n FROM (SELECT DISTINCT l_quantity::DOUBLE AS x1 FROM lineitem)), b AS (SELECT x2, row_number() OVER (ORDER BY x2) AS i2 FROM (SELECT DISTINCT l_discount::DOUBLE AS x2 FROM lineitem))
SELECT (i1 - 1 + (i2 - 1) * n)::BIGINT AS row_id, i1::INT AS i1, i2::INT AS i2, x1, x2 FROM a, b
""")
def grid_points(spark, sf_dir):
    """The grid of all quantities and discounts."""
    axes = {x: sorted(r[0] for r in t(spark, sf_dir, "lineitem").select(F.col(c).cast("double")).distinct().collect()) for x, c in zip(("x1", "x2"), XS)}  # 50 and 11 values
    return grid.axes_product(spark, axes)


# Selection.


@query("SELECT count(*) AS n, 5::BIGINT AS folds, true AS even, true AS same_in_any_order FROM orders")
def cv_folds_by_key(spark, sf_dir):
    """Folds by a hash of the key: within 10% of even, and the same for a row wherever it lies."""
    fold = selection.fold_id(F.col("o_orderkey"), 5)
    a = t(spark, sf_dir, "orders").select("o_orderkey", fold.alias("fold"))
    b = t(spark, sf_dir, "orders").repartition(7, "o_custkey").select(F.col("o_orderkey").alias("k"), fold.alias("again"))
    sizes = a.groupBy("fold").count().agg(F.sum("count").alias("n"), F.count("*").alias("folds"), (F.max("count") < 1.1 * F.min("count")).alias("even"))
    same = a.join(b, a["o_orderkey"] == b["k"]).agg(F.bool_and(F.col("fold") == F.col("again")).alias("same_in_any_order"))
    return sizes.join(F.broadcast(same), F.lit(True))  # one row each


@query("SELECT fold, (n + CASE WHEN fold < r THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT count(*) // 5 AS n, count(*) % 5 AS r FROM orders), range(5) f(fold)")
def cv_folds_balanced(spark, sf_dir):
    return selection.balanced_folds(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 5).groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query(f"""
WITH f AS (SELECT (o_orderkey % 5)::INT AS fold, o_totalprice::DOUBLE / 1e5 AS y, 1 + (o_orderkey % 3)::INT AS rank FROM orders), m AS (SELECT rank, fold, avg((y - 1.5) * (y - 1.5) / rank) AS loss FROM f GROUP BY rank, fold)
SELECT rank, {sq('avg(loss)')} AS mean_cv, {sq('stddev_samp(loss) / sqrt(5.0)')} AS se_cv, count(*) AS n_finite FROM m GROUP BY rank
""")
def cv_summary(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_totalprice").cast("double") / 1e5).alias("y"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("rank"))
    losses = df.groupBy("rank", "fold").agg((selection.cv_loss("mse", "gaussian", F.col("y"), F.lit(1.5)) / F.col("rank")).alias("loss"))
    return selection.summarise_cv(losses).select("rank", q(F.col("mean_cv")).alias("mean_cv"), q(F.col("se_cv")).alias("se_cv"), "n_finite")


@query("""
WITH c AS (SELECT o_orderpriority AS id, (o_orderkey % 4 + 1)::INT AS rank, avg(o_totalprice::DOUBLE / 1e5) AS mean_cv, stddev_samp(o_totalprice::DOUBLE / 1e5) / sqrt(count(*)) AS se_cv FROM orders GROUP BY 1, 2),
b AS (SELECT id, min(mean_cv) AS best FROM c GROUP BY id), m AS (SELECT c.id, min(rank) AS low, arg_min(mean_cv, rank) AS best_cv, arg_min(se_cv, rank) AS best_se FROM c JOIN b USING (id) WHERE mean_cv <= best + 1e-12 GROUP BY c.id)
SELECT c.id, any_value(low) AS "min", min(rank) AS one_se FROM c JOIN m USING (id) WHERE mean_cv <= best_cv + best_se GROUP BY c.id
""")
def cv_rules(spark, sf_dir):
    """Both rules on mean prices by key class, for each priority, as if they were losses by rank."""
    y, out = F.col("o_totalprice").cast("double") / 1e5, None
    c = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("id"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("rank")).agg(F.avg(y).alias("mean_cv"), (F.stddev_samp(y) / F.sqrt(F.count("*"))).alias("se_cv"))
    for r in c.select("id").distinct().collect():  # five priorities
        one = selection.choose_frame(c.filter(F.col("id") == r["id"])).select(F.lit(r["id"]).alias("id"), "min", "one_se")
        out = one if out is None else out.union(one)
    return out


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", {p}::DOUBLE AS p, {sq(f'quantile_cont({c}::DOUBLE, {p})', 4)} AS value FROM {table}""" for c, table in (("l_extendedprice", "lineitem"), ("o_totalprice", "orders")) for p in (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)))
def continuous_quantiles(spark, sf_dir):
    """Order statistics of continuous columns, by counts over narrowing ranges."""
    at, rows = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0], []
    for c, name in (("l_extendedprice", "lineitem"), ("o_totalprice", "orders")):
        rows += [(c, p, v) for p, v in zip(at, exact_quantiles(t(spark, sf_dir, name), [c], at)[c])]
    return spark.createDataFrame(rows, 'column string, p double, value double').select("column", "p", q(F.col("value"), 4).alias("value"))


@query(f"SELECT {sq('quantile_cont(l_quantity, 0.5)')} AS l_quantity, {sq('quantile_cont(l_discount, 0.5)')} AS l_discount, {sq('quantile_cont(l_extendedprice, 0.5)', 2)} AS l_extendedprice FROM lineitem")
def reference_medians(spark, sf_dir):
    r = selection.reference_points(t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])
    return spark.range(1).select(q(F.lit(r["l_quantity"])).alias("l_quantity"), q(F.lit(r["l_discount"])).alias("l_discount"), q(F.lit(r["l_extendedprice"]), 2).alias("l_extendedprice"))


@query("SELECT DISTINCT p_size::INT AS size, CASE WHEN 8 * (p_size - 1) / 49.0 <= 0.16 THEN 'lower' WHEN 8 * (p_size - 1) / 49.0 >= 7.84 THEN 'upper' ELSE 'interior' END AS status FROM part")
def lambda_boundary(spark, sf_dir):
    """Where smoothing parameters from 1e-4 to 1e4, one for each part size, lie in those bounds."""
    sizes = sorted(r[0] for r in t(spark, sf_dir, "part").select("p_size").distinct().collect())  # 50 sizes
    return spark.createDataFrame(list(zip(sizes, boundary_status([10 ** (-4 + 8 * (x - 1) / 49) for x in sizes], (1e-4, 1e4)))), "size int, status string")


@query(f"""
WITH d AS (SELECT p_size::INT AS size, p_size::DOUBLE AS a, power(avg(p_retailprice::DOUBLE) / 1000, p_size) AS p FROM part GROUP BY p_size)
SELECT size, {sq('exp(greatest(least(ln(a) + greatest(least(0.25 * (ln(p) - ln(a)), ln(10.0)), -ln(10.0)), ln(1e4)), ln(1e-4)))')} AS value FROM d
""")
def lambda_damped_step(spark, sf_dir):
    """Damped and trusted steps, from each part size to a power of its mean price."""
    rows = t(spark, sf_dir, "part").groupBy("p_size").agg(F.avg(F.col("p_retailprice").cast("double")).alias("m")).orderBy("p_size").collect()  # 50 sizes
    old, goal = [float(r["p_size"]) for r in rows], [(r["m"] / 1000) ** r["p_size"] for r in rows]
    out = [(int(r["p_size"]), float(v)) for r, v in zip(rows, damped_step(old, goal, 0.25, 1.0, (1e-4, 1e4)))]
    return spark.createDataFrame(out, "size int, value double").select("size", q(F.col("value")).alias("value"))


# Fits end to end.


def _price(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_orderkey", (F.col("l_extendedprice").cast("double") / 1e4).alias("y"))


XS = ["l_quantity", "l_discount"]


def _signal(spark, sf_dir) -> DataFrame:
    """A response that follows quantity and discount together, and not tax; price stands for noise."""
    y = F.sin(F.col("l_quantity") / 8) * (1 + 10 * F.col("l_discount")) + F.col("l_extendedprice").cast("double") / 1e6
    return t(spark, sf_dir, "lineitem").select(*XS, "l_tax", "l_orderkey", y.alias("y"))


@query(f"SELECT l_returnflag, count(*) AS n, {sq('avg(l_extendedprice / 1e4::DOUBLE)')} AS mean_y, true AS close FROM lineitem GROUP BY l_returnflag")
def fit_gaussian(spark, sf_dir):
    """Flagship: surface of price over quantity and discount, scored and summarised by flag; fits are within a hundredth of the means."""
    df = _price(spark, sf_dir)
    m = TensorSpline(XS, rank=2, k=6, lam=1.0, control=Control(compute_edf=False)).fit(df)
    out = m.transform(df).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y"), F.avg("fit").alias("mean_fit"))
    return out.select("l_returnflag", "n", q(F.col("mean_y")).alias("mean_y"), (F.abs(F.col("mean_fit") - F.col("mean_y")) < 0.05 * F.col("mean_y")).alias("close"))


@query(f"SELECT count(*) AS n, {sq('avg(l_extendedprice / 1e4::DOUBLE)', 5)} AS mean_fit, true AS rss_is_deviance, true AS descends, true AS converged FROM lineitem")
def fit_gaussian_equations(spark, sf_dir):
    """The intercept's equation holds (mean fit = mean response), rows add up to the deviance, and sweeps descend to a standstill."""
    df = _price(spark, sf_dir)
    m = TensorSpline(XS, rank=2, k=6, lam=1.0, control=Control(max_sweeps=500, compute_edf=False)).fit(df)
    r = F.col("y") - F.col("fit")
    a = m.transform(df).agg(F.count("*").alias("n"), F.avg("fit").alias("mean_fit"), F.sum(r * r).alias("rss")).first()
    return truth_row(spark, n=a["n"], mean_fit=math.floor(a["mean_fit"] * 1e5 + 0.5) / 1e5, rss_is_deviance=bool(abs(a["rss"] / m.deviance - 1) < 1e-6), descends=descends(m.history), converged=m.converged)


@query("SELECT 3::BIGINT AS margins, true AS edf_adds_up, true AS within_bounds, true AS proposals_stand, true AS converged")
def fit_gaussian_cgcv(spark, sf_dir):
    """Automatic smoothing: margins' EDF add up, and at the end each margin's own GCV proposes what it has."""
    spec = TensorSpline([*XS, "l_tax"], rank=2, k=5, control=Control(outer_maxit=100, max_sweeps=200))
    p = spec.prepare(_price(spark, sf_dir))
    m = p.fit()
    problem, _ = p.problem(m.lam)
    again, lo, hi = propose(problem, m.state), *spec.control.lambda_bounds
    stand = np.abs(np.log(again / m.lam)) < 0.05
    return truth_row(spark, margins=len(m.lam), edf_adds_up=bool(abs(m.margin_edf.sum() - m.edf) < 1e-8 * m.edf), within_bounds=bool(((m.lam >= lo) & (m.lam <= hi)).all()), proposals_stand=bool(stand.all()), converged=m.converged)


@query("SELECT true AS log_scale_held, true AS product_is_one, true AS grid_takes_least_deviance")
def scale_anisotropy(spark, sf_dir):
    """The scale is held while the anisotropy moves; a log grid then takes the scale of least deviance."""
    p = TensorSpline(XS, rank=2, k=5, control=Control(cgcv_parameterization="scale_anisotropy", compute_edf=False)).prepare(_price(spark, sf_dir))
    held = p.fit()
    grid_ = (0.01, 1.0, 100.0)
    picked = p.fit(control=replace(p.spec.control, cgcv_lambda0_method="log_grid", cgcv_lambda0_grid=grid_))
    scale, omega = split_scale(held.lam)
    return truth_row(spark, log_scale_held=bool(abs(np.log(scale)) < 1e-6 or max(held.lam) > 9e3 or min(held.lam) < 1.1e-4), product_is_one=bool(abs(np.prod(omega) - 1) < 1e-9), grid_takes_least_deviance=bool(abs(np.log(split_scale(picked.lam)[0] / 0.01)) < 1e-6 and picked.deviance <= held.deviance + 1e-9))


# Bases of degree 0 are indicators of bins, so a surface of full rank that is hardly smoothed is the mean of each bin: a fit that SQL can do.

BINS = [Knots(1.0, 50.0, 5, 0), Knots(0.0, 0.1, 3, 0)]
_BIN = "least(floor((l_quantity - 1.0::DOUBLE) / 9.8::DOUBLE), 4)::INT AS q, least(floor(l_discount::DOUBLE / (0.1::DOUBLE / 3)), 2)::INT AS d"
_BIN_MEANS, _BIN_MEANS_2 = (f"SELECT q, d, count(*) AS n, {sq('avg(y)', n)} AS fit FROM (SELECT {_BIN}, l_extendedprice / 1e4::DOUBLE AS y FROM lineitem) GROUP BY q, d" for n in (3, 2))


def bin_of(column: str, knots: Knots):
    return F.least(F.floor((F.col(column) - knots.lo) / ((knots.hi - knots.lo) / knots.k)), F.lit(knots.k - 1)).cast("int")


def bin_means(model, df: DataFrame, digits: int = 3) -> DataFrame:
    out = model.transform(df).groupBy(bin_of(XS[0], BINS[0]).alias("q"), bin_of(XS[1], BINS[1]).alias("d"))
    return out.agg(F.count("*").alias("n"), q(F.avg("fit"), digits).alias("fit"))


def bin_spec(**kw) -> TensorSpline:
    return TensorSpline(XS, knots=BINS, rank=3, lam=1e-6, control=Control(compute_edf=False, max_sweeps=2000), **kw)


@query(_BIN_MEANS)
def fit_moments(spark, sf_dir):
    """Alternating sweeps on the moments of one Arrow pass."""
    df = _price(spark, sf_dir)
    return bin_means(bin_spec(backend="moments").fit(df), df)


@query(_BIN_MEANS_2)
def fit_rows(spark, sf_dir):
    """Joint sweeps over rows, a scan each, until the objective stands still to 1e-8 of itself; a mean may then be a few 1e-4 off."""
    df = _price(spark, sf_dir)
    return bin_means(bin_spec(backend="rows").fit(df), df, 2)


@query("SELECT count(*) AS n, true AS ordered, true AS width_is_se FROM (SELECT DISTINCT l_quantity, l_discount FROM lineitem)")
def predict_intervals(spark, sf_dir):
    df = _price(spark, sf_dir)
    m = TensorSpline(XS, rank=2, k=5, lam=1.0).fit(df)
    out = m.transform(df.select(*XS).distinct(), se=True, interval=0.95)
    wide = F.abs((F.col("upper") - F.col("lower")) / (2 * 1.959963984540054 * F.col("se")) - 1) < 1e-6
    return out.agg(F.count("*").alias("n"), F.bool_and((F.col("lower") < F.col("fit")) & (F.col("fit") < F.col("upper"))).alias("ordered"), F.bool_and(wide).alias("width_is_se"))


@query("SELECT count(*) AS n, round(sum(y), 2)::DOUBLE AS total_fit, true AS positive FROM (SELECT count(*) AS y FROM events GROUP BY extract(hour FROM ts), extract(day FROM ts))")
def fit_poisson(spark, sf_dir):
    """Counts by hour (cyclic) and day: with the canonical link fitted and observed totals agree."""
    df = t(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day")).agg(F.count("*").alias("y"))
    m = TensorSpline(["hour", "day"], family="poisson", rank=2, k=6, lam=1.0, cyclic=(True, False), period={"hour": (0.0, 24.0)}, control=Control(pirls_maxit=200)).fit(df)
    return m.transform(df, se=True).agg(F.count("*").alias("n"), F.round(F.sum("fit"), 2).alias("total_fit"), F.bool_and((F.col("fit") > 0) & (F.col("se") > 0)).alias("positive"))


@query("SELECT count(*) AS n, round(sum(quality), 2)::DOUBLE AS total_fit, true AS within FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL")
def fit_bernoulli(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("size"), (F.col("doc_id") % 20).cast("double").alias("place"))
    df = t(spark, sf_dir, "labels").filter("quality is not null").join(docs, "doc_id").select("doc_id", "size", "place", F.col("quality").alias("y"))
    m = TensorSpline(["size", "place"], family="bernoulli", rank=1, k=5, lam=10.0).fit(df)
    return m.transform(df).agg(F.count("*").alias("n"), F.round(F.sum("fit"), 2).alias("total_fit"), F.bool_and((F.col("fit") > 0) & (F.col("fit") < 1)).alias("within"))


@query(f"SELECT l_returnflag = 'R' AS flag, count(*) AS n, {sq('avg(l_extendedprice / 1e4::DOUBLE)', 4)} AS mean_fit FROM lineitem GROUP BY 1")
def fit_additive(spark, sf_dir):
    """A surface, a dummy and a smooth with 3 degrees of freedom: the equations of intercept and dummy make means agree in both groups."""
    df = _price(spark, sf_dir).withColumn("flag", (F.col("l_returnflag") == "R").cast("double"))
    m = TensorSpline(XS, rank=1, k=5, lam=1.0, linear=["flag"], smooth=[SmoothTerm("l_tax", k=6, target_edf=3.0)], control=Control(max_sweeps=500)).fit(df)
    if abs(m.smooth_table()[0]["edf"] - 3.0) > 1e-3 or len(m.parametric_table()) != 2:
        raise AssertionError("the smooth hasn't its degrees of freedom")
    return m.transform(df).groupBy((F.col("flag") == 1.0).alias("flag")).agg(F.count("*").alias("n"), q(F.avg("fit"), 4).alias("mean_fit"))


@query(f"""
WITH d AS (SELECT l_orderkey % 3 AS fold, l_extendedprice / 1e4::DOUBLE AS y FROM lineitem), f AS (SELECT fold, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM d GROUP BY fold), a AS (SELECT sum(n) AS n, sum(s) AS s FROM f),
l AS (SELECT fold, (ss - 2 * f.s * ((a.s - f.s) / (a.n - f.n)) + f.n * ((a.s - f.s) / (a.n - f.n)) * ((a.s - f.s) / (a.n - f.n))) / f.n AS loss FROM f, a)
SELECT r::INT AS rank, {sq('avg(loss)', 4)} AS mean_cv, {sq('stddev_samp(loss) / sqrt(3.0)', 4)} AS se_cv FROM l, range(1, 3) x(r) GROUP BY r
""")
def rank_cv_constant(spark, sf_dir):
    """Cross-validation of a constant, which SQL can follow: folds apart, training totals less the fold, losses of the left-out rows."""

    def constant(p, rank, seed):
        z = p.backend.total(Request("size"))
        return SimpleNamespace(objective=0.0, state=State([np.zeros((1, k.k, 1)) for k in p.knots], np.array([float(z["wy"] / z["w"])])))

    df = _price(spark, sf_dir).withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))
    got = selection.rank_select(df, TensorSpline(XS, k=5, lam=1.0), ranks=(1, 2), fold="fold", fit_fun=constant).frame(spark)
    return got.select("rank", q(F.col("mean_cv"), 4).alias("mean_cv"), q(F.col("se_cv"), 4).alias("se_cv"))


@query(f"""
WITH b AS (SELECT (l_orderkey % 3)::INT AS fold, {_BIN}, l_extendedprice / 1e4::DOUBLE AS y FROM lineitem), f AS (SELECT fold, q, d, count(*) AS n, sum(y) AS s, sum(y * y) AS ss FROM b GROUP BY fold, q, d),
a AS (SELECT q, d, sum(n) AS n, sum(s) AS s FROM f GROUP BY q, d), l AS (SELECT fold, sum(f.ss - 2 * f.s * (a.s - f.s) / (a.n - f.n) + f.n * ((a.s - f.s) / (a.n - f.n)) * ((a.s - f.s) / (a.n - f.n))) / sum(f.n) AS loss FROM f JOIN a ON f.q = a.q AND f.d = a.d GROUP BY fold)
SELECT 3::INT AS rank, {sq('avg(loss)', 4)} AS mean_cv, {sq('stddev_samp(loss) / sqrt(3.0)', 4)} AS se_cv FROM l
""")
def rank_cv(spark, sf_dir):
    """Cross-validated loss of the full rank: each fold's rows against the bin means of the others."""
    df = _price(spark, sf_dir).withColumn("fold", (F.col("l_orderkey") % 3).cast("int"))
    got = selection.rank_select(df, bin_spec(), ranks=(1, 3), fold="fold").frame(spark).filter("rank = 3")
    return got.select("rank", q(F.col("mean_cv"), 4).alias("mean_cv"), q(F.col("se_cv"), 4).alias("se_cv"))


@query("SELECT r::INT AS rank, (10 * r)::DOUBLE AS stored, (10 * r - r * r)::DOUBLE AS intrinsic, true AS criteria_agree FROM range(1, 4) x(r)")
def rank_profile(spark, sf_dir):
    rows = selection.rank_profile(_price(spark, sf_dir), TensorSpline(XS, k=5, lam=1.0), (1, 2, 3))
    n = t(spark, sf_dir, "lineitem").count()
    agree = lambda r: bool(abs(r["bic"] - r["aic"] - (math.log(n) - 2) * (r["edf"] + 1)) < 1e-6 * abs(r["aic"]))
    return spark.createDataFrame([(r["rank"], float(r["stored"]), float(r["intrinsic"]), agree(r)) for r in rows], "rank int, stored double, intrinsic double, criteria_agree boolean")


@query(_BIN_MEANS)
def multistart(spark, sf_dir):
    """The best of three starts."""
    df = _price(spark, sf_dir)
    return bin_means(selection.multistart(df, bin_spec(), 3)[0], df)


@query("SELECT 'l_quantity' AS first, true AS keeps_quantity, 2::BIGINT AS lambdas")
def margin_activity(spark, sf_dir):
    a = selection.activity_path(_signal(spark, sf_dir), TensorSpline([*XS, "l_tax"], rank=2, k=5, lam=1.0), lambdas=(10.0, 1.0), folds=3)
    return spark.createDataFrame([(a.order[0], "l_quantity" in a.selected, len({r["lambda"] for r in a.path}))], "first string, keeps_quantity boolean, lambdas long")


_THREE = {"l_quantity": Knots(1.0, 50.0, 3, 0), "l_discount": Knots(0.0, 0.1, 3, 0), "l_tax": Knots(0.0, 0.08, 3, 0)}
_CELL = {c: f"least(floor(({c}::DOUBLE - {k.lo!r}::DOUBLE) / {(k.hi - k.lo) / 3!r}::DOUBLE), 2)" for c, k in _THREE.items()}
_WITHIN = "(SELECT sum(ss) FROM (SELECT sum(y * y) - sum(y) * sum(y) / count(*) AS ss FROM b GROUP BY {}))"


@query("WITH b AS (SELECT l_extendedprice / 1e4::DOUBLE + l_discount::DOUBLE * l_quantity AS y, " + ", ".join(f"{v} AS b{i}" for i, v in enumerate(_CELL.values())) + " FROM lineitem) " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", {sq(f"({_WITHIN.format(', '.join(f'b{j}' for j in range(3) if j != i))} - {_WITHIN.format('b0, b1, b2')}) / (SELECT count(*) FROM b)", 4)} AS delta""" for i, c in enumerate(_CELL)))
def margin_drop(spark, sf_dir):
    """The deviance that a column is worth: here, sums of squares within bins of two columns less those within bins of three."""
    df = t(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in _THREE], (F.col("l_extendedprice").cast("double") / 1e4 + F.col("l_discount").cast("double") * F.col("l_quantity").cast("double")).alias("y"))
    rows, n = selection.drop_test(df, TensorSpline(list(_THREE), rank=3, knots=list(_THREE.values()), lam=1e-6, control=Control(max_sweeps=500))), df.count()
    return spark.createDataFrame([(r["column"], float(r["delta_deviance"] / n)) for r in rows], '`column` string, delta double').select("column", q(F.col("delta"), 4).alias("delta"))


@query(f"""
WITH m AS (SELECT sum(y * y) - sum(y) * sum(y) / count(*) AS ss, count(*) AS n FROM (SELECT {_BIN}, l_extendedprice / 1e4::DOUBLE AS y FROM lineitem) GROUP BY q, d), w AS (SELECT sum(ss) AS rss, count(*)::DOUBLE AS df, sum(n)::DOUBLE AS n FROM m)
SELECT 1::INT AS margin, 61::BIGINT AS points, {sq('df', 2)} AS edf_at_least, {sq('n * rss / ((n - df) * (n - df))', 4)} AS gcv_at_least, true AS edf_falls FROM w
""")
def gcv_curves(spark, sf_dir):
    """Curves of each core's smoothing, the rest held. The first core spans all bins: at its least it has a degree of freedom for each of them, and leaves their sums of squares."""
    spec = bin_spec(backend="moments")
    p = spec.prepare(_price(spark, sf_dir))
    m = p.fit()
    rows = frozen_curves(p.problem(m.lam)[0], m.state)
    by = {k: sorted((r for r in rows if r["margin"] == k), key=lambda r: r["lambda"]) for k in (1, 2)}
    falls = all(b["edf"] <= a["edf"] + 1e-9 for own in by.values() for a, b in zip(own, own[1:]))
    out = spark.createDataFrame([(1, len(by[1]), float(by[1][0]["edf"]), float(by[1][0]["gcv"]), falls)], "margin int, points long, edf_at_least double, gcv_at_least double, edf_falls boolean")
    return out.select("margin", "points", q(F.col("edf_at_least"), 2).alias("edf_at_least"), q(F.col("gcv_at_least"), 4).alias("gcv_at_least"), "edf_falls")


@query(_BIN_MEANS)
def dense_baseline(spark, sf_dir):
    """The dense solve of the whole tensor."""
    df = _price(spark, sf_dir)
    return bin_means(grid.fit_dense(df, XS, knots=BINS, lam=1e-6), df)


@query(f"SELECT s AS smoothing, 4::BIGINT AS coefficients, l_returnflag = 'R' AS flag, count(*) AS n, {sq('avg(l_extendedprice / 1e4::DOUBLE)', 4)} AS mean_fit FROM lineitem, (VALUES ('fixed'), ('cGCV')) v(s) GROUP BY s, l_returnflag = 'R'")
def profiled_null(spark, sf_dir):
    """Null space and a linear term unshrunk beside a train: at any smoothing the equations of both make fitted means those of the rows."""
    df = _price(spark, sf_dir).withColumn("flag", (F.col("l_returnflag") == "R").cast("double"))
    out = None
    for name, lam in (("fixed", 1.0), ("cGCV", "cGCV")):
        f = null_space.fit_profiled_null(df, TensorSpline(XS, rank=2, k=5, lam=lam, linear=["flag"], backend="cells"))
        got = f.transform(df).groupBy((F.col("flag") == 1.0).alias("flag")).agg(F.count("*").alias("n"), q(F.avg("fit"), 4).alias("mean_fit"))
        got = got.select(F.lit(name).alias("smoothing"), F.lit(len(f.coef)).cast("long").alias("coefficients"), "flag", "n", "mean_fit")
        out = got if out is None else out.union(got)
    return out


@query(f"""
WITH b AS (SELECT l_extendedprice::DOUBLE AS x, l_extendedprice / 1e4::DOUBLE + l_discount::DOUBLE AS y, {_BIN} FROM lineitem), m AS (SELECT q, d, sum(y * y) - sum(y) * sum(y) / count(*) AS ss, count(*) AS n FROM b GROUP BY q, d),
a AS (SELECT count(*)::DOUBLE AS n, sum(y * y) - sum(y) * sum(y) / count(*) AS ss FROM b), w AS (SELECT sum(ss) AS rss, count(*)::DOUBLE AS df, sum(n)::DOUBLE AS n FROM m)
SELECT 'least' AS smoothing, {sq('df', 4)} AS edf, {sq('rss / n', 4)} AS mean_rss, {sq('n * rss / ((n - df) * (n - df))', 4)} AS gcv FROM w
UNION ALL SELECT 'most', 1.0::DOUBLE, {sq('ss / n', 4)}, {sq('n * ss / ((n - 1) * (n - 1))', 4)} FROM a
""")
def full_tensor_gcv(spark, sf_dir):
    """Exact degrees of freedom and GCV of the full tensor: bins without smoothing have one for each bin, with the most there is one in all (order 1)."""
    df = t(spark, sf_dir, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in XS], (F.col("l_extendedprice").cast("double") / 1e4 + F.col("l_discount").cast("double")).alias("y"))
    full = lab.FullTensor.of(df, TensorSpline(XS, knots=BINS, penalty_order=1))
    rows = [(name, r["edf"], r["rss"] / full.n, r["gcv"]) for name, r in (("least", full.at((1e-7, 1e-7))), ("most", full.at((1e11, 1e11))))]
    return spark.createDataFrame(rows, "smoothing string, edf double, mean_rss double, gcv double").select("smoothing", *[q(F.col(c), 4).alias(c) for c in ("edf", "mean_rss", "gcv")])


_PRICE_BIN = "least(floor(l_extendedprice::DOUBLE / 22000.0::DOUBLE), 4)::INT AS q, least(floor(l_discount::DOUBLE / (0.1::DOUBLE / 3)), 2)::INT AS d"


@query(f"""
WITH b AS (SELECT l_quantity::DOUBLE AS y, {_PRICE_BIN} FROM lineitem), m AS (SELECT sum(y * y) - sum(y) * sum(y) / count(*) AS ss, count(*) AS n FROM b GROUP BY q, d),
w AS (SELECT sum(ss) AS rss, sum(n)::DOUBLE AS n, count(*)::DOUBLE AS df FROM m)
SELECT n::BIGINT AS n, {sq('rss / n', 4)} AS mean_rss, true AS df_within_error FROM w
""")
def global_gcv(spark, sf_dir):
    """Monte Carlo degrees of freedom over a continuous column, by probes projected to moments: next to no smoothing leaves the bins' own sums of squares and one degree for each bin."""
    df = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("disc"), F.col("l_quantity").cast("double").alias("y"))
    knots = [Knots(0.0, 110_000.0, 5, 0), Knots(0.0, 0.1, 3, 0)]
    spec = TensorSpline(["price", "disc"], knots=knots, rank=3, backend="moments", control=Control(compute_edf=False))
    r, n = lab.gdf_mc(df, spec, 1e-5, probes=8, key=["l_orderkey", "l_linenumber"], sweeps=500), df.count()
    used = df.select(bin_of("price", knots[0]), bin_of("disc", knots[1])).distinct().count()
    return spark.createDataFrame([(n, r["rss"] / n, bool(abs(r["gdf"] - used) < 4 * (2 * used / 8) ** 0.5))], "n long, mean_rss double, df_within_error boolean").select("n", q(F.col("mean_rss"), 4).alias("mean_rss"), "df_within_error")


@query("SELECT doc_id, dense_rank() OVER (ORDER BY lang)::INT AS fold_id FROM documents WHERE lang IS NOT NULL")
def cv_folds_from_labels(spark, sf_dir):
    return selection.normalise_folds(t(spark, sf_dir, "documents").select("doc_id", "lang"), "lang").select("doc_id", "fold_id")


@query("SELECT sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END)::BIGINT AS quality, sum(CASE WHEN toxic IS NULL THEN 1 ELSE 0 END)::BIGINT AS toxic FROM labels")
def missing_values(spark, sf_dir):
    return io.missing_counts(t(spark, sf_dir, "labels"), ["quality", "toxic"])


@query("SELECT l_returnflag, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END)::DOUBLE AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::DOUBLE AS r FROM lineitem GROUP BY 1")
def factor_dummies(spark, sf_dir):
    df, names = io.dummies(t(spark, sf_dir, "lineitem").select("l_returnflag"), "l_returnflag", ["A", "N", "R"])
    return df.groupBy("l_returnflag").agg(*[F.sum(n).alias(n[-1].lower()) for n in names])


_AX1, _AX1T = basis_sql(Knots(1.0, 50.0, 5), "(SELECT DISTINCT l_quantity::DOUBLE AS x FROM lineitem)", "x", "x", "a")
_AX2, _AX2T = basis_sql(Knots(0.0, 0.1, 4), "(SELECT DISTINCT l_discount::DOUBLE AS x FROM lineitem)", "x", "x", "b")


@query(f"""
WITH {_AX1}, {_AX2}, g AS (SELECT [{', '.join(f'a{i} * b{j}' for i in range(1, 6) for j in range(1, 5))}] AS x, row_number() OVER () AS id FROM {_AX1T} p, {_AX2T} q),
u AS (SELECT id, k, x[k] AS v FROM g, range(1, 21) r(k))
SELECT a.k::INT AS i, b.k::INT AS j, {sq('sum(a.v * b.v)', 8)} AS value FROM u a JOIN u b ON a.id = b.id GROUP BY a.k, b.k
""")
def gram_array(spark, sf_dir):
    """The Gram matrix of the grid of all quantities and discounts from its axes alone, its response the mean prices."""
    df = _price(spark, sf_dir).groupBy(*[F.col(c).cast("double").alias(c) for c in XS]).agg(F.avg("y").alias("y"))
    axes = {c: sorted(r[0] for r in df.select(c).distinct().collect()) for c in XS}  # 50 and 11 values
    p = grid.prepare_array(df, axes, TensorSpline(XS, knots=[Knots(1.0, 50.0, 5), Knots(0.0, 0.1, 4)]))
    m = p.backend.m["S"]
    return spark.createDataFrame([(i + 1, j + 1, float(m[i, j])) for i in range(20) for j in range(20)], "i int, j int, value double").select("i", "j", q(F.col("value"), 8).alias("value"))


@query(f"""
WITH e AS (SELECT event_id, value::DOUBLE AS value, (event_id % 4)::DOUBLE AS y FROM events), m AS (SELECT *, exp(greatest(least({_ETA}, 20.0), -20.0)) AS mu FROM e)
SELECT {sq('sum(mu - y * ' + _ETA + ') / count(*)')} AS nll, {sq('sum(2 * (CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu))) / count(*)')} AS deviance FROM m
""")
def glm_objective(spark, sf_dir):
    df = t(spark, sf_dir, "events").select(F.col("value").cast("double").alias("value"), (F.col("event_id") % 4).cast("double").alias("y"))
    mu = fam_.inverse_link("poisson", _eta())
    return df.agg(q(F.sum(mu - F.col("y") * _eta()) / F.count("*")).alias("nll"), q(F.sum(fam_.unit_deviance("poisson", F.col("y"), mu)) / F.count("*")).alias("deviance"))


@query(f"""
WITH b AS (SELECT y, avg(y) OVER (PARTITION BY q, d) AS m, avg(y) OVER () AS a FROM (SELECT {_BIN}, l_extendedprice / 1e4::DOUBLE AS y FROM lineitem))
SELECT m AS method, {sq('sqrt(avg((y - m) * (y - m)))', 4)} AS rmse FROM b, (VALUES ('dense'), ('tt3'), ('oracle')) v(m) GROUP BY v.m
""".replace("SELECT m AS method", "SELECT v.m AS method").replace("(y - m) * (y - m)", "(y - b.m) * (y - b.m)"))
def compare_baselines(spark, sf_dir):
    """The dense solve, a train of full rank and the oracle's choice, all of them the means of bins, against the rows."""
    df = _price(spark, sf_dir)
    rows = grid.compare(df, XS, "y", lam=1e-6, ranks=(3,), select=False, knots=BINS)
    return spark.createDataFrame([(r["method"], float(r["rmse"])) for r in rows], "method string, rmse double").select("method", q(F.col("rmse"), 4).alias("rmse"))


@query("SELECT s AS scenario, d::BIGINT AS d, n::BIGINT AS n, true AS noise_as_named FROM (SELECT count(*) AS n FROM customer), (VALUES ('smooth_smooth', 2), ('smooth_rough', 2), ('strong_aniso', 2), ('weak_signal', 2), ('smooth_smooth', 3), ('strong_aniso', 3), ('smooth_smooth', 5), ('strong_aniso', 5)) v(s, d)")
def lab_designs(spark, sf_dir):
    """Laboratory designs with a row for each customer."""
    out, n = None, t(spark, sf_dir, "customer").count()
    for s, d in _LAB:
        sigma = surfaces.lab_truth(s, d)[1]
        noise = F.abs(F.stddev_samp(F.col("y") - F.col("f")) / sigma - 1) < 0.2
        r = surfaces.lab_design(spark, s, n, d).agg(F.lit(s).alias("scenario"), F.lit(d).cast("long").alias("d"), F.count("*").alias("n"), noise.alias("noise_as_named"))
        out = r if out is None else out.union(r)
    return out


@query("SELECT margin, true AS within_bounds FROM (VALUES ('l_quantity'), ('l_discount')) v(margin)")
def joint_smoothing(spark, sf_dir):
    o = lab.optimise(_price(spark, sf_dir), TensorSpline(XS, rank=1, k=5, lam=1.0))
    return spark.createDataFrame([(x, bool(v > 0 and np.isfinite(v))) for x, v in zip(XS, o["lambda"])], "margin string, within_bounds boolean")


@query("SELECT margin, true AS inside_box, true AS named, true AS gcv_is_least_of_final, true AS fitted_there FROM (VALUES ('l_quantity'), ('l_discount')) v(margin)")
def adaptive_smoothing(spark, sf_dir):
    """The adaptive search over all rows, with smaller budgets of points and probes than its defaults (which took 78 s on sf0.01)."""
    o = lab_adaptive.optimise_adaptive(_price(spark, sf_dir), TensorSpline(XS, rank=1, k=5, lam=1.0), batches=(16, 16), probes=5, probes_final=10, starts=2, local=20)
    names = ("effectively_unpenalized", "weakly_identified", "boundary_unresolved", "well_identified")
    least = bool(o.gcv <= min(r["gcv"] for r in o.final))
    rows = [(x, bool(lo <= v <= hi), label in names, least, bool(abs(np.log10(lam) - v) < 1e-9)) for x, v, (lo, hi), label, lam in zip(XS, o.log10_lambda, o.box, o.identifiability, o.model.lam)]
    return spark.createDataFrame(rows, "margin string, inside_box boolean, named boolean, gcv_is_least_of_final boolean, fitted_there boolean")
