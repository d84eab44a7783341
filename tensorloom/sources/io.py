"""Readers, writers, formula and grid scans, and models as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "csv", "json", "avro", "delta", "jdbc", "table")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Any source that Spark reads; csv and json need a schema, so that no pass is spent on guessing one."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}")
    if fmt == "table":
        return spark.table(path)
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def scan(df: DataFrame, x: list[str], y: str, keep: list[str] = ()) -> DataFrame:
    """Covariates and response as doubles, in order, and only the columns named."""
    return df.select(*[F.col(c) for c in keep], F.col(y).cast("double").alias(y), *[F.col(c).cast("double").alias(c) for c in x])


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: nulls and NaNs of each column."""
    return df.agg(*[F.sum((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("long")).alias(c) for c in columns])


def formula(text: str) -> tuple[str, list[str]]:
    """"y ~ a + b" -> (y, [a, b]); an intercept term is left out."""
    y, _, right = text.partition("~")
    x = [t.strip() for t in right.split("+")]
    if not y.strip() or not right.strip():
        raise ValueError("a formula is y ~ x1 + x2")
    return y.strip(), [t for t in x if t not in ("", "0", "1", "-1")]


def dummies(df: DataFrame, column: str, levels: list | None = None, drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """0/1 columns of a factor. Levels come from distinct values, which are taken to be few, if none are given."""
    levels = levels if levels is not None else sorted(r[0] for r in df.select(column).distinct().limit(1001).collect())
    if len(levels) > 1000:
        raise ValueError(f"{column} has over 1000 levels")
    use = levels[1:] if drop_first else levels
    names = [f"{column}_{v}" for v in use]
    return df.select("*", *[(F.col(column) == F.lit(v)).cast("double").alias(n) for v, n in zip(use, names, strict=True)]), names


def save_model(spark: SparkSession, model, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str):
    from ..operators.spline import TensorSplineModel

    return TensorSplineModel.from_json(spark.read.text(path).first()["value"])
