"""Tensor-train penalised-spline analytics on Spark DataFrames."""
