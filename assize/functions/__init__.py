"""Scalar functions, all as Spark column expressions."""
