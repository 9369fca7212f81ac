"""Scalar expressions and aggregates as Spark columns."""
