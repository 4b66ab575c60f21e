"""Typed expressions as Spark columns."""
