"""Parquet tables: columns of the engine's types, or of types that widen to them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession

from quillon.errors import translating
from quillon.functions import lowering
from quillon.operators.frame import Frame
from quillon.plans.types import FROM_SPARK


def read_parquet(spark: SparkSession, path: str, leave_out: bool = False) -> Frame:
    """A Parquet file or folder.

    A column of a type that the engine does not have (an array, a decimal) is a SchemaError,
    unless ``leave_out`` asks for the others alone.
    """
    with translating():
        df = spark.read.parquet(path)
        if leave_out:
            df = df.select(*[lowering.name(f.name) for f in df.schema.fields if type(f.dataType) in FROM_SPARK])
        return replace(Frame.of(df), stored_order=True)
