"""Queries over streams.

The dialect has no windows, joins or aggregates, so nothing here keeps state: filters and
projections run on a streaming DataFrame as they do on a table. Sorting and limits have no
meaning on an unbounded input and are rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillon.errors import SqlTypeError
from quillon.operators.frame import Frame
from quillon.plans.binder import Binder
from quillon.plans.parser import parse


def stream(sql: str, df: DataFrame) -> DataFrame:
    """A query of filter and projection over a streaming DataFrame."""
    frame = Frame.of(df)
    query = Binder(frame.schema).bind(parse(sql))
    if query.order_by or query.limit is not None:
        raise SqlTypeError("ORDER BY and LIMIT are not defined over a stream")
    return frame.run(query).df
