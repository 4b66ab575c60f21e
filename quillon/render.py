"""Results as text tables."""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal

from quillon.operators.frame import Frame


def cell(value: object) -> str:
    """A value as the engine prints it: plain decimal digits, lower-case truth values, NULL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        if math.isinf(value):
            return "inf" if value > 0 else "-inf"
        text = format(Decimal(repr(value)), "f")
        return text.removesuffix(".0")
    return str(value)


def table(names: list[str], rows: Iterable[Iterable[object]]) -> str:
    """A header, a rule and padded cells; widths count bytes, padding counts characters."""
    lines = [names, *[[cell(v) for v in r] for r in rows]]
    widths = [max(len(line[i].encode()) for line in lines) for i in range(len(names))]
    said = ["|" + "".join(f" {c:<{w}} |" for c, w in zip(line, widths, strict=True)) for line in lines]
    said.insert(1, "|" + "".join("-" * (w + 2) + "|" for w in widths))
    return "\n".join(said) + "\n"


def render(frame: Frame) -> str:
    """All rows of a result as a text table."""
    return table(frame.schema.names, frame.collect())
