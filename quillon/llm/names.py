"""Names of helper columns that no column of a user's table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the table has no column of that name, in whatever case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
