"""Names of an operator's own columns, beside those of a table it does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own(rows: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores before it as it takes not to be one of the table's own (case aside)."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
