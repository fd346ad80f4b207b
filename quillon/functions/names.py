"""Column names that don't clash with a caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def quiet_columns(df: DataFrame, *stems: str) -> list[str]:
    """Names for working columns that the table doesn't use."""
    used, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"__{stem}"
        while name in used:
            name += "_"
        used.add(name)
        out.append(name)
    return out
