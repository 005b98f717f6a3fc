"""Column names that a caller's table does not use."""

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` starts with it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name
