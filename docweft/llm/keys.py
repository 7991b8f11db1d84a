"""Row identifiers on their way through Python.

pandas turns a batch of whole numbers with a null into floats, which hold no number above
2**53 exactly; so whole numbers travel as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DataType, IntegralType


def carried(c: Column, kind: DataType) -> Column:
    return c.cast("string") if isinstance(kind, IntegralType) else c


def restored(c: Column, kind: DataType) -> Column:
    return c.cast(kind) if isinstance(kind, IntegralType) else c


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have in any case, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
