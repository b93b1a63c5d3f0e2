"""Name intermediate results so that they are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns the optimizer does not copy to where they are used.

    Plain projections are merged, and filters move below them, each time repeating the
    expression; long ones multiply. A one-row generator stops both, at no shuffle.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
