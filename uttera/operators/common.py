"""Plan-shaping helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A filter on a derived column is pushed below the projection with its whole expression
    written out again at every use. Passing the values through a one-element generator
    stops that, so costly text expressions are not repeated.
    """
    bundle = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(bundle)))
