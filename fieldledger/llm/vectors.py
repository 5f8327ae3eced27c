"""Vectors as the operators on `embeddings` read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector with at least one component and none that is null, NaN or infinite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def usual_length(df: DataFrame, column: str = "vector") -> int:
    """The most frequent length (of equal ones the greater), 0 for no rows. Vectors of another length have no distance
    to these, so the operators leave them out."""
    row = df.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return int(row["size"]) if row else 0
