"""Vectors as exact integers, for the operators on embeddings that compare integer scores and distances."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Squared length (of the components times 256) below which float64 holds every sum of products and every squared distance exactly.
EXACT = float(1 << 44)


def whole(vector: str) -> Column:
    """The components times 256, floored, as array<int>; null for a null vector, one with a null or non-finite component, or one of squared length EXACT or more."""
    x = F.transform(F.col(vector), lambda x: x.cast("double") * 256)
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float(1 << 22)))
    short = F.aggregate(x, F.lit(0.0), lambda a, y: a + F.pow(F.abs(y) + 1, F.lit(2))) < EXACT
    return F.when(F.col(vector).isNotNull() & fine, F.when(short, F.transform(x, lambda y: F.floor(y).cast("int"))))


def matrix(column):
    """An Arrow column of lists of one length as float64 [rows, length]."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), width) if width else np.zeros((len(column), 0))
