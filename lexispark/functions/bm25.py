"""BM25 with k1 = 1.2 and b = 0.75."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def score(tf: Column, length: Column, n: Column, df: Column, total_length: Column) -> Column:
    """One term's share of a document's score. The average length counts all documents, and 0 counts as 1."""
    mean = F.when(total_length == 0, F.lit(1.0)).otherwise(total_length / n)
    return idf(n, df) * ((tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean)))


def score_value(tf: float, length: float, n: float, df: float, total_length: float) -> float:
    """The same for numbers on the driver."""
    mean = total_length / n if total_length else 1.0
    return math.log(1 + (n - df + 0.5) / (df + 0.5)) * ((tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean)))
