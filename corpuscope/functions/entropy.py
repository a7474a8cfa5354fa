"""Shannon entropy of a string, computed natively with higher-order array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(s: Column) -> Column:
    """-sum(p * log2 p) over the characters of ``s``; '' and null give 0.0.

    Stays inside the JVM (no UDF): characters are the elements of ``split(s, '')``, the distinct
    ones are folded with ``aggregate``. Cost is O(len * distinct) per string, fine for tokens.
    """
    chars = F.split(s, "")
    n = F.size(chars).cast("double")

    def step(acc, c):
        p = F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
        return acc - p * F.log2(p)

    ent = F.aggregate(F.array_distinct(chars), F.lit(0.0), step)
    return F.when(s.isNull() | (F.length(s) == 0), F.lit(0.0)).otherwise(F.abs(ent))
