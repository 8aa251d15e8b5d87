"""Seeded samples and bounded scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 4242


def seeded_sample(df: DataFrame, key: tuple[str, ...], n: int = 200, seed: int = SEED) -> DataFrame:
    """n rows, the same whatever the partitions: the least by a hash of seed and key; a top-n, not a sort."""
    mark = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key)))
    return df.orderBy(mark, *key).limit(n)


def lookup_scan(df: DataFrame, key: tuple[str, ...], most: int = 1001) -> DataFrame:
    """A small table as a whole, in key order, up to `most` rows."""
    return df.orderBy(*key).limit(most)
