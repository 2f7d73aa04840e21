"""Exact selection of the smallest keys without sorting all rows or gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from groundcheck.lineage import cut_lineage

#: Bits of the key that one pass settles; a pass brings at most 2 ** STEP counts to the driver.
STEP = 12
BITS = 60


def seeded_key(seed: int, *columns: str) -> Column:
    """A key of 60 bits from the digits of a seed and whole-number columns."""
    text = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("bigint")


def first_n(df: DataFrame, n: int, key: Column, ties: tuple[str, ...]) -> DataFrame:
    """The ``n`` rows of the smallest ``key`` (0 to 2**60 - 1); equal keys go by the columns ``ties``.

    The n-th smallest key is found by refining a histogram: each pass counts the rows of one bin by the next
    ``STEP`` bits, so its work is one aggregation over a shrinking part.  Rows below that key are filtered out of
    the table in place; only rows that share it, a handful for a hashed key, are put in order.
    """
    if n <= 0:
        return df.limit(0)
    rows = cut_lineage(df.withColumn("_key", key))
    prefix, wanted = 0, n
    for shift in range(BITS - STEP, -1, -STEP):
        part = rows.filter(F.shiftright("_key", shift + STEP) == prefix)
        counts = part.groupBy(F.shiftright("_key", shift).alias("bin")).count().collect()
        for row in sorted(counts, key=lambda r: r["bin"]):
            if wanted <= row["count"]:
                prefix = row["bin"]
                break
            wanted -= row["count"]
        else:
            return rows.drop("_key")  # fewer than n rows
    below = rows.filter(F.col("_key") < prefix)
    level = rows.filter(F.col("_key") == prefix).orderBy(*ties).limit(wanted)
    return below.unionByName(level).drop("_key")
