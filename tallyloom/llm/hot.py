"""Joins by keys of which a single one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.scratch import materialize

#: Rows of a key from which it is split, which is about what a slice then holds; keys that are split at most, the largest first.
SLICE_ROWS, MOST_KEYS = 1000, 100_000


def spread_join(many: DataFrame, few: DataFrame, on: Sequence[str], by: Sequence[str], counts: DataFrame | None = None, how: str = "inner", slice_rows: int | None = None) -> DataFrame:
    """``many.join(few, on, how)`` (inner or left) in which keys with over ``slice_rows`` rows of ``many`` are split by a
    hash of ``by`` into slices, for each of which the rows of ``few`` are repeated.

    ``counts`` (the columns ``on`` and n) saves counting ``many``. The split keys are broadcast: MOST_KEYS of them at
    most, so that a key left whole holds less than one in MOST_KEYS of all rows. The result does not depend on the split.
    """
    rows = slice_rows or SLICE_ROWS
    counts = counts if counts is not None else many.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    large = counts.where(F.col("n") > rows).select(*on, F.ceil(F.col("n") / rows).cast("int").alias("__parts")).orderBy(F.desc("__parts"), *on).limit(MOST_KEYS)
    large = materialize(large, "hot-keys")
    if large.isEmpty():
        return many.join(few, list(on), how)
    slice_of = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*by), "__parts").cast("int")).otherwise(0)
    left = many.join(F.broadcast(large), list(on), "left").withColumn("__slice", slice_of).drop("__parts")
    right = few.join(F.broadcast(large), list(on), "left").withColumn("__slice", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*on, "__slice"], how).drop("__slice")
