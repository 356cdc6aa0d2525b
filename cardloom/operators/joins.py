"""Joins that hold where keys are null or hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Parts over which rows without a key are spread.
PARTS = 4096


def left_join(left: DataFrame, right: DataFrame, key: str, *spread: str) -> DataFrame:
    """A left join on key in which rows without a key, which meet nothing, are spread by other columns.

    A plain one would send all of them to one task.
    """
    lone = F.when(F.col(key).isNull(), 1 + F.pmod(F.xxhash64(*spread), F.lit(PARTS))).otherwise(F.lit(0).cast("bigint"))
    return left.withColumn("__lone", lone).join(right.withColumn("__lone", F.lit(0).cast("bigint")), [key, "__lone"], "left").drop("__lone")
