"""Mixture weights: normalization, report, and the weighted choice of a source for each sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def valid_weight(column: str = "weight"):
    return F.when(F.isnan(column) | F.col(column).isNull() | (F.col(column) < 0), 0.0).otherwise(F.col(column))


def normalized(df: DataFrame, group: str, weight: str = "weight") -> DataFrame:
    """``share``: the weight over the sum in its group; null, NaN and negative weights count 0, a sum of 0 gives null."""
    w = valid_weight(weight)
    whole = F.sum(w).over(W.partitionBy(group))
    return df.withColumn("share", F.when(whole > 0, w / whole))


def choose(df: DataFrame, key: str, shares: DataFrame, seed: int = 42) -> DataFrame:
    """A source for each row by its key's seeded hash in [0, 1) against the cumulative shares (ordered by source).

    The shares are a configuration; their cumulative bounds become one array that every row carries.
    """
    upto = shares.filter("share > 0").withColumn("upto", F.sum("share").over(W.partitionBy(F.lit(0)).orderBy("source").rowsBetween(W.unboundedPreceding, 0)))
    table = upto.agg(F.sort_array(F.collect_list(F.struct("upto", "source"))).alias("bounds"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    drawn = df.withColumn("u", u).join(F.broadcast(table))
    return drawn.withColumn("source", F.coalesce(F.try_element_at(F.filter("bounds", lambda b: F.col("u") < b["upto"]), F.lit(1))["source"], F.element_at("bounds", -1)["source"])).drop("bounds")
