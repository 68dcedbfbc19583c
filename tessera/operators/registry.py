"""Registries: last record wins, lineage through parent pointers, missing references, leaderboards, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import written


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key in the given order; an aggregate with partial results, so that no key is hot. Null keys are left out."""
    names = df.columns
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("row")).select("row.*")


def missing(df: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """Rows whose reference is set but not known."""
    return df.filter(F.col(column).isNotNull()).join(known.select(F.col(name).alias(column)).distinct(), column, "left_anti").select(*df.columns)


def lineage(df: DataFrame, key: str, parent: str, most: int = 40) -> DataFrame:
    """root and depth of each node: the end of its chain of parents and the steps there.

    Pointers are doubled each round, so a chain of n nodes takes log2(n) joins. A parent that is not a node
    ends the chain there; nodes on or behind a cycle have null root and depth.
    """
    nodes = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("up"))
    state = nodes.join(nodes.select(F.col("node").alias("up"), F.lit(1).alias("is_node")), "up", "left").select("node", F.when(F.col("is_node").isNotNull(), F.col("up")).alias("up"))
    state = written(state.select("node", F.coalesce("up", "node").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("depth"), F.col("up").isNull().alias("done")))
    open_before = None
    for round_ in range(most):
        still_open = state.filter("NOT done").count()
        if not still_open or round_ >= 32 and still_open == open_before:
            break  # all chains have ended, or what is left runs in circles
        open_before = still_open
        far = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        step = state.join(far, "at").select("node", F.when(F.col("done"), F.col("at")).otherwise(F.col("next")).alias("at"), F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("more")).alias("depth"), (F.col("done") | F.col("ends")).alias("done"))
        state = written(step)
    return state.select(F.col("node").alias(key), F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).cast("bigint").alias("depth"))


def leaderboard(df: DataFrame, scores: list[str], first: str, n: int) -> DataFrame:
    """The n best rows by the scores in turn, a missing score counting as -1, ties by ``first``."""
    return df.orderBy(*[F.coalesce(F.col(c), F.lit(-1.0)).desc() for c in scores], first).limit(n)


def pivot_mean(df: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    """Mean of the metric for each row and each of the stated column values."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(metric))


def full_grid(df: DataFrame, row: str, column: str, metric: str) -> DataFrame:
    """Mean for every pair of a row and a column value, 0 where there is none; both are label sets of bounded size."""
    made = df.groupBy(row, column).agg(F.avg(metric).alias("mean"))
    rows = made.select(row).distinct().agg(F.sort_array(F.collect_set(row)).alias("r"))
    return made.select(column).distinct().withColumn("k", F.lit(1)).join(rows.withColumn("k", F.lit(1)), "k").select(F.explode("r").alias(row), column).join(made, [row, column], "left").fillna(0.0, ["mean"])
