"""Health of outputs and metric series: diversity, streaks, saturation, drops under a peak, differences of stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import ordered


def ngram_diversity(text: Column, n: int = 3) -> Column:
    """Distinct n-word windows over all of them; null for a text without words."""
    words = X.words(text)
    total = F.greatest(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) > 0, F.size(X.window_hashes(words, n)) / total)


def output_diversity(df: DataFrame, by: str, output: str, alarm: float = 0.3) -> DataFrame:
    """Distinct outputs over all, mean length, and whether the share is under the alarm. Hashes are counted, not texts."""
    rows = df.filter(F.col(output).isNotNull()).select(F.col(by), F.md5(F.col(output).cast("binary")).alias("h"), F.length(output).alias("n"))
    per_text = rows.groupBy(by, "h").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    out = per_text.groupBy(by).agg(F.sum("c").alias("n_outputs"), F.count(F.lit(1)).alias("n_distinct"), (F.sum(F.col("c") * F.col("n")) / F.sum("c")).alias("mean_length"))
    return out.withColumn("share", F.col("n_distinct") / F.col("n_outputs")).withColumn("alarm", F.col("share") < alarm)


def series_health(df: DataFrame, series: str, order: list[str], value: str, drop: float, streak: int, low: float, width: int = ordered.WIDTH) -> DataFrame:
    """One row per series: first, last, best, explosion (over twice the first, or NaN), a drop under the running peak for ``streak`` points on end, and a streak of values under ``low``.

    No task holds more than about ``width`` rows of a series.
    """
    rows = ordered.positions(df.filter(F.col(value).isNotNull()), series, order, width)
    peaks = ordered.running(rows, {"__peak": (F.max, F.col(value))}, width)
    frame = W.partitionBy("__k", "__chunk").orderBy("__i").rowsBetween(-(streak - 1), 0)
    full = F.count(F.lit(1)).over(frame) == streak
    near = ordered.overlapped(peaks, streak - 1, width)
    near = near.withColumn("__fallen", full & F.bool_and(F.col("__peak") - F.col(value) > drop).over(frame)).withColumn("__short", full & F.bool_and(F.col(value) < low).over(frame)).filter("__own")
    out = near.groupBy(series).agg(F.count(F.lit(1)).alias("n"), F.min_by(value, "__i").alias("first"), F.max_by(value, "__i").alias("last"), F.max(value).alias("best"), F.bool_or(F.isnan(value)).alias("__nan"), F.bool_or("__fallen").alias("fell"), F.bool_or("__short").alias("stayed_low"))
    # The largest value decides whether any is over twice the first; NaN counts as largest.
    return out.select(series, "n", "first", "last", "best", (F.col("__nan") | (F.col("best") > 2 * F.col("first"))).alias("exploded"), "fell", "stayed_low")


def stage_delta(df: DataFrame, key: str, stage: str, early: str, late: str, metric: str) -> DataFrame:
    """Mean of the later stage minus that of the earlier one for each key that has both."""
    means = [F.avg(F.when(F.col(stage) == s, F.col(metric))) for s in (late, early)]
    return df.groupBy(key).agg((means[0] - means[1]).alias("delta")).filter("delta IS NOT NULL")


def label_rollup(df: DataFrame, by: str, flag: Column, score: Column) -> DataFrame:
    """Rate of a flag, mean of a score without its zeros and nulls, and rows at each score from 1 to 5."""
    rows = df.select(F.col(by), flag.alias("f"), score.alias("s"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce(F.col("f"), F.lit(False)).cast("double")).alias("rate"), F.avg(F.nullif("s", F.lit(0))).alias("mean_score"), *[F.count_if(F.col("s") == k).alias(f"score_{k}") for k in range(1, 6)])


def quota_sample(df: DataFrame, by: str, order: str, total: int) -> DataFrame:
    """The first rows of each group, total div groups of each."""
    groups = df.select(by).distinct().count()
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("rank") <= max(1, total // max(1, groups)))


def errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that a row fails (null counts as failing), in their order."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]))
