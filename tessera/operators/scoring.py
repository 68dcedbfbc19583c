"""Scoring of completions: accuracy, pass@k, agreement of two raters, bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.plans.session import written


def reward(output: Column, truth: Column) -> Column:
    """1.0 if the answers are equal in normal form (a boxed answer in the truth is unwrapped), else 0.0."""
    return F.coalesce((X.normal_answer(X.answer(output)) == X.normal_answer(F.coalesce(X.boxed(truth), truth))).cast("double"), F.lit(0.0))


def consensus(df: DataFrame, problem: str, solution: str, *keep: str) -> DataFrame:
    """Counts of (problem, answer, *keep) with ``correct``: is it the problem's most frequent answer (ties: the smallest)?

    ``n`` is the number of rows. Answers are extracted once, and counted on the map side before anything is
    joined, so that a problem with a tenth of all rows is no hot task. Rows without a problem are left out.
    """
    rows = df.filter(F.col(problem).isNotNull()).select(problem, *keep, X.normal_answer(X.answer(F.col(solution))).alias("answer"))
    counts = written(rows.groupBy(problem, *keep, "answer").agg(F.count(F.lit(1)).alias("n")))
    per_answer = counts.filter("answer IS NOT NULL").groupBy(problem, "answer").agg(F.sum("n").alias("n"))
    top = per_answer.groupBy(problem).agg(F.min_by("answer", F.struct(-F.col("n"), F.col("answer"))).alias("truth"))
    return counts.join(top, problem, "left").withColumn("correct", F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)))


def against_truth(predictions: DataFrame, truths: DataFrame, key: str, output: str, truth: str, *keep: str) -> DataFrame:
    """Counts of (key, answer, *keep) with ``correct``: does the answer equal the item's truth in normal form?

    Joined on the key, never by position. ``truths`` has one row per key (exact repeats count once; of several
    truths the smallest stands); predictions of unknown or null keys are left out, items without predictions do
    not appear. ``answer`` is null where nothing could be extracted.
    """
    known = truths.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(X.normal_answer(F.coalesce(X.boxed(F.col(truth)), F.col(truth)))).alias("truth"))
    rows = predictions.filter(F.col(key).isNotNull()).select(key, *keep, X.normal_answer(X.answer(F.col(output))).alias("answer"))
    counts = rows.groupBy(key, *keep, "answer").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(known, key).withColumn("correct", F.coalesce(F.col("answer") == F.col("truth"), F.lit(False)))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n - c, k) / C(n, k) as a product of n - k + 1 .. n; 1 where fewer than k are wrong, null where n < k."""
    terms = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (n - c - i) / (n - i))
    missed = F.aggregate(terms, F.lit(1.0), lambda a, t: a * t)
    return F.when(n >= k, F.when(n - c < k, F.lit(1.0)).otherwise(1.0 - missed))


def per_problem(scored: DataFrame, problem: str, *keep: str) -> DataFrame:
    """Samples and right ones of each problem, and samples without an answer."""
    return scored.groupBy(problem, *keep).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("correct"), F.col("n"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(F.col("answer").isNull(), F.col("n"))), F.lit(0)).alias("failures"))


def pass_rates(scored: DataFrame, problem: str, ks: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """Mean pass@k over the problems with at least k samples, in one row."""
    per = per_problem(scored, problem)
    return per.agg(F.count(F.lit(1)).alias("n_problems"), *[F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_at_{k}") for k in ks])


def accuracy(scored: DataFrame, by: str) -> DataFrame:
    """Rows, correct ones, rows without an answer and the rates (0 where there are no rows)."""
    per = scored.groupBy(by).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("correct"), F.col("n"))), F.lit(0)).alias("n_correct"), F.coalesce(F.sum(F.when(F.col("answer").isNull(), F.col("n"))), F.lit(0)).alias("failures"))
    return per.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n_correct"), "n"), F.lit(0.0))).withColumn("failure_rate", F.coalesce(F.try_divide(F.col("failures"), "n"), F.lit(0.0)))


def two_models(a: DataFrame, b: DataFrame, key: str, by: str) -> DataFrame:
    """Problems that both models were scored on, joined by key: by, key, a, b (right or not). A problem of several samples is right if its first answer in order is."""
    def flag(scored: DataFrame, name: str) -> DataFrame:
        return scored.groupBy(key, by).agg(F.min_by("correct", F.struct(F.col("answer").isNull(), "answer")).alias(name))

    return flag(a, "a").join(flag(b, "b"), [key, by])


def comparison(both: DataFrame, by: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Full record of two models by data set: rates with their intervals, delta, p, agreement, and whether the change is real.

    ``overlap``: do the two intervals have a point in common; ``improved``: the paired test is significant or the
    intervals do not overlap with b above a. All of it comes from the four cells of the agreement table, one row per data set.
    """
    table = agreement(both, by, F.col("a"), F.col("b"))
    sides = [bootstrap_ci(table.select(by, "n", (F.col("both") + F.col(f"{s}_only")).alias("n_correct")), by, draws, seed).select(by, F.col("mean").alias(f"mean_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}")) for s in "ab"]
    out = table.drop("delta").join(sides[0], by).join(sides[1], by).join(paired_bootstrap(table, by, draws, seed), by)
    overlap = (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))
    return out.withColumn("overlap", overlap).withColumn("improved", F.col("significant") | (~F.col("overlap") & (F.col("mean_b") > F.col("mean_a"))))


def shaped_rewards(output: Column, truth: Column, n_tokens: Column) -> dict[str, Column]:
    """Variants of the reward: exact; 0.1 for a boxed answer and 0.9 more if right; right less a thousandth per token, never under 0."""
    right = reward(output, truth)
    boxed = F.coalesce(F.contains(output, F.lit("\\boxed{")), F.lit(False)).cast("double")
    return {"exact": right, "formatted": boxed * 0.1 + right * 0.9, "shortened": F.greatest(F.lit(0.0), right * (1 - 0.001 * n_tokens))}


def agreement(df: DataFrame, by: str, a: Column, b: Column) -> DataFrame:
    """Both right, both wrong, one only, and the difference of the rates; rows where a rater is null are left out."""
    rows = df.select(F.col(by), a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("NOT a AND NOT b")).alias("neither"), F.count_if(F.expr("a AND NOT b")).alias("a_only"), F.count_if(F.expr("b AND NOT a")).alias("b_only"), (F.avg(F.col("b").cast("double")) - F.avg(F.col("a").cast("double"))).alias("delta"))


def bootstrap_ci(counts: DataFrame, by: str, draws: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Percentile bootstrap of a rate from n and n_correct of each group: mean, low, high.

    Resampling n zeros and ones is a binomial draw, so a group of any size is one row here.
    """

    def run(batches):
        for pdf in batches:
            low, high = [], []
            for name, n, c in zip(pdf[by], pdf.n, pdf.n_correct, strict=True):
                rng = np.random.RandomState((seed + sum(str(name).encode())) % 2**32)
                means = rng.binomial(int(n), c / n, draws) / n if n else np.zeros(1)
                a, b = np.percentile(means, [100 * (1 - level) / 2, 100 * (1 + level) / 2])
                low.append(a)
                high.append(b)
            yield pd.DataFrame({by: pdf[by], "n": pdf.n, "mean": pdf.n_correct / pdf.n.where(pdf.n > 0), "low": low, "high": high})

    return counts.select(by, "n", "n_correct").mapInPandas(run, f"{by} string, n bigint, mean double, low double, high double")


def paired_bootstrap(table: DataFrame, by: str, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """p: share of resampled differences at or under 0, from the four cells of an agreement table; significant under 0.05."""

    def run(batches):
        for pdf in batches:
            p = []
            for row in pdf.itertuples():
                rng = np.random.RandomState((seed + sum(str(getattr(row, by)).encode())) % 2**32)
                cells = np.array([row.both, row.neither, row.a_only, row.b_only], float)
                drawn = rng.multinomial(int(cells.sum()), cells / cells.sum(), draws)
                p.append(float((drawn[:, 3] <= drawn[:, 2]).mean()))
            yield pd.DataFrame({by: pdf[by], "delta": pdf.delta, "p": p, "significant": [x < 0.05 for x in p]})

    return table.filter("n > 0").mapInPandas(run, f"{by} string, delta double, p double, significant boolean")
