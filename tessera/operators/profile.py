"""Profiles of a corpus: lengths, buckets, survival, feature rates, duplicates.

Every profile aggregates on the map side first; nothing is collected per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

PERCENTILES = (10, 25, 50, 75, 90, 95, 99)
BUCKETS = ((0, 3_000), (3_000, 7_000), (7_000, 14_000), (14_000, 28_000), (28_000, None))
SEQUENCES = (2_048, 4_096, 8_192, 16_384)


def length_profile(df: DataFrame, by: str, n: Column) -> DataFrame:
    """Count, mean, median, sample deviation (0 for a single row), least and most; unrounded. Null lengths are left out."""
    rows = df.select(F.col(by), n.alias("n")).filter("n IS NOT NULL")
    return rows.groupBy(by).agg(F.count("n").alias("n_rows"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("stdev"), F.min("n").alias("least"), F.max("n").alias("most"), F.percentile("n", 0.95).alias("p95"))


def floor_percentiles(df: DataFrame, by: str, n: Column, at: tuple[int, ...] = PERCENTILES, clamped: bool = True) -> DataFrame:
    """The value at index floor(p * count / 100) of the sorted values, for each p; past the last value it is that one, or null if not ``clamped``.

    Values are counted first, so that the window runs over distinct lengths, however many rows a group has.
    """
    counts = df.select(F.col(by), n.alias("n")).filter("n IS NOT NULL").groupBy(by, "n").agg(F.count(F.lit(1)).alias("rows"))
    w = W.partitionBy(by)
    upto = counts.withColumn("upto", F.sum("rows").over(w.orderBy("n").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("rows").over(w))
    index = [F.expr(f"({p} * total) div 100") for p in at]
    wanted = [F.min(F.when(F.col("upto") > (F.least(i, F.col("total") - 1) if clamped else i), F.col("n"))).alias(f"p{p}") for p, i in zip(at, index, strict=True)]
    return upto.groupBy(by).agg(F.sum("rows").alias("n_rows"), *wanted)


def length_buckets(df: DataFrame, by: str, n: Column) -> DataFrame:
    """Rows and share in each fixed bucket, in long form."""
    rows = df.select(F.col(by), n.alias("n")).filter("n IS NOT NULL")
    name = F.coalesce(*[F.when((F.col("n") >= low) & (F.col("n") < high if high else F.lit(True)), F.lit(f"{low}-{high or ''}")) for low, high in BUCKETS])
    counted = rows.groupBy(by, name.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(by)))


def length_histogram(df: DataFrame, n: Column, width: int = 5_000) -> DataFrame:
    """Rows of each bin of equal width, with the share of all rows and of those up to the bin's end."""
    counted = df.select((F.floor(n / width) * width).cast("bigint").alias("bin")).filter("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"))
    whole = F.sum("n_rows").over(W.partitionBy(F.lit(0)))  # as many rows as bins
    below = F.sum("n_rows").over(W.partitionBy(F.lit(0)).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return counted.select("bin", "n_rows", (F.col("n_rows") / whole).alias("share"), (below / whole).alias("share_below"))


def sequence_survival(df: DataFrame, by: str, n: Column) -> DataFrame:
    """Rows whose estimated tokens fit each sequence length, and the rate."""
    rows = df.select(F.col(by), X.estimated_tokens(n).alias("t")).filter("t IS NOT NULL")
    kept = [x for s in SEQUENCES for x in (F.count_if(F.col("t") <= s).alias(f"kept_{s}"), F.avg((F.col("t") <= s).cast("double")).alias(f"rate_{s}"))]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *kept)


# What counts as code, headings, step marks and opening words.
CODING = r"(?i)\bdef \w+\(|import \w+|class \w+:|print\(|\.py\b|python\b|javascript\b|leetcode\b|Generate an executable|stdin|stdout|#include|int main\("
HEADING = r"(?m)\*\*.+?\*\*|^#{1,3} "
STEPS = r"\bStep \d+|\b\d+\.\s+\*\*|\*\*Step"
OPENER = r"(?m)^(Okay[,.]|Let me |Alright[,.]|Hmm[,.]|So[,.])"


def feature_rates(df: DataFrame, by: str, problem: str, solution: str) -> DataFrame:
    """Shares of rows with a boxed answer, a think block, code in either text, headings, step marks, opening words, many lines, a number."""
    p, s = (F.coalesce(F.col(c), F.lit("")) for c in (problem, solution))
    flags = {
        "boxed": F.contains(s, F.lit("\\boxed{")),
        "think": F.contains(s, F.lit("<think>")),
        "coding": p.rlike(CODING) | s.rlike(CODING),
        "heading": s.rlike("(?d)" + HEADING),
        "steps": s.rlike(STEPS),
        "opener": s.rlike("(?d)" + OPENER),
        "lines": F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit(""))) >= 5,
        "number": s.rlike("[0-9]"),
    }
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(v.cast("double")).alias(f"{k}_rate") for k, v in flags.items()])


def quality_alarms(rates: DataFrame) -> DataFrame:
    """Whether fewer than 95 % of a source's rows have a boxed answer, from feature_rates."""
    return rates.withColumn("few_boxed", F.col("boxed_rate") < 0.95)


def key_counts(df: DataFrame, key: Column) -> DataFrame:
    """Rows of each key (a null key is left out)."""
    return df.select(key.alias("key")).filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))


def dedup_profile(counts: DataFrame) -> DataFrame:
    """Rows, keys, rows per key and how the rows spread over the keys, in one row.

    ``median`` is the upper one of the counts in descending order, found over the counts of counts.
    """
    by_size = counts.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_keys"))
    above = by_size.withColumn("upto", F.sum("n_keys").over(W.partitionBy(F.lit(0)).orderBy(F.desc("n_rows")).rowsBetween(W.unboundedPreceding, 0))).withColumn("all_keys", F.sum("n_keys").over(W.partitionBy(F.lit(0))))

    def keys(low: int, high: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n_rows").between(low, high), F.col("n_keys"))), F.lit(0))

    return above.agg(
        F.coalesce(F.sum(F.col("n_rows") * F.col("n_keys")), F.lit(0)).alias("total"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("unique_keys"), (F.sum(F.col("n_rows") * F.col("n_keys")) / F.sum("n_keys")).alias("ratio"),
        F.min("n_rows").alias("least"), F.max("n_rows").alias("most"), F.max(F.when(F.col("upto") > F.expr("all_keys div 2"), F.col("n_rows"))).alias("median"),
        keys(1, 1).alias("keys_1"), keys(2, 5).alias("keys_2_5"), keys(6, 20).alias("keys_6_20"), keys(21, 50).alias("keys_21_50"), keys(51, 2**62).alias("keys_51"),
    )


def top_keys(df: DataFrame, key: Column, order: Column, n: int = 5) -> DataFrame:
    """The n most frequent keys; of equally frequent ones the one that comes first in ``order``."""
    rows = df.select(key.alias("key"), order.alias("at")).filter("key IS NOT NULL")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min("at").alias("first_at")).orderBy(F.desc("n_rows"), "first_at", "key").limit(n)


def keep_first(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null key all stay.

    An aggregate with partial results on the map side, so a key with most of the rows is no hot task.
    """
    names = df.columns
    keyed = df.withColumn("__key", key)
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    first = keyed.filter("__key IS NOT NULL").groupBy("__key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), ranked).alias("row")).select("row.*")
    return first.unionByName(keyed.filter("__key IS NULL").select(*[F.col(f"`{c}`") for c in names]))


def source_stats(df: DataFrame, by: str, problem: str, solution: str, low: int, high: int) -> DataFrame:
    """Rows seen, kept, blank, outside the character band and without a boxed answer; each row has one fate."""
    no = X.blank(F.col(problem)) | X.blank(F.col(solution))
    n = F.length(problem) + F.length(solution)
    out = ~no & ~n.between(low, high)
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("seen"), F.count_if(no).alias("blank"), F.count_if(out & (n < low)).alias("short"), F.count_if(out & (n > high)).alias("long"), F.count_if(~no & ~out).alias("kept"), F.count_if(~no & ~out & ~F.col(solution).rlike(r"\\boxed\{")).alias("missing_boxed"))
