"""Smaller operators on experiment records: lineage of data, merged registries, metric sets, flat results, alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import ordered, registry
from tessera.plans.session import written

# --- registries -----------------------------------------------------------------------------------


def register(known: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Both tables' rows; ValueError if a new row has no key, repeats one, or names one that is known. Records never change."""
    bad = new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(known.select(F.col(key)).distinct().withColumn("is_known", F.lit(True)), key, "left").filter(F.col(key).isNull() | (F.col("n") > 1) | F.col("is_known")).limit(5).collect()
    if bad:
        raise ValueError(f"not registered: {[r[key] for r in bad]} have no name of their own or are known")
    return known.unionByName(new, allowMissingColumns=True)


def merge(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key, of the newer table where both have it (several rows of a table: the one with the larger columns); null keys are left out."""
    names = [c for c in old.columns if c in new.columns]
    both = old.select(*names, F.lit(0).alias("__age")).unionByName(new.select(*names, F.lit(1).alias("__age")))
    return registry.latest(both, key, [F.col("__age"), *[F.col(c).cast("string") for c in names if c != key]]).select(*names)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def members(names: DataFrame, lists: DataFrame, key: str, member: str) -> DataFrame:
    """Sorted members of each key, an empty array for keys without any."""
    held = lists.filter(F.col(member).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(member)).alias("members"))
    return names.select(key).distinct().join(held, key, "left").select(key, F.coalesce("members", F.array().cast("array<string>")).alias("members"))


def unknown_members(lists: DataFrame, key: str, array: str, known: DataFrame, name: str) -> DataFrame:
    """(key, member) of the array elements that are not known."""
    return registry.missing(lists.select(key, F.explode(array).alias("member")), "member", known, name)


def side_by_side(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """One row: the records of two keys as JSON, or in ``error`` which of them are missing."""
    row = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    ends = df.filter(F.col(key).isin(a, b)).agg(*[F.max(F.when(F.col(key) == k, row)).alias(n) for k, n in ((a, "a"), (b, "b"))])
    lost = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(k)) for k, n in ((a, "a"), (b, "b"))]))
    return ends.select("a", "b", F.when(F.size(lost) > 0, F.concat(F.lit("not found: "), F.concat_ws(", ", lost))).alias("error"))


def ancestry(df: DataFrame, key: str, parent: str, most: int = 40) -> DataFrame:
    """(node, ancestor, depth) for each node, itself at depth 0, up its chain of parents.

    The reach doubles with each join. A parent that is no node ends the chain. A chain that runs in a circle is
    followed once around at most: an ancestor that is met again is not taken up.
    """
    nodes = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.min(parent).alias("up"))
    links = nodes.join(nodes.select(F.col("node").alias("up")), "up").select("node", F.col("up").alias("ancestor"), F.lit(1).cast("bigint").alias("depth"))
    closure = written(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("depth")).unionByName(links).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
    held = closure.count()
    for _ in range(most):
        far = closure.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("next"), F.col("depth").alias("more"))
        wider = closure.join(far, "ancestor").select("node", F.col("next").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        closure = written(wider.groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        before, held = held, closure.count()
        if held == before:
            break
    return closure


def data_lineage(df: DataFrame, key: str, parent: str, stage: str, data: str) -> DataFrame:
    """For each node the data of every stage on its chain, as a map of STAGE_data; of equal stages the nearest one counts."""
    chain = ancestry(df, key, parent).join(df.select(F.col(key).alias("ancestor"), F.col(stage).alias("stage"), F.col(data).alias("data")), "ancestor")
    nearest = chain.groupBy("node", "stage").agg(F.min_by("data", "depth").alias("data"))
    return nearest.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat("stage", F.lit("_data")), "data")))).alias("lineage"))


def stage_record(stage: Column, common: dict[str, Column], own: dict[str, dict[str, Column]]) -> Column:
    """A JSON record with the fields all stages have and those of the row's own stage."""
    made = F.lit(None).cast("string")
    for name, fields in own.items():
        made = F.when(stage == name, F.to_json(F.struct(stage.alias("stage"), *[c.alias(n) for n, c in (common | fields).items()]))).otherwise(made)
    return F.coalesce(made, F.to_json(F.struct(stage.alias("stage"), *[c.alias(n) for n, c in common.items()])))


# --- metric sets and flat results -----------------------------------------------------------------


def required_metrics(spark: SparkSession, common: list[str], own: dict[str, list[str]]) -> DataFrame:
    """(stage, metric): what every stage needs together with what it needs itself, each once."""
    rows = {(stage, m) for stage, more in own.items() for m in [*common, *more]}
    return spark.createDataFrame(sorted(rows), "stage string, metric string")


def missing_metrics(found: DataFrame, required: DataFrame, key: str, stage: str, metric: str) -> DataFrame:
    """(key, metric) that a record's stage requires and that it lacks."""
    wanted = found.select(key, F.col(stage).alias("stage")).distinct().join(F.broadcast(required), "stage")
    return wanted.join(found.select(key, F.col(metric).alias("metric")).distinct(), [key, "metric"], "left_anti").select(key, "metric")


def flat_results(df: DataFrame, by: str, bench: str, metrics: dict[str, Column]) -> DataFrame:
    """One map per record with BENCH_METRIC as its keys, from one row per record and bench."""
    names = [F.struct(F.concat(bench, F.lit(f"_{n}")).alias("key"), c.cast("double").alias("value")) for n, c in metrics.items()]
    return df.select(by, F.explode(F.array(*names)).alias("e")).groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("results"))


def sweep(base: DataFrame, steps: DataFrame, step: str) -> DataFrame:
    """The base as step 0 with all later steps, in order."""
    return base.withColumn(step, F.lit(0).cast("bigint")).unionByName(steps, allowMissingColumns=True).orderBy(step)


def interval_pivot(df: DataFrame, row: str, column: str, values: list, metric: str, low: str, high: str) -> DataFrame:
    """Mean of a metric and mean half width of its interval for each row and each stated column value."""
    return df.groupBy(row).pivot(column, values).agg(F.avg(metric).alias("mean"), F.avg((F.col(high) - F.col(low)) / 2).alias("half"))


def interval_curve(df: DataFrame, by: list[str], metric: str, low: str, high: str) -> DataFrame:
    """Mean of a metric and of the ends of its interval for each group."""
    return df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.avg(low).alias("low"), F.avg(high).alias("high"))


def best_of_stage(df: DataFrame, stage: str, order: str, metric: str) -> DataFrame:
    """Best value of each stage and whether it is strictly above the best of all stages before; one row per stage is what is ordered."""
    best = df.groupBy(stage).agg(F.max(metric).alias("best"), F.min(order).alias("at"))
    before = F.max("best").over(W.partitionBy(F.lit(0)).orderBy("at", stage).rowsBetween(W.unboundedPreceding, -1))
    return best.withColumn("improved", F.coalesce(F.col("best") > before, F.col("best").isNotNull())).select(stage, "best", "improved")


def cost_per_point(df: DataFrame, series: str, order: str, cost: str, metric: str) -> DataFrame:
    """Cost so far, gain of the metric over the first value, and cost for each point gained (null without a gain). Rows of equal order share one sum."""
    first = df.groupBy(series).agg(F.min_by(metric, order).alias("__first"))
    out = ordered.running_total(df, series, order, cost, "spent").join(first.withColumnRenamed(series, "__s"), F.col(series).eqNullSafe(F.col("__s"))).drop("__s")
    out = out.withColumn("gain", F.col(metric) - F.col("__first")).drop("__first")
    return out.withColumn("per_point", F.when(F.col("gain") > 0, F.col("spent") / F.col("gain")))


def rounded_sum(value: Column, places: int = 2) -> Column:
    """A sum whose every summand is rounded first: what rounding the running sum at each step comes to."""
    return F.sum(F.round(value.cast("decimal(28,8)"), places))


# --- alarms ---------------------------------------------------------------------------------------


def saturated(df: DataFrame, series: str, order: str, metric: str, part: float = 0.1, least: float = 0.01) -> DataFrame:
    """Has a series stopped to fall: is its best value of the last ``part`` of its span less than ``least`` under its best before?

    Two aggregates per series, no ordered pass. A series whose whole span lies in the last part has null.
    """
    span = df.filter(F.col(metric).isNotNull()).groupBy(series).agg(F.max(order).alias("__end"), F.min(order).alias("__start"))
    late = F.col(order) > F.col("__end") - part * (F.col("__end") - F.col("__start"))
    best = df.filter(F.col(metric).isNotNull()).join(span, series).groupBy(series).agg(F.min(F.when(~late, F.col(metric))).alias("before"), F.min(F.when(late, F.col(metric))).alias("late"))
    return best.select(series, "before", "late", (F.col("before") - F.least("before", "late") < least).alias("saturated"))


def loss_health(df: DataFrame, series: str, order: str, loss: str, after: int, drop: float = 0.05, final: float = 0.1) -> DataFrame:
    """Alarms of a loss curve, one row per series: not a number, over twice the first value, less than ``drop`` under the first after ``after``, no gain in the last ``final`` of the span.

    Aggregates only, whatever the length of a series. Infinite values count as not a number.
    """
    bad = F.isnan(loss) | (F.abs(loss) == float("inf"))
    span = df.filter(F.col(loss).isNotNull()).groupBy(series).agg(F.min_by(loss, order).alias("first"), F.max(order).alias("__end"), F.min(order).alias("__start"), F.bool_or(bad).alias("broken"))
    rows = df.filter(F.col(loss).isNotNull() & ~bad).join(span, series)
    late = F.col(order) > F.col("__end") - final * (F.col("__end") - F.col("__start"))
    out = rows.groupBy(series).agg(
        F.first("first").alias("first"), F.first("broken").alias("broken"), F.max(loss).alias("most"), F.min(F.when(F.col(order) >= after, F.col(loss))).alias("after"), F.min(F.when(late, F.col(loss))).alias("late"), F.min(F.when(~late, F.col(loss))).alias("before")
    )
    return out.select(series, "broken", (F.col("most") > 2 * F.col("first")).alias("exploded"), F.coalesce(F.col("after") > (1 - drop) * F.col("first"), F.lit(False)).alias("stuck"), F.coalesce(F.col("late") >= F.col("before"), F.lit(False)).alias("ended_flat"))


def streaks(df: DataFrame, series: str, order: list[str], alarm: Column, least: int) -> DataFrame:
    """Series in which the alarm holds for ``least`` points on end: first and longest such streak.

    A streak is what lies between two quiet points: rows carry the place of the last quiet one before them, a running
    maximum in two levels, and streaks are counted by it.
    """
    rows = ordered.positions(df.withColumn("__a", F.coalesce(alarm, F.lit(False))), series, order)
    marked = ordered.running(rows, {"__quiet": (F.max, F.when(~F.col("__a"), F.col("__i")).otherwise(F.lit(0)))})
    runs = marked.filter("__a").groupBy(series, "__quiet").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("at"))
    return runs.filter(F.col("n") >= least).groupBy(series).agg(F.min("at").cast("int").alias("first_at"), F.max("n").alias("longest"))


def correlations(df: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Rows and Pearson correlation of two metrics in each group; null where one does not vary."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("correlation"))


def unfittable(min_chars: Column, length: Column) -> Column:
    """Does a lower bound on characters leave next to nothing that fits ``length`` tokens (at 3.5 characters each)?"""
    return (min_chars > 0) & (min_chars > F.floor(length * 3.5) * 0.9)


def validated(df: DataFrame, group: str, weight: str = "weight") -> DataFrame:
    """The table with ``share``; ValueError if a weight is null, not a number or negative, or a group's weights add up to nothing."""
    bad = df.groupBy(group).agg(F.bool_or(F.col(weight).isNull() | F.isnan(weight) | (F.col(weight) < 0)).alias("wrong"), F.sum(weight).alias("total")).filter("wrong OR total IS NULL OR total <= 0").limit(5).collect()
    if bad:
        raise ValueError(f"bad weights in {[r[group] for r in bad]}")
    return df.withColumn("share", F.col(weight) / F.sum(weight).over(W.partitionBy(group)))


# --- records and conversations --------------------------------------------------------------------


def parsed_json(text: Column, schema: str) -> tuple[Column, Column]:
    """(record, error) of a text that may be a fenced JSON block; where it cannot be read the record is null and the error says so."""
    from tessera.functions.text import strip_fence

    bare = strip_fence(text)
    good = F.try_parse_json(bare).isNotNull()
    return F.when(good, F.from_json(bare, schema)), F.when(text.isNull(), "no text").when(~good, "not JSON")


def envelope(df: DataFrame, constants: dict[str, str], by: str, value: Column) -> DataFrame:
    """One JSON text: the constants, and a map of ``by`` to its value, keys in order."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(by), value.alias("v")))))
    return df.agg(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in constants.items()], entries.alias("results"))).alias("document"))


def chat_ids(messages: Column, marks: tuple[int, int, int, int] = (1, 2, 3, 4)) -> tuple[Column, Column]:
    """(ids, mask) of a conversation: a user's turn between the first two marks, an assistant's between the others; the mask is 1 for the assistant's ids and its end mark.

    Ids are code points. System turns are left out; the first of them stands before each user turn, as a paragraph.
    """
    from tessera.functions.text import code_points

    u0, u1, a0, a1 = (F.lit(m) for m in marks)
    system = F.try_element_at(F.filter(messages, lambda m: m["role"] == "system"), F.lit(1))["content"]
    turns = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))

    def ids(m: Column) -> Column:
        said = F.when(m["role"] == "user", F.concat(F.coalesce(F.concat(system, F.lit("\n\n")), F.lit("")), m["content"])).otherwise(m["content"])
        return F.when(m["role"] == "user", F.concat(F.array(u0), code_points(said), F.array(u1))).otherwise(F.concat(F.array(a0), code_points(said), F.array(a1)))

    def mask(m: Column) -> Column:
        n = F.size(ids(m))
        return F.when(m["role"] == "user", F.array_repeat(F.lit(0), n)).otherwise(F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), n - 1)))

    return F.flatten(F.transform(turns, ids)), F.flatten(F.transform(turns, mask))


def in_order(df: DataFrame, key: str, n: int, order: str, seed: int = 42) -> DataFrame:
    """A seeded sample of n rows (by the order of a hash of the key), back in the order they had."""
    return ordered.seeded_sample(df, key, n, seed).orderBy(order)
