"""Operators that depend on an explicit order: running values, splits, shards, packs, batches, monitors.

Where a group may hold most of the rows, the running value is built in two levels: rows fall into buckets of
the order key, bucket totals are summed over the few buckets, and rows only inside their bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_total(df: DataFrame, group: str, order: str, value: str, out: str, width: int = 100_000) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and with this one in the order of a whole-number key.

    Rows of equal order share one total (so ties have a defined result). Null groups are a group of their
    own; null values count 0; rows without an order come first.
    """
    rows = df.withColumn("__bucket", F.coalesce(F.expr(f"`{order}` div {width}"), F.lit(-(2**62)))).withColumn("__key", F.coalesce(F.col(group).cast("string"), F.lit("\0")))
    totals = rows.groupBy("__key", "__bucket").agg(F.coalesce(F.sum(value), F.lit(0)).alias("__sum"))
    before = totals.select("__key", "__bucket", F.coalesce(F.sum("__sum").over(W.partitionBy("__key").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum(value).over(W.partitionBy("__key", "__bucket").orderBy(F.col(order).asc_nulls_first()).rangeBetween(W.unboundedPreceding, 0)), F.lit(0))
    return rows.withColumn("__within", within).join(before, ["__key", "__bucket"]).withColumn(out, F.col("__before") + F.col("__within")).drop("__key", "__bucket", "__within", "__before")


def holdout(df: DataFrame, group: str, order: str, tokens: str, most: int) -> DataFrame:
    """Marks ``split`` val for the first documents of each group until ``most`` tokens are reached, the crossing one with them; else train."""
    out = running_total(df, group, order, tokens, "__upto")
    return out.withColumn("split", F.when(F.col("__upto") - F.coalesce(F.col(tokens), F.lit(0)) < most, "val").otherwise("train")).drop("__upto")


def tail_split(df: DataFrame, order: list[str]) -> DataFrame:
    """Marks the last max(10, min(200, n div 20)) rows val, the rest train; every row comes out once.

    Rows of equal order are put in the order of a hash of all their columns. A top-k of at most 200 keys finds the
    boundary, and each row is held against it; only rows that equal the boundary in everything are ranked, since
    any of them will do. Nulls come first in the order.
    """
    keyed = df.withColumn("__h", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    keys = [*order, "__h"]
    size = max(10, min(200, df.count() // 20))
    tail = keyed.select(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in keys]).limit(size).collect()
    if len(tail) < size:
        return df.withColumn("split", F.lit("val"))
    bound = tail[-1]
    above, same = F.lit(False), F.lit(True)
    for c in keys:
        here = F.lit(bound[c]).cast(keyed.schema[c].dataType)
        above = above | (same & F.coalesce(F.col(c) > here, F.col(c).isNotNull() & here.isNull()))
        same = same & F.col(c).eqNullSafe(here)
    left = sum(r == bound for r in tail)
    rest = keyed.filter(~same).withColumn("split", F.when(above, "val").otherwise("train"))
    equal = keyed.filter(same).withColumn("split", F.when(F.row_number().over(W.partitionBy("__h").orderBy("__h")) <= left, "val").otherwise("train"))
    return rest.unionByName(equal).select(*df.columns, "split")


def first_per_group(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group (Spark limits each partition before the shuffle)."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the order of a seeded hash of the key, the same whatever the partitioning; ties by the key."""
    return df.withColumn("__h", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")


def stratified_top(df: DataFrame, group: str, level: str, hard: int, order: str, n: int, most: int | None = None) -> DataFrame:
    """n rows of each group, from the hard levels where those suffice, hardest first; ties by ``order``; ``most`` rows in all, group after group.

    Whether they suffice is an aggregate with partial counts; the ranks are cut to n in each partition before the shuffle.
    """
    is_hard = F.coalesce(F.col(level) >= hard, F.lit(False))
    enough = df.groupBy(F.col(group).alias("__g")).agg((F.count_if(is_hard) >= n).alias("__enough"))
    pool = df.join(enough, F.col(group).eqNullSafe(F.col("__g"))).filter(~F.col("__enough") | is_hard).drop("__g", "__enough")
    out = pool.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.col(level).desc_nulls_last(), order))).filter(F.col("rank") <= n)
    return out if most is None else out.orderBy(group, "rank").limit(most)


def fold(df: DataFrame, group: str, order: list[str], step: Callable[[tuple | None, list[tuple]], tuple[tuple | None, list[tuple]]], made: str) -> DataFrame:
    """An ordered fold over each group: (group, o, n_tokens) rows in the given order, with what ``step`` makes of each.

    ``step`` gets the state and a batch's rows of one group and returns the new state and the added columns. Rows
    stream through in Arrow batches sorted by group and order; a task holds one batch and one state, so a group may
    have any size, and what is shuffled are two numbers a row.
    """
    names = [c.split()[0] for c in made.split(", ")]
    kind = df.schema[group].dataType.simpleString()
    rows = df.repartition(group).sortWithinPartitions(group, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, object()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out: list[tuple] = []
            start = 0
            for i in range(len(columns[0]) + 1):
                if i == len(columns[0]) or columns[0][i] != columns[0][start]:
                    if i > start:
                        if columns[0][start] != at:
                            state, at = None, columns[0][start]
                        state, more = step(state, list(zip(columns[1][start:i], columns[2][start:i], strict=True)))
                        out += more
                    start = i
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * len(names))]], names=["g", "o", "n_tokens", *names])

    return rows.mapInArrow(run, f"g {kind}, o bigint, n_tokens bigint, {made}")


def _narrow(df: DataFrame, group: str, order: str, tokens: str) -> DataFrame:
    return df.select(F.col(group).alias("g"), F.col(order).cast("bigint").alias("o"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("n"))


def assign_shards(df: DataFrame, group: str, order: str, tokens: str, size: int) -> DataFrame:
    """shard number of each document: a shard closes once it holds ``size`` tokens; documents stay whole, offset is the start in the shard."""

    def step(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        shard, held = state or (0, 0)
        out = []
        for _, n in rows:
            out.append((shard, held))
            held += n
            if held >= size:
                shard, held = shard + 1, 0
        return (shard, held), out

    return fold(_narrow(df, group, order, tokens), "g", ["o"], step, "shard bigint, offset bigint").withColumnsRenamed({"g": group, "o": order})


def pack_next_fit(df: DataFrame, group: str, order: str, tokens: str, length: int) -> DataFrame:
    """Packs in the given order: a sample joins the open pack if it and a separator fit, else a new pack opens.

    Columns: pack, start (after the separator). Samples longer than ``length`` are refused and left out, as are
    samples without tokens.
    """

    def step(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        pack, held = state or (0, 0)
        out = []
        for _, n in rows:
            if held and held + 1 + n > length:
                pack, held = pack + 1, 0
            held += bool(held)
            out.append((pack, held))
            held += n
        return (pack, held), out

    return fold(_narrow(df, group, order, tokens).filter(f"n > 0 AND n <= {length}"), "g", ["o"], step, "pack bigint, start bigint").withColumnsRenamed({"g": group, "o": order})


def budget_batches(df: DataFrame, group: str, order: str, tokens: str, budget: int) -> DataFrame:
    """Batches of samples sorted by length with (samples * longest) within the budget; a longer sample is a batch of its own."""

    def step(state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        batch, held = state or (0, 0)
        out = []
        for _, n in rows:  # sorted by length, so the sample at hand is the longest
            if held and (held + 1) * n > budget:
                batch, held = batch + 1, 0
            held += 1
            out.append((batch,))
        return (batch, held), out

    return fold(_narrow(df, group, order, tokens), "g", ["n", "o"], step, "batch bigint").withColumnsRenamed({"g": group, "o": order})


def batch_order(batches: DataFrame, group: str, epoch: int, seed: int = 42) -> DataFrame:
    """The batches of a group in the order of an epoch: a hash of seed + epoch and the batch; columns group, batch, position."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed + epoch)), F.col("batch").cast("string")))
    return batches.select(group, "batch").distinct().withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(mixed, "batch"))).select(group, "batch", "position")


def packed_rows(samples: DataFrame, packs: DataFrame, group: str, order: str, length: int, end: int = 50_256, ignored: int = -100) -> DataFrame:
    """Rows for training from samples (group, order, ids, labels) and their packs: input_ids, attention_mask and labels of ``length`` each.

    Samples of a pack stand in order with the end token between them; separators and padding are ``ignored`` in
    the labels, the padding is 0 in the mask. A row gathers one pack, which ``length`` bounds.
    """
    joined = samples.select(group, order, "ids", "labels").join(packs.select(group, order, "pack", "start"), [group, order])
    parts = joined.groupBy(group, "pack").agg(F.array_sort(F.collect_list(F.struct("start", "ids", "labels"))).alias("s"))
    between = F.transform("s", lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(end)), x["ids"])).otherwise(x["ids"]))
    marked = F.transform("s", lambda x, i: F.when(i > 0, F.concat(F.array(F.lit(ignored)), x["labels"])).otherwise(x["labels"]))
    flat = parts.select(group, "pack", F.flatten(between).alias("ids"), F.flatten(marked).alias("labels"))
    pad = F.greatest(F.lit(0), F.lit(length) - F.size("ids"))
    return flat.select(
        group, "pack", F.concat("ids", F.array_repeat(F.lit(end), pad)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), pad)).alias("attention_mask"), F.concat("labels", F.array_repeat(F.lit(ignored), pad)).alias("labels"),
    )


def fitting(df: DataFrame, ids: str, labels: str, length: int, least: int = 5, ignored: int = -100) -> DataFrame:
    """Samples that fit the sequence whole and leave at least ``least`` labels to learn from; longer ones are dropped, not cut."""
    learnt = F.size(F.filter(labels, lambda x: x != ignored))
    return df.filter((F.size(ids) <= length) & (learnt >= least))


def cut_and_masked(ids: Column, mask: Column, length: int, least: int = 3) -> tuple[Column, Column, Column]:
    """(ids, mask, keep): both cut at length + 1, and whether at least ``least`` positions still count for the loss."""
    short, marks = F.slice(ids, 1, length + 1), F.slice(mask, 1, length + 1)
    return short, marks, F.aggregate(marks, F.lit(0), lambda a, x: a + x) >= least


def shifted_batch(ids: Column, mask: Column, length: int, pad: int = 0, masked: int = -1) -> tuple[Column, Column]:
    """(inputs, targets) of ``length``: padded, shifted by one, targets ``masked`` where the mask of the target is 0."""
    more = F.greatest(F.lit(0), F.lit(length + 1) - F.size(ids))
    full, marks = F.slice(F.concat(ids, F.array_repeat(F.lit(pad), more)), 1, length + 1), F.slice(F.concat(mask, F.array_repeat(F.lit(0), more)), 1, length + 1)
    targets = F.zip_with(F.slice(full, 2, length), F.slice(marks, 2, length), lambda t, m: F.when(m == 0, F.lit(masked)).otherwise(t))
    return F.slice(full, 1, length), targets


def read_positions(steps: DataFrame, total: int, count: int) -> DataFrame:
    """Where each step of an endless reader stands: epoch and first token of its ``count`` tokens over a source of ``total``, wrapping around."""
    return steps.select(F.col("id").alias("step"), F.expr(f"(id * {count}) div {total}").alias("epoch"), F.expr(f"(id * {count}) % {total}").alias("position"))


def loss_mask(tokens: Column, prompt: Column, ignored: int = -100) -> Column:
    """Labels: the first ``prompt`` tokens ignored, the rest themselves."""
    return F.transform(tokens, lambda t, i: F.when(i < prompt, F.lit(ignored)).otherwise(t))


def shifted(tokens: Column) -> tuple[Column, Column]:
    """(inputs, targets): all but the last token, all but the first."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, 1, n), F.slice(tokens, 2, n)


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, floor: float = 0.0) -> Column:
    """Linear to the peak, then half a cosine down to the floor."""
    part = F.least(F.lit(1.0), (step - warmup) / F.lit(max(1, total - warmup)))
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part)))


WIDTH = 10_000  #: rows of a series that one task puts in order


def positions(df: DataFrame, series: str, order: list[str], width: int = WIDTH) -> DataFrame:
    """Adds ``__i``, a row's place in its series (from 1), ``__n``, the rows of the series, and ``__k``, the series as a key that is never null.

    A series may hold most of the rows: the range of its first order column is cut into parts of about ``width`` rows,
    whose counts are summed first; a row's place is that sum and its rank in its part. Nulls of the order come first.
    """
    first = F.col(order[0])
    timed = df.schema[order[0]].dataType.simpleString().startswith(("timestamp", "date"))
    number = F.unix_micros(first.cast("timestamp")) if timed else first.cast("double")
    keyed = df.withColumn("__k", F.coalesce(F.col(series).cast("string"), F.lit("\0")))
    span = keyed.groupBy("__k").agg(F.min(number).alias("__low"), F.max(number).alias("__high"), F.count(F.lit(1)).alias("__n"))
    part = F.floor((number - F.col("__low")) / (F.col("__high") - F.col("__low")) * F.ceil(F.col("__n") / width))
    placed = keyed.join(span, "__k").withColumn("__b", F.coalesce(F.when(F.col("__high") > F.col("__low"), part), F.when(number.isNotNull(), 0), F.lit(-1))).drop("__low", "__high")
    counts = placed.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.select("__k", "__b", F.coalesce(F.sum("__c").over(W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__k", "__b").orderBy(*order))
    return placed.withColumn("__inside", inside).join(before, ["__k", "__b"]).withColumn("__i", F.col("__before") + F.col("__inside")).drop("__b", "__inside", "__before")


def running(rows: DataFrame, made: dict[str, tuple[Callable, Column]], width: int = WIDTH) -> DataFrame:
    """Adds running aggregates (min, max or bool_and) along ``__i``, up to and with each row, from rows of ``positions``.

    ``width`` rows make a chunk; the chunks' aggregates are put in order, and rows only within their chunk.
    """
    chunked = rows.withColumn("__chunk", F.expr(f"(__i - 1) div {width}"))
    whole = chunked.groupBy("__k", "__chunk").agg(*[f(c).alias(f"__{name}") for name, (f, c) in made.items()])
    earlier = W.partitionBy("__k").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    before = whole.select("__k", "__chunk", *[f(f"__{name}").over(earlier).alias(f"__{name}") for name, (f, _) in made.items()])
    w = W.partitionBy("__k", "__chunk").orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    out = chunked.select("*", *[f(c).over(w).alias(f"__in_{name}") for name, (f, c) in made.items()]).join(before, ["__k", "__chunk"])
    both = {F.min: F.least, F.max: F.greatest, F.bool_and: lambda x, y: F.coalesce(x & y, x)}
    return out.select(*rows.columns, *[both[f](F.col(f"__in_{name}"), F.col(f"__{name}")).alias(name) for name, (f, _) in made.items()])


def overlapped(rows: DataFrame, more: int, width: int = WIDTH) -> DataFrame:
    """Rows of ``positions`` in chunks of ``width``, each with the ``more`` rows before it (``__own`` is false for these): for windows over few neighbours."""
    width = max(width, more + 1)
    own = rows.withColumn("__chunk", F.expr(f"(__i - 1) div {width}")).withColumn("__own", F.lit(True))
    late = rows.filter(F.expr(f"(__i - 1) % {width} >= {width - more}")).withColumn("__chunk", F.expr(f"(__i - 1) div {width} + 1")).withColumn("__own", F.lit(False))
    return own.unionByName(late)


def monitor(df: DataFrame, series: str, order: list[str], loss: str, patience: int = 3, least: float = 0.005, first_step: int = 0, width: int = WIDTH) -> DataFrame:
    """Running best, change, plateau, rise and peak distance of a metric along each series.

    ``plateau``: the relative gain over the value ``patience`` points ago is under ``least``, from ``first_step``
    on. ``monotone``: no value so far was above the one before. Null values are left out. No task holds more than
    ``width`` rows of a series.
    """
    rows = positions(df.filter(F.col(loss).isNotNull()), series, order, width)
    w = W.partitionBy("__k", "__chunk").orderBy("__i")
    near = overlapped(rows, patience, width).withColumn("__last", F.lag(loss).over(w)).withColumn("__past", F.lag(loss, patience).over(w)).filter("__own").drop("__own", "__chunk")
    falls = F.coalesce(F.col(loss) <= F.col("__last"), F.lit(True))
    out = running(near, {"__best": (F.min, F.col(loss)), "__worst": (F.max, F.col(loss)), "__falls": (F.bool_and, falls)}, width)
    plateau = F.coalesce(F.try_divide(F.col("__past") - F.col(loss), F.abs("__past")) < least, F.lit(False)) & (F.col("__i") >= first_step)
    return out.select(*[c for c in df.columns if c not in ("step", "best", "worst", "monotone", "plateau")], F.col("__i").cast("int").alias("step"), F.col("__best").alias("best"), F.col("__worst").alias("worst"), F.col("__falls").alias("monotone"), plateau.alias("plateau"))


def trajectory(df: DataFrame, series: str, order: list[str], value: str, width: int = WIDTH) -> DataFrame:
    """First, quarter, half, three-quarter and last value of each series; no task holds more than about ``width`` rows of it."""
    rows = positions(df, series, order, width)
    at = {"first": F.lit(1), "quarter": F.greatest(F.lit(1), F.expr("__n div 4")), "half": F.greatest(F.lit(1), F.expr("__n div 2")), "three_quarters": F.greatest(F.lit(1), F.expr("3 * __n div 4")), "last": F.col("__n")}
    return rows.groupBy(series).agg(F.max("__n").alias("n"), *[F.max(F.when(F.col("__i") == k, F.col(value))).alias(name) for name, k in at.items()])


def frontier(df: DataFrame, cost: str, metric: str, buckets: int = 4_096) -> DataFrame:
    """Rows whose metric is above that of every cheaper row (and best of their cost).

    Two levels: the range of costs is cut into at most ``buckets`` parts, the best metric of each part is made
    first, and only those few are put in order; inside its part a row is held against the cheaper ones there.
    """
    per_cost = df.filter(F.col(cost).isNotNull() & F.col(metric).isNotNull()).groupBy(cost).agg(F.max(metric).alias(metric))
    ends = per_cost.agg(F.min(cost).cast("double").alias("low"), F.max(cost).cast("double").alias("high")).first()
    width = ((ends.high - ends.low) / buckets or 1.0) if ends.low is not None else 1.0
    per_cost = per_cost.withColumn("__b", F.floor((F.col(cost).cast("double") - F.lit(ends.low or 0.0)) / width))
    tops = per_cost.groupBy("__b").agg(F.max(metric).alias("__top"))
    earlier = tops.select("__b", F.max("__top").over(W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__earlier"))
    inside = F.max(metric).over(W.partitionBy("__b").orderBy(cost).rowsBetween(W.unboundedPreceding, -1))
    best = F.greatest(F.col("__earlier"), F.col("__inside"))
    return per_cost.withColumn("__inside", inside).join(earlier, "__b").filter(best.isNull() | (F.col(metric) > best)).select(cost, metric)
