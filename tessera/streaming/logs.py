"""Append-only logs as streams: latest record per key, running monitor of a metric, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """A folder in which files appear, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def latest_per_key(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last record of each key so far (complete or update output)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*stream.columns), F.col(order)).alias("row")).select("row.*")


def run_once(df: DataFrame, folder: str, mode: str = "complete", every: str | None = None) -> DataFrame:
    """Work off what is there and stop; the result is a table in ``folder``, which all executors must share.

    Each batch is written to a folder of its own, which a repeated batch overwrites, so that a restart neither
    loses nor doubles rows; nothing passes through the driver. In complete mode the last batch is the result, else
    all batches are. ``every`` (such as "600 seconds") commits on that clock until the caller stops the query,
    which is then returned in place of a table.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state")
    if every:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    spark = df.sparkSession
    last = (query.lastProgress or {}).get("batchId")
    if last is None and mode == "complete":
        return spark.createDataFrame([], df.schema)
    try:
        rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/rows")
    except AnalysisException:  # no batch had anything
        return spark.createDataFrame([], df.schema)
    return (rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0]) if mode == "complete" else rows).drop("batch")


def windowed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Records per time window and label; records later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def plateau_monitor(stream: DataFrame, series: str, step: str, loss: str, patience: int = 3, least: float = 0.005) -> DataFrame:
    """Emits each point with the running best and whether the series has stopped to gain; state is the last ``patience`` values."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        past, best = state.get if state.exists else ([], float("inf"))
        past = list(past)
        for pdf in batches:
            rows = []
            for at, value in sorted(zip(pdf[step], pdf[loss], strict=True)):
                best = min(best, value)
                flat = len(past) >= patience and past[-patience] != 0 and (past[-patience] - value) / abs(past[-patience]) < least
                rows.append((key[0], at, value, best, bool(flat)))
                past = [*past, float(value)][-patience:]
            yield pd.DataFrame(rows, columns=[series, step, loss, "best", "plateau"])
        state.update((past, float(best)))

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = f"{series} {kinds[series]}, {step} {kinds[step]}, {loss} double, best double, plateau boolean"
    return stream.groupBy(series).applyInPandasWithState(update, out, "past array<double>, best double", "append", "NoTimeout")
