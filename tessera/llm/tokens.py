"""Token counts per record and label (problem 4) and ids of whole texts (problem 5)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.labels import lang_label, source_label, subject_label
from tessera.llm import bpe

SLICE_BYTES = 8 << 20  #: bytes of text a worker handles at a time, so that long texts do not pile up


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass SLICE_BYTES; a single longer text stays whole."""
    sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0)
    start = total = 0
    for i, n in enumerate(sizes.to_pylist()):
        if total and total + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _map_text(df: DataFrame, column: str, result: T.StructField, work: Callable[[list[str | None]], pa.Array]) -> DataFrame:
    """Replace the text column by what ``work`` makes of it; Arrow batches, no row loop in the JVM."""
    others = [f for f in df.schema if f.name not in (column, result.name)]  # a column of the result's name is replaced
    narrow = df.select(*[F.col(f"`{f.name}`") for f in others], F.col(f"`{column}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, len(others)):
                made = work(batch.column(len(others)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], made], names=[*[f.name for f in others], result.name])

    return narrow.mapInArrow(run, T.StructType([*others, result]))


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """Replace ``text`` by its token ids, without special tokens.

    A null or empty text has the empty list of ids. Other columns (any number, nulls included) pass
    unchanged, but for one of the result's name, which is replaced; repeated rows stay repeated; an empty table gives an empty table. Narrow: no shuffle.
    """
    raw = df.sparkSession.sparkContext.broadcast(bpe.vocabulary_bytes(vocabulary))  # at most 64 MB, checked

    def work(texts: list[str | None]) -> pa.Array:
        encoder = bpe.of_worker(bpe.PrefixEncoder, raw.value)
        packed = [encoder.encode_packed(x) if x else b"" for x in texts]
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))]))

    return _map_text(df, text, T.StructField(ids, T.ArrayType(T.IntegerType(), True)), work)


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "n_tokens", vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """Replace ``text`` by its number of tokens; null and empty texts have 0. Narrow: no shuffle."""
    raw = df.sparkSession.sparkContext.broadcast(bpe.vocabulary_bytes(vocabulary))

    def work(texts: list[str | None]) -> pa.Array:
        counter = bpe.of_worker(bpe.MergeCounter, raw.value)
        return pa.array([counter.count(x) if x else 0 for x in texts], pa.int64())

    return _map_text(df, text, T.StructField(tokens, T.LongType()), work)


def record_tokens(documents: DataFrame, pairs: DataFrame, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """Tokens of each record of both corpora with canonical labels.

    Columns corpus, record_id, source, lang, subject, n_tokens. A pair delivered again counts once, by
    the delivery that came in last (ties: the larger labels and count); the text is counted before that,
    so only narrow rows are shuffled. Rows without an id cannot be told apart and all stay. Labels that
    are null or blank are null. Columns that the tables have besides are ignored.
    """
    labels = [source_label(F.col("source")).alias("source"), lang_label(F.col("lang")).alias("lang"), subject_label(F.col("subject")).alias("subject")]
    docs = count_tokens(documents.select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("record_id"), *labels, "text"), "text", vocabulary=vocabulary)
    counted = count_tokens(pairs.select(F.lit("sft_pairs").alias("corpus"), F.col("pair_id").alias("record_id"), *labels, "ingested_at", "solution"), "solution", vocabulary=vocabulary)
    row = ["source", "lang", "subject", "n_tokens"]
    kept = counted.filter("record_id IS NOT NULL").groupBy("corpus", "record_id").agg(F.max(F.struct("ingested_at", "n_tokens", "source", "lang", "subject")).alias("last"))
    kept = kept.select("corpus", "record_id", *[F.col(f"last.{c}").alias(c) for c in row])
    return docs.unionByName(kept).unionByName(counted.filter("record_id IS NULL").select("corpus", "record_id", *row))


def token_totals(counted: DataFrame) -> DataFrame:
    """Records and tokens of every slice: by source, by lang, by subject, by all three, and in all.

    ``slice`` names the grouping; a label that the grouping leaves out is null, a missing label is
    "unknown". The finest totals are made first, so the coarser ones add up a few rows.
    """
    named = [F.coalesce(F.col(c), F.lit("unknown")).alias(c) for c in ("source", "lang", "subject")]
    finest = counted.groupBy("corpus", *named).agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    sets = finest.groupingSets([["corpus", "source", "lang", "subject"], ["corpus", "source"], ["corpus", "lang"], ["corpus", "subject"], ["corpus"]], "corpus", "source", "lang", "subject")
    # The grouping id's bits, one for each label left out.
    name = F.element_at(F.create_map(*[F.lit(x) for pair in ((0, "source,lang,subject"), (3, "source"), (5, "lang"), (6, "subject"), (7, "all")) for x in pair]), F.grouping_id().cast("int"))
    out = sets.agg(name.alias("slice"), F.sum("n_records").alias("n_records"), F.sum("n_tokens").alias("n_tokens"))
    return out.select("corpus", "slice", "source", "lang", "subject", "n_records", "n_tokens")
