"""Leakage of evaluation items by exact match, by containment of the normal form, and by similar word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as X
from tessera.operators import neardup
from tessera.plans.session import spread, written

BLOCK_BYTES = 32 << 20  #: item text that a worker is sent at a time; more items are more blocks


def _items(items: DataFrame, key: str, text: str) -> DataFrame:
    return items.filter(~X.blank(F.col(text))).select(F.col(key).alias("item"), X.normal_form(F.col(text)).alias("item_text")).distinct()


def exact_matches(items: DataFrame, key: str, text: str, corpus: DataFrame, corpus_text: str) -> DataFrame:
    """Items whose text equals some corpus text in normal form: one row per item with ``leaked``.

    Both sides are compared by a 128-bit hash, so that no text is shuffled.
    """
    digest = F.md5(F.col("t").cast("binary"))
    known = corpus.filter(~X.blank(F.col(corpus_text))).select(X.normal_form(F.col(corpus_text)).alias("t")).select(digest.alias("digest")).distinct().withColumn("hit", F.lit(True))
    named = _items(items, key, text).select("item", F.md5(F.col("item_text").cast("binary")).alias("digest"))
    return named.join(known, "digest", "left").select("item", F.coalesce("hit", F.lit(False)).alias("leaked"))


_MADE: dict[int, tuple[object, ahocorasick.Automaton]] = {}


def _automaton(held: list[tuple[object, str]]) -> ahocorasick.Automaton:
    """The automaton of a block's texts, one per Python worker; a text carries all items that have it."""
    if id(held) not in _MADE:
        _MADE.clear()
        of: dict[str, list] = {}
        for item, text in held:
            of.setdefault(" ".join(text.lower().split()), []).append(item)
        made = ahocorasick.Automaton()
        for text, names in of.items():
            made.add_word(text, tuple(names))
        made.make_automaton()
        _MADE[id(held)] = (held, made)
    return _MADE[id(held)][1]


def containments(items: DataFrame, key: str, text: str, corpus: DataFrame, corpus_key: str, corpus_text: str) -> DataFrame:
    """(item, record) wherever the item's normal form stands inside the record's, each pair once.

    The items, long and short alike, form an Aho-Corasick automaton that reads each record once; the time does not
    grow with the items. They go to the workers in blocks of about BLOCK_BYTES of text, and the corpus is read once
    per block and never shuffled. Null and blank texts match nothing; equal items each come out.
    """
    named = _items(items, key, text)
    total = named.agg(F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // BLOCK_BYTES))
    records = spread(corpus.select(F.col(corpus_key).alias("record"), F.col(corpus_text).alias("t"))).filter("t IS NOT NULL")
    kinds = named.schema["item"].dataType.simpleString(), records.schema["record"].dataType.simpleString()
    item_type = to_arrow_type(named.schema["item"].dataType)
    found = []
    for k in range(n_blocks):
        block = named.filter(F.pmod(F.xxhash64("item_text"), F.lit(n_blocks)) == k).collect()
        shared = items.sparkSession.sparkContext.broadcast([tuple(r) for r in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = shared.value
                automaton = _automaton(held)
                rows, names = [], []
                if held:
                    for i, t in enumerate(batch.column(1).to_pylist()):
                        t = " ".join(t.lower().split())  # the normal form
                        for name in {n for _, here in automaton.iter(t) for n in here}:
                            rows.append(i)
                            names.append(name)
                yield pa.RecordBatch.from_arrays([pa.array(names, item_type), batch.column(0).take(pa.array(rows, pa.int64()))], names=["item", "record"])

        found.append(records.mapInArrow(run, f"item {kinds[0]}, record {kinds[1]}"))
    return reduce(DataFrame.unionByName, found).distinct()


def similar_items(items: DataFrame, key: str, text: str, corpus: DataFrame, corpus_key: str, corpus_text: str, least: float = 0.9, n: int = 5) -> DataFrame:
    """(item, record, similarity) of items and records whose word shingles have a Jaccard similarity of ``least`` or more.

    Exact by the same keys as near duplicates; each side's equal shingle sets are one class until the end.
    """
    texts = [neardup._texts(df.select(F.col(k).cast("string").alias("k"), F.col(c).alias("t")), "k", "t") for df, k, c in ((items, key, text), (corpus, corpus_key, corpus_text))]
    order = items.sparkSession.sparkContext.broadcast(neardup.frequent_shingles(texts, n))
    tables = [neardup.sketched(df, least, n, order) for df in texts]
    chosen = [written(t.groupBy("digest").agg(F.min_by("id", "ref").alias("id"), F.min("ref").alias("ref"))) for t in tables]
    named = neardup.similar(texts, tables, chosen, least, n)
    for side, name, t in (("left", "item", tables[0]), ("right", "record", tables[1])):
        named = named.join(t.select(F.col("id").alias(name), F.col("digest").alias(side)).distinct(), side)
    return named.select("item", "record", "similarity")


def leak_report(items: DataFrame, key: str, by: str, leaked: DataFrame) -> DataFrame:
    """Items, leaked items, rate and the sorted ids of the leaked ones of each data set."""
    named = items.select(F.col(key).alias("item"), F.lower(F.trim(F.col(by))).alias(by)).distinct()
    flags = named.join(leaked.select("item").distinct().withColumn("hit", F.lit(1)), "item", "left")
    return flags.groupBy(by).agg(F.count(F.lit(1)).alias("n_items"), F.count("hit").alias("n_leaked"), (F.count("hit") / F.count(F.lit(1))).alias("rate"))


def leak_totals(items: DataFrame, key: str, by: str, leaked: DataFrame) -> DataFrame:
    """The report with a row for all data sets together (``by`` is null there and ``total`` true) and the sorted ids of the leaked items."""
    named = items.filter(F.col(by).isNotNull()).select(F.col(key).alias("item"), F.lower(F.trim(F.col(by))).alias(by)).distinct()
    flags = named.join(leaked.select("item").distinct().withColumn("hit", F.lit(1)), "item", "left")
    ids = F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("hit").isNotNull(), F.col("item")))))
    return flags.rollup(by).agg((F.grouping(by) == 1).alias("total"), F.count(F.lit(1)).alias("n_items"), F.count("hit").alias("n_leaked"), ids.alias("items"))
