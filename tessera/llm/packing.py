"""Filling sequences of a fixed length with documents (problem 6)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe

GROUP_ITEMS = 4096  #: expected items packed together; bounds a task's memory and its local search
STEPS_PER_BIN = 12  #: most exchanges of the local search for each bin of a group; bounds time, never content
SCHEMA = "sequence_id string, n_tokens int, pieces array<struct<doc_id:bigint,start:int,length:int>>, ids array<int>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Largest first, each item into the fullest bin that still takes it. Items over the capacity are refused."""
    if sizes and max(sizes) > capacity:
        raise ValueError("an item is larger than a bin; split it first")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set while some bin has exactly r left
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[item]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[at].append(item)
        else:
            room, at = capacity, len(bins)
            bins.append([item])
        by_room[room - size].append(at)
        open_rooms |= 1 << (room - size)
    return bins


def swap_search(bins: list[list[int]], sizes: list[int], capacity: int, steps_per_bin: int = STEPS_PER_BIN) -> list[list[int]]:
    """Exchange items between underfull bins, raising the sum of squared fills, until bins are empty.

    A step moves one item, exchanges one for one or two for one between any two underfull bins, and is taken
    only if it raises the sum of the squared fills; so free room gathers in few bins, which end empty. The
    least filled bin is served first, by an exchange that fills it exactly if there is one, else by the
    one that raises the sum most; a bin that no exchange helps is passed over and tried again in the next
    sweep. The search ends when a sweep changes nothing, when no packing could have fewer bins, or after
    ``steps_per_bin`` steps for each bin. It never makes more bins than it was given.
    """
    bins = [list(b) for b in bins if b]
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    steps, live = steps_per_bin * len(bins), len(bins)
    exchanges = _Exchanges(bins, fill, sizes, capacity)
    changed = True
    while changed and steps > 0 and live > least:
        changed = False
        for at in sorted(exchanges.under, key=lambda k: (fill[k], k)):
            while steps > 0 and live > least and at in exchanges.under:
                other = exchanges.improve(at)
                if other is None:
                    break
                steps -= 1
                changed = True
                live -= not bins[other]
    return [b for b in bins if b]


class _Exchanges:
    """The underfull bins with the sizes that may leave them: single items, and pairs of items."""

    def __init__(self, bins: list[list[int]], fill: list[int], sizes: list[int], capacity: int):
        self.bins, self.fill, self.sizes, self.capacity = bins, fill, sizes, capacity
        self.under = {k for k in range(len(bins)) if fill[k] < capacity}
        self.ones = {k: self._ones(k) for k in self.under}
        self.twos = {k: self._twos(k) for k in self.under}
        self.pool: tuple[np.ndarray, ...] | None = None

    def _ones(self, k: int) -> np.ndarray:
        return np.unique(np.array([self.sizes[i] for i in self.bins[k]], np.int64))

    def _twos(self, k: int) -> np.ndarray:
        held = np.array([self.sizes[i] for i in self.bins[k]], np.int64)
        left, right = np.triu_indices(len(held), 1)
        return np.unique(held[left] + held[right])

    def _pool(self) -> tuple[np.ndarray, ...]:
        if self.pool is None:
            order = sorted(self.under)
            made = []
            for held in (self.ones, self.twos):
                lengths = [len(held[k]) for k in order]
                made += [np.concatenate([held[k] for k in order]), np.repeat(np.array(order), lengths)]
            self.pool = tuple(made)
        return self.pool

    def improve(self, at: int) -> int | None:
        """Make the exchange that serves bin ``at`` best; the other bin, or nothing where none raises the squares."""
        if len(self.under) < 2:
            return None
        mine, room = self.fill[at], self.capacity - self.fill[at]
        ones, one_of, twos, two_of = self._pool()
        back_ones = np.concatenate([[0], self.ones[at], self.twos[at]])  # what may go back for one item
        best: tuple[int, int, int, int, int] | None = None  # score, bin, size out, size back, items out
        fills = np.array(self.fill)
        for n, (out, of, back) in enumerate(((ones, one_of, back_ones), (twos, two_of, self.ones[at])), 1):
            if not len(out) or not len(back):
                continue
            delta = out[:, None] - back[None, :]
            theirs = fills[of][:, None]
            gain = delta * (mine - theirs + delta)  # half of what the sum of squares rises by
            gain[(delta <= 0) | (delta > room) | (gain <= 0) | (of == at)[:, None]] = 0
            score = gain + (delta == room) * (gain > 0) * (self.capacity**2 * 4)
            i, j = divmod(int(score.argmax()), score.shape[1])
            if score[i, j] > (best[0] if best else 0):
                best = (int(score[i, j]), int(of[i]), int(out[i]), int(back[j]), n)
        if best is None:
            return None
        _, other, out, back, n = best
        given = self._items(other, out, n)
        returned = self._items(at, back, 1 if back in self.ones[at] else 2) if back else ()
        for group, source, target in ((given, other, at), (returned, at, other)):
            for item in group:
                self.bins[source].remove(item)
                self.bins[target].append(item)
                self.fill[source] -= self.sizes[item]
                self.fill[target] += self.sizes[item]
        for k in (at, other):
            if self.bins[k] and self.fill[k] < self.capacity:
                self.ones[k], self.twos[k] = self._ones(k), self._twos(k)
            else:
                self.under.discard(k)
                self.ones.pop(k)
                self.twos.pop(k)
        self.pool = None
        return other

    def _items(self, k: int, size: int, n: int) -> tuple[int, ...]:
        """One or two items of a bin with this size in all."""
        by_size: dict[int, int] = {}
        for item in self.bins[k]:
            if n == 1:
                if self.sizes[item] == size:
                    return (item,)
            elif size - self.sizes[item] in by_size:
                return by_size[size - self.sizes[item]], item
            by_size.setdefault(self.sizes[item], item)
        raise AssertionError("no such items")


def pack_sequences(df: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, group_items: int = GROUP_ITEMS, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> DataFrame:
    """Lay documents out in sequences of ``capacity`` tokens; one row per sequence with its whole content.

    Result: sequence_id, n_tokens, pieces (document, first token, number of tokens, in order) and ids. A
    document longer than a sequence is cut into full sequences and a rest; no other is split. Null and
    empty documents have no tokens and appear in no sequence; rows with the same text or id are packed
    each for itself; columns besides the two named are ignored; an empty table gives no sequence.

    The rests are hashed into groups of about ``group_items`` whatever the size of the corpus, so that no
    source, site or repeated row can gather in one; each group is packed by best fit and then local search.
    Full sequences are passed on as they come. One shuffle; a task holds one group of rests.
    """
    spark = df.sparkSession
    held_ranks = bpe.vocabulary_bytes(vocabulary)
    narrow = "<u2" if max(bpe.read_ranks(held_ranks).values()) < 65_536 else "<i4"  # how ids travel through the shuffle
    width = int(narrow[-1])
    raw = spark.sparkContext.broadcast(held_ranks)  # at most 64 MB, checked
    groups = max(1, -(-df.count() // group_items))  # the row count comes from the parquet footers
    # A few groups a task whatever the session's setting; a group of rests is some megabytes.
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 4)
    keyed = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(doc_id, F.monotonically_increasing_id()).alias("key"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = 256
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                encoder = bpe.of_worker(bpe.PrefixEncoder, raw.value)
                rows: list[tuple] = []
                for doc, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packed = encoder.encode_packed(value) if value else b""
                    n = len(packed) // 4
                    packed = np.frombuffer(packed, "<i4").astype(narrow).tobytes()
                    for start in range(0, n, capacity):
                        length = min(capacity, n - start)
                        rows.append((doc, key, start, length, length == capacity, packed[width * start : width * (start + length)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()), strict=True)],
                    names=["doc_id", "key", "start", "length", "whole", "packed"],
                )

    pieces = keyed.mapInArrow(cut, "doc_id bigint, key bigint, start int, length int, whole boolean, packed binary")
    label = F.when(F.col("whole"), -1 - F.pmod(F.xxhash64("key", "start"), F.lit(groups))).otherwise(F.pmod("key", F.lit(groups)))
    grouped = pieces.select(label.alias("group"), "doc_id", "key", "start", "length", "packed").repartition(partitions, "group").sortWithinPartitions("group", "key", "doc_id", "start")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        for batch in batches:
            sequences: list[tuple[str, list[tuple]]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("group", "doc_id", "start", "length", "packed")), strict=True):
                if row[0] != at:
                    sequences += packed_group(at, held)
                    held, at, n_full = [], row[0], 0
                if row[0] < 0:
                    sequences.append((f"f{-1 - row[0]}-{n_full}", [row]))
                    n_full += 1
                else:
                    held.append(row)
            if sequences:
                yield as_batch(sequences)
        if held:
            yield as_batch(packed_group(at, held))

    def packed_group(group: int | None, rows: list[tuple]) -> list[tuple[str, list[tuple]]]:
        sizes = [row[3] for row in rows]
        bins = swap_search(best_fit(sizes, capacity), sizes, capacity)
        return [(f"r{group}-{i}", [rows[k] for k in b]) for i, b in enumerate(bins)]

    def as_batch(sequences: list[tuple[str, list[tuple]]]) -> pa.RecordBatch:
        rows = [row for _, content in sequences for row in content]
        ends = np.cumsum([0, *(len(content) for _, content in sequences)]).astype(np.int32)
        fills = [sum(row[3] for row in content) for _, content in sequences]
        entries = pa.StructArray.from_arrays([pa.array([row[1] for row in rows], pa.int64()), pa.array([row[2] for row in rows], pa.int32()), pa.array([row[3] for row in rows], pa.int32())], names=["doc_id", "start", "length"])
        flat = pa.Array.from_buffers(pa.int32(), sum(fills), [None, pa.py_buffer(np.frombuffer(b"".join(row[4] for row in rows), narrow).astype("<i4").tobytes())])
        columns = [pa.array([name for name, _ in sequences]), pa.array(fills, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), entries), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *fills]).astype(np.int32)), flat)]
        return pa.RecordBatch.from_arrays(columns, names=["sequence_id", "n_tokens", "pieces", "ids"])

    return grouped.mapInArrow(lay_out, SCHEMA)


def fill_report(sequences: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequences, tokens, unused room and share of use, in one row (nulls besides zero counts where there is none)."""
    return sequences.agg(
        F.count(F.lit(1)).alias("n_sequences"),
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.sum(F.lit(capacity) - F.col("n_tokens")), F.lit(0)).alias("unused"),
        (F.sum("n_tokens") / (F.count(F.lit(1)) * capacity)).alias("utilization"),
    )
