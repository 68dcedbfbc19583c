"""Near-duplicate texts by word shingles: exact Jaccard links between classes of equal sets, without candidate caps.

Candidates come from prefix filtering. Put the shingles of all sets into one order; two sets whose similarity is s or
more share a shingle among the first size - ceil(s * size) + 1 of each. The order begins with the shingles that are not
frequent, so that stock phrases meet only where a set has little else. A meeting counts only if the two sets can still
be similar when it is their first, by their sizes and the places of the shingle; pairs that pass are compared by maps of
parities, which differ in at most as many bits as the sets in elements, and for what is left the sets are made again
from the texts and compared exactly. No test loses a pair.

Shingle sets take more room than their texts, so none is written or shuffled but those last ones: the texts are read
three times, and a text leaves its task as a digest, a map of about one bit a shingle, and a prefix of six bytes a shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import spread, written

SIDE = 1024  #: sets that are compared with each other at once; a larger meeting is split into blocks of that size
FREQUENT = 16  #: sets that hold a shingle before it counts as frequent
MOST_FREQUENT = 500_000  #: frequent shingles that are told apart by their counts (16 bytes each for every worker); beyond, the bound above rises
COUNTED = 2_000_000  #: shingles that are counted at once
PART = 500_000  #: shingles of prefixes that one part holds, about
MOST_SENT = 2_000_000  #: keys that are sent to every worker
BITS = 256
MOST_BITS = 8192
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9))


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[str], known: dict[str, int], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; fewer words are one shingle."""
    ids = np.array([known[w] for w in words], np.uint64)
    if len(ids) < n:
        ids = np.concatenate([ids, np.zeros(n - len(ids), np.uint64)])
    out = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        out = mixed(out + ids[k : len(ids) - n + 1 + k], 0) + np.uint64(k)
    return np.unique(out)


class _Words(dict):
    """64-bit hashes of words, remembered by a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = made = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return made


_WORDS = _Words()


def all_hashes(texts: list[list[str]], n: int) -> list[np.ndarray]:
    """shingle_hashes of each text, hashed in one piece."""
    ids, ends = [], []
    for words in texts:
        ids += [_WORDS[w] for w in words]
        ids += [0] * (n - len(words))
        ends.append(len(ids))
    flat = np.array(ids, np.uint64)
    out = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for k in range(n):
        out = mixed(out + flat[k : len(out) + k], 0) + np.uint64(k)
    sets = []
    for a, b in zip([0, *ends[:-1]], ends, strict=False):
        held = np.sort(out[a : b - n + 1])
        same = held[1:] == held[:-1]
        sets.append(held[np.append(True, ~same)] if same.any() else held)
    return sets


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t) without null keys and texts."""
    return spread(df.select(F.col(key).alias("id"), F.col(text).alias("t"))).filter("id IS NOT NULL AND t IS NOT NULL")


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Ids and shingle sets of the texts with words, about 1,024 at once."""
    for whole in batches:
        for batch in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
            words = [t.lower().split() for t in batch.column(1).to_pylist()]  # white space of any script, as in the normal form
            yield batch.column(0).filter(pa.array([bool(w) for w in words], pa.bool_())), all_hashes([w for w in words if w], n)


def digests(sets: list[np.ndarray]) -> list[bytes]:
    """128 bits for each set, which equal sets share."""
    if not sets:
        return []
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    sums = [np.add.reduceat(mixed(flat, k), starts) for k in (1, 2)]  # sums wrap around
    return [x.to_bytes(8, "big") + y.to_bytes(8, "big") for x, y in zip(*(v.tolist() for v in sums), strict=True)]


def frequent_shingles(tables: list[DataFrame], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, ranks): the frequent shingles of all tables (id, t), sorted, and their place in the order of their counts.

    Counts are made over all sets, first over COUNTED shingles at a time, where those met once are left out: they are
    most of all shingles and not frequent. Only the order depends on the counts, never a result; so the bound is raised
    until at most MOST_FREQUENT remain, and what is collected is bounded by that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held).view(np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[counts > 1]), pa.array(counts[counts > 1])], names=["s", "c"])

        held, size = [], 0
        for _, sets in _sets(batches, n):
            held += sets
            size += sum(map(len, sets))
            if size > COUNTED:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    parts = [df.mapInArrow(run, "s bigint, c bigint") for df in tables]
    counts = written(reduce(DataFrame.unionByName, parts).groupBy("s").agg(F.sum("c").alias("c")).filter(F.col("c") > FREQUENT))
    least = FREQUENT
    while counts.filter(F.col("c") > least).count() > MOST_FREQUENT:
        least *= 4
    held = counts.filter(F.col("c") > least).toArrow()
    values, often = held.column("s").to_numpy().view(np.uint64), held.column("c").to_numpy()
    ranks = np.empty(len(values), np.int64)
    ranks[np.lexsort((values, often))] = np.arange(len(values))
    order = np.argsort(values)
    return values[order], ranks[order]


def prefix(held: np.ndarray, least: float, values: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The shingles by which a set can be found, the first of the common order."""
    n = len(held) - math.ceil(least * len(held) - 1e-9) + 1
    if not len(values):
        return held[:n]
    at = np.minimum(np.searchsorted(values, held), len(values) - 1)
    often = values[at] == held
    rare = held[~often]
    return rare[:n] if len(rare) >= n else np.concatenate([rare, held[often][np.argsort(ranks[at[often]])]])[:n]


def width(size: int) -> int:
    """Bits of the map for a set, a power of two of at least its size: smaller maps of large sets would tell nothing."""
    return min(max(64, 1 << (size - 1).bit_length()), MOST_BITS)


def parities(held: np.ndarray, bits: int = BITS) -> bytes:
    """A bit for each class of hashes: is the number of elements in it odd? Maps of half as many bits are its halves' xor."""
    return np.packbits((np.bincount((mixed(held, 2) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def alike(x: int, p: bytes, y: int, q: bytes, least: float) -> bool:
    """May two sets have the similarity, by their sizes and their maps of any widths?"""
    p, q = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    while len(p) != len(q):
        p, q = (p, q[: len(q) // 2] ^ q[len(q) // 2 :]) if len(p) < len(q) else (p[: len(p) // 2] ^ p[len(p) // 2 :], q)
    return bool(min(x, y) >= least * max(x, y) - 1e-9 and np.bitwise_count(p ^ q).sum() <= (x + y) * ((1 - least) / (1 + least)) + 1e-6)


def passing(sizes: tuple[np.ndarray, np.ndarray], bits: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Which pairs of two lists of sets may have the similarity, by sizes and parities."""
    x, y = sizes[0][:, None].astype(np.float64), sizes[1][None, :].astype(np.float64)
    good = (x >= least * y - 1e-9) & (y >= least * x - 1e-9)
    differ = np.zeros(good.shape, np.uint16)
    for k in range(BITS // 64):
        differ += np.bitwise_count(bits[0][:, k][:, None] ^ bits[1][:, k][None, :])
    return good & (differ <= (x + y) * ((1 - least) / (1 + least)) + 1e-9)


def sketched(texts: DataFrame, least: float, n: int, order: Broadcast) -> DataFrame:
    """(ref, id, digest, size, bits, heads), written: a row a text with its prefix, cut to 48 bits a shingle.

    Cut shingles that agree by chance meet once more and lose nothing. ``ref`` numbers the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = TaskContext.get().partitionId() << 33
        for ids, sets in _sets(batches, n):
            heads = [prefix(s, least, *order.value) for s in sets]
            cut = [(h >> np.uint64(32)).astype(np.uint32).tobytes() + (h & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for h in heads]
            refs = np.arange(ref, ref + len(sets))
            ref += len(sets)
            binary = (digests(sets), [parities(s, width(len(s))) for s in sets], cut)
            told = [pa.array(x, pa.binary()) for x in binary]
            yield pa.RecordBatch.from_arrays([pa.array(refs), ids, told[0], pa.array([len(s) for s in sets], pa.int32()), *told[1:]], names=["ref", "id", "digest", "size", "bits", "heads"])

    return written(texts.mapInArrow(run, f"ref bigint, id {texts.schema['id'].dataType.simpleString()}, digest binary, size int, bits binary, heads binary"))


def _few(df: DataFrame) -> DataFrame:
    """Keys that are sent to every worker as long as they are no more than MOST_SENT; more are joined by an exchange."""
    df = written(df)
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def _near(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """May sets of sizes x and y be similar whose first common shingle is at places i and j of the order?"""
    return (x >= least * y - 1e-9) & (y >= least * x - 1e-9) & (np.minimum(x - i, y - j) >= (x + y) * (least / (1 + least)) - 1e-6)


def similar(texts: list[DataFrame], tables: list[DataFrame], chosen: list[DataFrame], least: float, n: int) -> DataFrame:
    """(left, right, similarity) of all pairs of digests with Jaccard similarity ``least`` or more; of one table each pair once.

    ``texts`` (id, t) are read again for the sets of the pairs that pass the tests; ``tables`` are their sketches and
    ``chosen`` (ref, id, digest) a row for each class. The prefixes are dealt out by shingle, packed by columns, and
    meet in one pass for each part. A meeting of more than SIDE sets is cut into blocks of about that size, whose pairs
    of blocks are keys of their own, so that a meeting of any size is spread over tasks.
    """
    own = len(texts) == 1
    cores = texts[0].sparkSession.sparkContext.defaultParallelism
    heads = sum(t.agg(F.coalesce(F.sum(F.octet_length("heads")), F.lit(0))).first()[0] // 6 for t in tables)
    n_parts = min(max(2 * cores, -(-heads // PART)), 1 << 16)

    def packing(role: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = batch.column(2).to_pylist()
                lengths = np.array([len(h) // 6 for h in held], np.int64)
                if not len(held):
                    continue
                high = np.frombuffer(b"".join(h[: len(h) // 6 * 4] for h in held), np.uint32)
                part = np.frombuffer(b"".join(h[len(h) // 6 * 4 :] for h in held), np.uint16).astype(np.int64) * n_parts >> 16
                places = np.minimum(np.arange(len(high)) - np.repeat(np.cumsum(lengths) - lengths, lengths), 0xFFFF).astype(np.uint16)  # a smaller place only lets more pass
                refs, sizes = (np.repeat(batch.column(k).to_numpy(zero_copy_only=False), lengths) for k in (0, 1))
                by = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[by], prepend=-1))
                packed = []
                for a, b in zip(edges, [*edges[1:], len(by)], strict=True):
                    rows = by[a:b]
                    whole = high[rows].tobytes() + np.diff(refs[rows], prepend=0).tobytes() + places[rows].tobytes() + sizes[rows].astype(np.int32).tobytes()
                    packed.append(pa.compress(whole, "zstd", asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array(part[by][edges], pa.int32()), pa.array([role] * len(packed), pa.int32()), pa.array(np.diff([*edges, len(by)]), pa.int32()), pa.array(packed, pa.binary())], names=["part", "role", "n", "packed"])

        return pack

    packed = []
    for k, (table, taken) in enumerate(zip(tables, chosen, strict=True)):
        copies = _few(table.select("ref").join(taken.select("ref"), "ref", "left_anti"))
        packed.append(table.select("ref", "size", "heads").join(copies, "ref", "left_anti").mapInArrow(packing(2 if own else k), "part int, role int, n int, packed binary"))

    def pairs_of(refs: np.ndarray, sizes: np.ndarray, places: np.ndarray, roles: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows p, q with one shingle those that pass, as refs (left, right)."""
        good = ((roles[p] == 2) & (roles[q] == 2) & (refs[p] != refs[q])) | (roles[p] + roles[q] == 1)
        good &= _near(sizes[p], sizes[q], places[p], places[q], least)
        p, q = p[good], q[good]
        turned = (roles[p] > roles[q]) | (own & (refs[p] > refs[q]))
        return refs[np.where(turned, q, p)], refs[np.where(turned, p, q)]

    def told(pairs: list[tuple[np.ndarray, np.ndarray]], large: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.concatenate([np.stack(x, 1) for x in pairs] or [np.zeros((0, 2), np.int64)]), axis=0)
        blank = pa.nulls(len(both), pa.int64())
        rest = large or [np.zeros(0, np.int64)] * 5
        columns = [pa.concat_arrays([pa.array(both[:, k]), pa.nulls(len(rest[0]), pa.int64())]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, *[pa.concat_arrays([blank, pa.array(x.astype(np.int64))]) for x in rest]], names=["left", "right", "s", "ref", "size", "place", "role"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that pass in each part; of meetings of more than SIDE rows these rows. Parts come sorted."""
        at, held = None, []

        def close() -> pa.RecordBatch:
            columns = []
            for m, data in held:
                raw, cuts = pa.decompress(data, 18 * m, "zstd", asbytes=True), (0, 4 * m, 12 * m, 14 * m, 18 * m)
                got = [np.frombuffer(raw[a:b], t).astype(np.int64) for a, b, t in zip(cuts[:-1], cuts[1:], (np.uint32, np.int64, np.uint16, np.int32), strict=True)]
                columns.append((got[0], np.cumsum(got[1]), got[2], got[3]))
            s, refs, places, sizes = (np.concatenate(x) for x in zip(*columns, strict=True))
            roles = np.repeat(given, [m for m, _ in held])
            by = np.argsort(s, kind="stable")
            s, refs, places, sizes, roles = s[by], refs[by], places[by], sizes[by], roles[by]
            starts = np.flatnonzero(np.diff(s, prepend=-1))
            lengths = np.diff([*starts, len(s)])
            big = np.repeat(lengths > SIDE, lengths)
            large = [np.int64(at) << 32 | s[big], refs[big], sizes[big], places[big], roles[big]]
            s, refs, places, sizes, roles = s[~big], refs[~big], places[~big], sizes[~big], roles[~big]
            found, p, lag = [], np.arange(len(s)), 1
            while len(p):  # each row against the lag-th after it, as long as the shingle is the same
                p = p[p + lag < len(s)]
                p = p[s[p + lag] == s[p]]
                found.append(pairs_of(refs, sizes, places, roles, p, p + lag))
                lag += 1
            return told(found, large)

        given = []
        for batch in batches:
            for part, role, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    if held:
                        yield close()
                    at, held, given = part, [], []
                held.append((m, data))
                given.append(role)
        if held:
            yield close()

    row = ["s", "ref", "size", "place", "role"]
    first = reduce(DataFrame.unionByName, packed).repartition("part").sortWithinPartitions("part")
    met = written(first.mapInArrow(meet, "left bigint, right bigint, " + ", ".join(f"{c} bigint" for c in row)))
    # Large meetings: block i against block j, each pair of blocks a key. A row goes to as many keys as there are blocks.
    rows = met.filter("s IS NOT NULL").select(*row)
    counts = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    placed = rows.join(counts, "s").withColumn("blocks", F.ceil(F.col("n") / F.lit(SIDE)).cast("int")).withColumn("block", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    if own:
        placed = placed.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    else:
        placed = placed.withColumn("i", F.when(F.col("role") == 0, F.col("block")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("block")))

    def meet_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs that pass among rows of equal (s, i, j), which come sorted."""
        at, held = None, []

        def close() -> pa.RecordBatch:
            refs, sizes, places, roles, blocks = (np.concatenate(x) for x in zip(*held, strict=True))
            inner = own and at[1] != at[2]  # of two blocks only pairs across
            a, b = (np.flatnonzero(blocks == k) for k in at[1:]) if inner else (np.arange(len(refs)),) * 2
            pairs = []
            for k in range(0, len(a), SIDE):
                p, q = (x.ravel() for x in np.meshgrid(a[k : k + SIDE], b, indexing="ij"))
                ahead = slice(None) if inner else p < q
                pairs.append(pairs_of(refs, sizes, places, roles, p[ahead], q[ahead]))
            return told(pairs, [])

        for batch in batches:
            if not batch.num_rows:
                continue
            s, i, j, *rest = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(8))
            cuts = [0, *(np.flatnonzero((np.diff(s) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist(), len(s)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if (key := (int(s[a]), int(i[a]), int(j[a]))) != at:
                    if held:
                        yield close()
                    at, held = key, []
                held.append([x[a:b] for x in rest])
        if held:
            yield close()

    second = placed.select("s", "i", "j", "ref", "size", "place", "role", "block").repartition("s", "i", "j").sortWithinPartitions("s", "i", "j")
    pairs = met.filter("s IS NULL").select("left", "right").unionByName(second.mapInArrow(meet_blocks, met.schema).select("left", "right")).distinct()

    # Sizes and parities of the pairs, then the sets of those that are left, from their texts.
    told_bits = [t.select(F.col("ref").alias(side), F.col("size").alias(f"{side}_size"), F.col("bits").alias(f"{side}_bits")) for side, t in (("left", tables[0]), ("right", tables[-1]))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: batch.column(c).to_pylist() for c in ("left_size", "left_bits", "right_size", "right_bits")}
            good = [alike(*x, least) for x in zip(*at.values(), strict=True)]
            yield batch.select(["left", "right"]).filter(pa.array(good, pa.bool_()))

    left = written(pairs.join(told_bits[0], "left").join(told_bits[1], "right").mapInArrow(compare, "left bigint, right bigint"))
    named = left
    for side, taken in (("left", chosen[0]), ("right", chosen[-1])):
        named = named.join(taken.select(F.col("ref").alias(side), F.col("id").alias(f"{side}_id"), F.col("digest").alias(f"{side}_digest")), side)
    named = written(named)
    wanted = [named.select(F.col(f"{side}_id").alias("id"), F.col(f"{side}_digest").alias("digest")) for side in ("left", "right")]
    wanted = [wanted[0].unionByName(wanted[1])] if own else wanted

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(digests(sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "set"])

    sets = []
    for df, some in zip(texts, wanted, strict=True):
        made = df.join(_few(some.select("id").distinct()), "id", "left_semi").mapInArrow(again, "digest binary, set binary")
        sets.append(made.groupBy("digest").agg(F.first("set").alias("set")))
    full = named.select(F.col("left_digest").alias("left"), F.col("right_digest").alias("right"))
    for side, made in (("left", sets[0]), ("right", sets[-1])):
        full = full.join(made.select(F.col("digest").alias(side), F.col("set").alias(f"{side}_set")), side)

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        made = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            made.append(shared / (len(p) + len(q) - shared))
        return pd.Series(made, dtype="float64")

    return written(full.select("left", "right", jaccard("left_set", "right_set").alias("similarity")).filter(F.col("similarity") >= least))


def near_duplicates(df: DataFrame, key: str, text: str, n: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, links): every document with its class of equal shingle sets, and the pairs of classes with Jaccard >= least.

    Classes stand for their copies, so copies are never paired. No link between different texts is lost. Texts
    without words are in no class; rows with the same key are one document, by the set of the smallest digest.
    """
    texts = _texts(df, key, text)
    table = sketched(texts, least, n, df.sparkSession.sparkContext.broadcast(frequent_shingles([texts], n)))
    one = table.groupBy("id").agg(F.min("digest").alias("digest"))
    classes = written(one.groupBy("digest").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("n_members")))
    membership = one.join(classes, "digest").select(F.col("id").alias(key), "class", "n_members")
    chosen = written(table.groupBy("digest").agg(F.min("ref").alias("ref")).join(classes.select("digest", F.col("class").alias("id")), "digest"))
    links = similar([texts], [table], [chosen], least, n)
    for side in ("left", "right"):
        links = links.join(classes.select(F.col("digest").alias(side), F.col("class").alias(f"{side}_class")), side)
    return membership, links.select(F.least("left_class", "right_class").alias("class"), F.greatest("left_class", "right_class").alias("other"), "similarity")


def duplicate_report(membership: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row per document: class, members of the class, links of the class to other classes."""
    ends = links.select(F.explode(F.array("class", "other")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return membership.join(ends, "class", "left").select(key, "class", "n_members", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
