"""Evaluation texts that leaked into training text (problem 2).

Rare word n-grams of the test items seed the search; a Smith-Waterman alignment of words decides. The items
are a reference set of known size: they go to the workers in blocks of about BLOCK_ITEMS or BLOCK_BYTES,
and every block is held against all records. Items with the same text are one passage that carries all their
ids; a passage is never passed over because many items share its words.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 20_000  #: items in a block; more items mean more blocks, never fewer items
BLOCK_BYTES = 32 << 20  #: text of the items of a block, which is what a worker is sent at a time
GRAM = 4  #: words of a seed
COMMON = 8  #: seeds that more passages hold need not be tried, where a quotation must hold rarer ones too
SHARE = 0.5  #: part of an item's words that a passage covers
ALTERED = 0.1  #: altered or missing words in a passage
SLACK = 1.5  #: altered words granted besides, since the share is of a short stretch
NUMBER = 3.0  #: what another number in a number's place counts; one altered number is a typing error, several make another problem
INSERTED = 6  #: words of a short insertion
BAND = 16  #: how far words may be shifted against a seed before its neighbourhood is not worth an alignment
LEAST_WORDS = 8  #: of items shorter than that a part could be a stock phrase; they count as a whole only
SLICE_BYTES = 8 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W_]+")
_IDEOGRAPH = re.compile("[々ぁ-ゖァ-ヺ㐀-䶿一-鿿𠀀-𳎯]")
_WORD_OR_IDEOGRAPH = re.compile(rf"{_IDEOGRAPH.pattern}|[^\W_{_IDEOGRAPH.pattern[1:]}+")
_TAG = re.compile(r"</?[a-z][^<>]{0,80}>")
_COMMAND = re.compile(r"\\[a-z]+")
_ENTITY = re.compile(r"&(?:[a-z]{2,8}|#\d{1,6}|#x[0-9a-f]{1,5});")
_UNSEEN = re.compile("[­​-‏⁠﻿]")


def words(text: str) -> list[str]:
    """Words in lower case without markup, punctuation and invisible characters; each ideograph is a word."""
    word = _WORD
    if not text.isascii():
        text = _UNSEEN.sub("", text)
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _IDEOGRAPH.search(text):
            word = _WORD_OR_IDEOGRAPH
    text = text.lower()
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    return word.findall(text)


class _Vocabulary(dict):
    """Word ids; of words that no item has, numbers are -1 and all others 0."""

    def __missing__(self, word: str) -> int:
        return -1 if word.isdigit() else 0


def align(item: np.ndarray, text: np.ndarray, gap: int = 2) -> list[tuple[int, int]]:
    """Smith-Waterman over word ids (2 for equal words, -2 otherwise and for each word of a gap; 0 and -1 equal nothing).

    The path of the best local alignment as (item position, text position) pairs, -1 where one side has a gap.
    """
    n, m = len(item), len(text)
    score = np.zeros((n + 1, m + 1), np.int32)
    ramp = gap * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(score[i - 1, 1:] - gap, score[i - 1, :-1] + np.where(text == item[i - 1], 2, -2))
        np.maximum(row, 0, out=row)
        full = score[i]
        full[1:] = row
        full += ramp  # a gap in the item costs the same for each word, so the best start is a running maximum
        np.maximum.accumulate(full, out=full)
        full -= ramp
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    path = []
    while i and j and score[i, j] > 0:
        if score[i, j] == score[i - 1, j - 1] + (2 if text[j - 1] == item[i - 1] else -2):
            i, j = i - 1, j - 1
            path.append((int(i), int(j)))
        elif score[i, j] == score[i - 1, j] - gap:
            i -= 1
            path.append((int(i), -1))
        else:
            j -= 1
            path.append((-1, int(j)))
    return path[::-1]


def longest_stretch(costs: list[float], covers: list[int], rate: float, slack: float) -> int:
    """Most item words in a run of path steps whose cost is at most rate * words + slack."""
    cost = np.concatenate([[0.0], np.cumsum(costs)])
    cover = np.concatenate([[0], np.cumsum(covers)])
    spent = cost[None, :] - cost[:, None]
    covered = cover[None, :] - cover[:, None]
    return int(np.where(spent <= rate * covered + slack, covered, 0).max())


class ItemIndex:
    """Seeds and words of a block of items, as a worker needs them."""

    def __init__(self, items: Iterable[tuple[str, str | None, str | None]]):
        self.names: list[tuple[str, ...]] = []
        self.passages: list[np.ndarray] = []
        self.vocabulary = _Vocabulary()
        self.numbers: set[int] = set()
        classes: dict[bytes, set[str]] = {}  # equal passages are one, with the names of all items that have it
        for name, *texts in items:
            for text in texts:
                found = words(text) if text else []
                if len(found) < GRAM:
                    continue  # fewer words than a seed are a stock phrase
                ids = np.array([dict.setdefault(self.vocabulary, w, len(self.vocabulary) + 1) for w in found], np.int32)
                classes.setdefault(ids.tobytes(), set()).add(name)
        for held, names in classes.items():
            self.names.append(tuple(sorted(names)))
            self.passages.append(np.frombuffer(held, np.int32))
        self.numbers = {i for w, i in self.vocabulary.items() if w.isdigit()}
        keys, owner, at = [], [], []
        for p, ids in enumerate(self.passages):
            k = self._keys(ids, np.arange(len(ids) - GRAM + 1))
            keys.append(k)
            owner.append(np.full(len(k), p, np.int32))
            at.append(np.arange(len(k), dtype=np.int32))
        all_keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        order = np.argsort(all_keys, kind="stable")
        self.owner, self.at = (np.concatenate(x)[order] if keys else np.zeros(0, np.int32) for x in (owner, at))
        self.keys, self.first, self.count = np.unique(all_keys[order], return_index=True, return_counts=True)
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.needed = np.array([self._surviving(len(ids)) for ids in self.passages], np.int32)
        count = self.count[np.searchsorted(self.keys, all_keys)]
        ends = np.cumsum([len(k) for k in keys])
        self.anchor = np.concatenate([self._anchors(len(ids), of) for ids, of in zip(self.passages, np.split(count, ends[:-1]), strict=True)])[order] if keys else np.zeros(0, bool)

    @classmethod
    def _surviving(cls, n: int) -> int:
        """Fewest seeds that a text still holds of an accepted passage of an item of n words."""
        if n < LEAST_WORDS:
            return n - GRAM + 1
        return min(cls._unbroken(k) for k in range(cls._least(n), n + 1))

    @staticmethod
    def _unbroken(k: int) -> int:
        """Seeds of a stretch of k words that its altered words and one insertion leave, 1 at least."""
        return max(1, k - GRAM + 1 - GRAM * int(ALTERED * k + SLACK) - (GRAM - 1))

    @classmethod
    def _anchors(cls, n: int, count: np.ndarray) -> np.ndarray:
        """The seeds of which an accepted passage must hold one.

        Of the seeds that more than COMMON passages share, the commonest are left out as long as fewer are left
        out in every stretch than that stretch keeps unbroken; so each accepted passage still holds an anchor.
        """
        anchor = np.ones(len(count), bool)
        common = np.flatnonzero(count > COMMON)
        if n < LEAST_WORDS or not len(common) or cls._surviving(n) < 2:
            return anchor
        spans = {cls._least(n)} | {k for k in range(cls._least(n), n + 1) if cls._unbroken(k) < cls._unbroken(k - 1)} | {n}
        for at in common[np.argsort(-count[common], kind="stable")].tolist():
            anchor[at] = False
            out = np.concatenate([[0], np.cumsum(~anchor)])
            if any(int((out[k - GRAM + 1 :] - out[: len(out) - k + GRAM - 1]).max()) >= cls._unbroken(k) for k in spans):
                anchor[at] = True
        return anchor

    @staticmethod
    def _least(n: int) -> int:
        return math.ceil(SHARE * n)

    @staticmethod
    def _keys(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        key = np.zeros(len(starts), np.uint64)
        for k in range(GRAM):
            key = (key + ids[starts + k].astype(np.uint64)) * _MULTIPLIER
            key ^= key >> np.uint64(29)
        return key

    def search(self, texts: list[str]) -> list[set[int]]:
        """Passages found in each text."""
        found: list[set[int]] = [set() for _ in texts]
        if not len(self.keys):
            return found
        look = self.vocabulary.__getitem__
        parts = [np.fromiter(map(look, w), np.int32, len(w)) for w in map(words, texts)]
        ends = np.cumsum([len(p) + 1 for p in parts])
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)  # a 0 after each text, which no seed crosses
        for part, end in zip(parts, ends.tolist(), strict=True):
            ids[end - 1 - len(part) : end - 1] = part
        known = ids > 0
        whole = known[: len(ids) - GRAM + 1].copy() if len(ids) >= GRAM else np.zeros(0, bool)
        for k in range(1, GRAM):
            whole &= known[k : len(ids) - GRAM + 1 + k]
        starts = np.flatnonzero(whole)
        keys = self._keys(ids, starts)
        passed = self.screen[(keys >> np.uint64(44)).astype(np.int64)]
        starts, keys = starts[passed], keys[passed]
        which = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = self.keys[which] == keys
        starts, which = starts[same], which[same]
        if not len(starts):
            return found
        record = np.searchsorted(ends, starts, side="right")
        for r in np.unique(record).tolist():
            of = record == r if len(starts) < 4096 else slice(*np.searchsorted(record, [r, r + 1]))
            self._judge(ids, starts[of], which[of], int(ends[r] - 1 - len(parts[r])), int(ends[r] - 1), found[r])
        return found

    def _judge(self, ids: np.ndarray, starts: np.ndarray, which: np.ndarray, low: int, high: int, found: set[int]) -> None:
        """Align the passages of which a text holds enough seeds, an anchor among them."""
        count = self.count[which]
        total = int(count.sum())
        if total < int(self.needed.min()):
            return
        at_seed = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
        owner, item_at = self.owner[at_seed], self.at[at_seed]
        text_at = np.repeat(starts, count)
        present, place = np.unique(owner, return_inverse=True)
        hits = np.bincount(place)
        anchored = np.bincount(place, weights=self.anchor[at_seed]) > 0
        for p in present[(hits >= self.needed[present]) & anchored].tolist():
            item, mine = self.passages[p], owner == p
            places, at_item = text_at[mine], item_at[mine]
            if len(item) < LEAST_WORDS:
                if any(np.array_equal(ids[t : t + len(item)], item) for t in places[at_item == 0].tolist()):
                    found.add(p)
                continue
            for cluster in np.split(np.arange(len(places)), np.flatnonzero(np.diff(places) > len(item)) + 1):
                if len(cluster) < self.needed[p] or not any(self._worth(item, ids, d, low, high) for d in np.unique(places[cluster] - at_item[cluster]).tolist()):
                    continue
                # Pieces with overlap, so that a stretch of the item is whole in one however long the cluster is.
                first, last = int(places[cluster[0]]) - len(item), int(places[cluster[-1]]) + len(item)
                step = 4 * len(item)
                for begin in range(max(low, first), min(high, last), step):
                    window = ids[begin : min(high, last, begin + step + 2 * len(item))]
                    if self.holds(item, window):
                        found.add(p)
                        break
                if p in found:
                    break

    def _worth(self, item: np.ndarray, ids: np.ndarray, diagonal: int, low: int, high: int) -> bool:
        """Could a stretch near this diagonal be enough: are enough of its words there at all, each within BAND of its place?"""
        least = self._least(len(item))
        place = np.arange(len(item))[:, None] + np.arange(diagonal - BAND, diagonal + BAND + 1)[None, :]
        inside = (place >= low) & (place < high)
        there = np.concatenate([[0], np.cumsum(((ids[np.where(inside, place, low)] == item[:, None]) & inside).any(1))])
        return int((there[least:] - there[: len(there) - least]).max()) >= least - int(ALTERED * len(item) + SLACK)

    def holds(self, item: np.ndarray, text: np.ndarray) -> bool:
        """Is there one stretch of the text that covers enough of the item, with few enough words altered?

        Where the best path does not do, its longest unbroken segment is masked and the rest aligned again, until
        the matches or the score left are under those of half the item with its alterations and a short insertion.
        """
        least = self._least(len(item))
        altered = int(ALTERED * least + SLACK)
        held = np.bincount(item)
        left = text.copy()
        while True:
            known = left[(left > 0) & (left < len(held))]
            if int(np.minimum(np.bincount(known, minlength=len(held)), held).sum()) < least - altered:
                return False
            path = align(item, left)
            if not path:
                return False
            if self._covers(item, text, path) >= least:
                return True
            segments, score = [[]], 0
            for i, j in path:
                same = i >= 0 and j >= 0 and item[i] == left[j]
                score += 2 if same else -2
                if same:
                    segments[-1].append(j)
                elif i < 0 and segments[-1]:
                    segments.append([])
            if score < 2 * (least - 2 * altered) - 2 * INSERTED:
                return False
            left[max(segments, key=len)] = 0

    def _covers(self, item: np.ndarray, text: np.ndarray, path: list[tuple[int, int]]) -> int:
        """Words of the item in the longest stretch of the path with few enough words altered."""
        costs, covers, run = [], [], 0
        for i, j in path:
            if i < 0:  # a word put in: a short insertion is free, a long one ends the stretch
                run += 1
                costs.append(0.0 if run <= INSERTED else 1.0)
                covers.append(0)
                continue
            run = 0
            covers.append(1)
            if j >= 0 and item[i] == text[j]:
                costs.append(0.0)
            else:
                costs.append(NUMBER if j >= 0 and int(item[i]) in self.numbers and (text[j] < 0 or int(text[j]) in self.numbers) else 1.0)
        return longest_stretch(costs, covers, ALTERED, SLACK)


_MADE: dict[int, tuple[object, ItemIndex]] = {}


def _index(block: object, items: list[tuple]) -> ItemIndex:
    """One index per block and Python worker; one block at a time."""
    key = id(items)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = (items, ItemIndex(items))
    return _MADE[key][1]


def _find(df: DataFrame, texts: list[str], block: object) -> DataFrame:
    """(corpus, record_id, problem_id) of the records of which some text holds a passage of the block's items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index = _index(block, block.value)
            corpus, record = batch.column(0), batch.column(1)
            rows: list[int] = []
            names: list[str] = []
            sizes = np.sum([pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in range(2, 2 + len(texts))], axis=0)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1, [batch.num_rows]])
            for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                wanted: dict[str, list[int]] = {}  # a text that several rows share is searched once
                for k in range(2, 2 + len(texts)):
                    for i, text in enumerate(batch.column(k).slice(start, stop - start).to_pylist(), start):
                        if text:
                            wanted.setdefault(text, []).append(i)
                for at, passages in zip(wanted.values(), index.search(list(wanted)), strict=True):
                    for name in {n for p in passages for n in index.names[p]}:
                        rows += at
                        names += [name] * len(at)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([corpus.take(take), record.take(take), pa.array(names, pa.string())], names=["corpus", "record_id", "problem_id"])

    return df.select("corpus", "record_id", *texts).mapInArrow(run, "corpus string, record_id bigint, problem_id string")


def find_leaks(documents: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Every record that holds a passage of an item: corpus, record_id, problem_id, each combination once.

    A passage is a stretch of the record's text that covers at least half of the words of the item's problem
    or solution with at most one altered or missing word in ten; case, spacing, punctuation, markup and short
    insertions do not matter, while other numbers in the places of the item's numbers do. Null or blank texts
    of records and items match nothing; items of fewer than LEAST_WORDS words have to stand there whole and
    unaltered, and those of fewer than GRAM words have no passage; repeated items and rows count once; rows without an id come out with a null record_id; other columns are ignored.

    The corpora are read once per block of items and not shuffled; only found rows are.
    """
    distinct = items.filter("problem_id IS NOT NULL").select("problem_id", "problem", "solution").distinct()
    size = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length("problem"), F.lit(0)) + F.coalesce(F.octet_length("solution"), F.lit(0))), F.lit(0))).first()
    n_blocks = max(1, -(-size[0] // BLOCK_ITEMS), -(-size[1] // BLOCK_BYTES))
    context = items.sparkSession.sparkContext
    docs = documents.select(F.lit("documents").alias("corpus"), F.col("doc_id").cast("bigint").alias("record_id"), "text")
    sft = pairs.select(F.lit("sft_pairs").alias("corpus"), F.col("pair_id").cast("bigint").alias("record_id"), "problem", "solution")
    found = []
    for k in range(n_blocks):  # about BLOCK_ITEMS items or BLOCK_BYTES each; the blocks together are all items
        block = distinct.filter(F.pmod(F.xxhash64("problem_id", "problem", "solution"), F.lit(n_blocks)) == k).collect()
        shared = context.broadcast([tuple(row) for row in block])
        found += [_find(docs, ["text"], shared), _find(sft, ["problem", "solution"], shared)]
    return reduce(DataFrame.unionByName, found).distinct()
