"""Byte-pair encoding with a public vocabulary: exact ids and exact counts.

Two independent algorithms over the same rank file:

* ``PrefixEncoder`` - per-prefix dynamic programming. For every prefix exactly one token can be the last of its
  encoding; among the tokens that are suffixes of the prefix, a pair-compatibility test against the last token of
  the shorter prefix finds it. Following the back-pointers from the end emits the ids. Linear in the length of the
  piece. The suffixes come from an Aho-Corasick automaton: its state after a byte stands for the longest suffix that
  begins a token, and its suffix links lead through all tokens that end there, which is the match set that a suffix
  automaton over the vocabulary gives (tests hold it against trying every suffix).
* ``MergeCounter`` - the piece as a linked list of symbols with a priority queue of merges; what
  survives is counted. O(n log n).

Both work on pieces (the pre-tokenizer's matches). A worker keeps the results of pieces it has seen.
"""

from __future__ import annotations

import base64
import heapq

import ahocorasick
import regex

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern that belongs to the rank files.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 400_000  #: pieces a worker remembers before it starts afresh
CACHE_LENGTH = 64  #: longer pieces are encoded each time, so that the memory of the cache is bounded
NEVER = 1 << 40


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Rank file: a line holds the token's bytes in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int], below: int = NEVER) -> list[bytes]:
    """Symbols that survive when all merges of a rank under ``below`` are made, lowest rank and leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # symbol starting at i reaches to end[i]; 0 once it is gone
    before = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        rank = ranks.get(piece[i : i + 2])
        if rank is not None and rank < below:
            queue.append((rank, i, i + 2))
    heapq.heapify(queue)
    while queue:
        _, i, stop = heapq.heappop(queue)
        middle = end[i]
        if not middle or middle >= stop or end[middle] != stop:
            continue  # one of the two symbols has been merged elsewhere
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(piece[i : end[stop]])
            if rank is not None and rank < below:
                heapq.heappush(queue, (rank, i, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(piece[left:stop])
            if rank is not None and rank < below:
                heapq.heappush(queue, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(piece[i : end[i]])
        i = end[i]
    return out


class PrefixEncoder(dict):
    """Maps a piece (str) to its ids as packed little-endian int32; missing pieces are encoded on demand."""

    def __init__(self, raw: bytes):
        super().__init__()
        self.ranks = read_ranks(raw)
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.split_of: dict[int, tuple[bytes, bytes]] = {}
        self.find = regex.compile(PIECE_PATTERN).findall

    def split(self, token: int) -> tuple[bytes, bytes]:
        """The two symbols whose merge makes the token."""
        if token not in self.split_of:
            self.split_of[token] = tuple(merge(self.bytes_of[token], self.ranks, token))
        return self.split_of[token]

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int]]:
        """Symbols that stand at one edge of the token while it is merged, with the rank of the merge that ends each."""
        key = (token, right)
        if key not in self.spines:
            symbols, ends = [], NEVER
            while True:
                data = self.bytes_of[token]
                symbols.append((data, ends))
                if len(data) == 1:
                    break
                ends, token = token, self.ranks[self.split(token)[right]]
            self.spines[key] = symbols
        return self.spines[key]

    def fits(self, first: int, second: int) -> bool:
        """Do the two tokens stay apart when their joined bytes are encoded?

        They do unless a symbol at the right edge of the first and one at the left edge of the second
        merge before the merges inside the tokens use them up (of equal merges, the left one is made first).
        """
        known = self.compatible.get((first, second))
        if known is None:
            known = True
            for left, left_ends in self.spine(first, True):
                for right, right_ends in self.spine(second, False):
                    rank = self.ranks.get(left + right)
                    if rank is not None and rank < left_ends and rank <= right_ends:
                        known = False
                        break
                if not known:
                    break
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            self.compatible[first, second] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = [-1] * (len(data) + 1)
        size: list[int] = [0] * (len(data) + 1)
        fits = self.fits
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if size[end]:
                continue  # the last token of this prefix is known, and it is the only one
            start = end - length
            if start == 0 or size[start] and fits(last[start], token):
                last[end], size[end] = token, length
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def __missing__(self, piece: str) -> bytes:
        packed = b"".join(i.to_bytes(4, "little") for i in self.encode_piece(piece))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text, packed; empty for an empty text."""
        return b"".join(map(self.__getitem__, self.find(text)))

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("i").tolist()


class MergeCounter(dict):
    """Maps a piece (str) to its number of tokens; missing pieces are counted on demand."""

    def __init__(self, raw: bytes):
        super().__init__()
        self.ranks = read_ranks(raw)
        self.find = regex.compile(PIECE_PATTERN).findall

    def __missing__(self, piece: str) -> int:
        data = piece.encode("utf-8", "surrogatepass")
        n = 1 if data in self.ranks else len(merge(data, self.ranks))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a text: the counts of its pieces, each as often as the piece occurs."""
        return sum(map(self.__getitem__, self.find(text)))


_MADE: dict[tuple[type, int], dict] = {}


def of_worker(kind: type, raw: bytes):
    """One encoder of a kind and vocabulary per Python worker."""
    key = (kind, hash(raw))
    if key not in _MADE:
        _MADE[key] = kind(raw)
    return _MADE[key]


def vocabulary_bytes(path: str = DEFAULT_VOCABULARY) -> bytes:
    """The rank file, read on the driver; a public vocabulary is about a megabyte, more than 64 MB is refused."""
    with open(path, "rb") as file:
        raw = file.read(64 * 2**20 + 1)
    if len(raw) > 64 * 2**20:
        raise ValueError(f"{path} is no rank file: over 64 MB")
    return raw
