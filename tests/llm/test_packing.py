"""The local search on planted sets that fill their bins exactly, and where best fit has nothing to gain."""

import random

import pytest

from tessera.llm import packing

CAPACITY = 2048


def planted(seed: int, n: int = 300) -> list[int]:
    rng = random.Random(seed)
    sizes = []
    for _ in range(n):
        cuts = sorted(rng.sample(range(1, CAPACITY), rng.randrange(2, 6)))
        sizes += [b - a for a, b in zip([0, *cuts], [*cuts, CAPACITY])]
    rng.shuffle(sizes)
    return sizes


def hard(seed: int, n: int = 300) -> list[int]:
    """Three to a bin, none small: what best fit cannot finish."""
    rng = random.Random(seed)
    sizes = []
    for _ in range(n):
        a = rng.randrange(400, 900)
        b = rng.randrange(400, min(900, CAPACITY - a - 400))
        sizes += [a, b, CAPACITY - a - b]
    rng.shuffle(sizes)
    return sizes


def squares(bins, sizes):
    return sum(sum(sizes[i] for i in b) ** 2 for b in bins)


@pytest.mark.parametrize("make", [planted, hard])
@pytest.mark.parametrize("seed", range(6))
def test_planted_sets(make, seed):
    sizes = make(seed)
    first = packing.best_fit(sizes, CAPACITY)
    found = packing.swap_search(first, sizes, CAPACITY)
    assert sorted(i for b in found for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= CAPACITY for b in found)
    assert squares(found, sizes) >= squares(first, sizes)
    print(make.__name__, seed, len(first), len(found))
    assert len(found) <= 306


def test_nothing_to_pack():
    assert packing.swap_search([], [], 10) == [] and packing.swap_search([[0]], [3], 10) == [[0]]
    assert len(packing.swap_search([[0], [1], [2]], [5, 5, 10], 10)) == 2
    assert sorted(map(sorted, packing.swap_search([[0, 1], [2]], [4, 4, 1], 9))) == [[0, 1, 2]]
