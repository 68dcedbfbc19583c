"""The conditional random field decides: held-out wordings, ablations of its parts, odd inputs."""

import numpy as np
import pytest

from tessera.llm import defects as D
from tessera.llm import train_defects as T


@pytest.fixture(scope="module")
def held(folder):
    """Constructed answers over pairs of the smallest table; the declining sentences are those kept out of training."""
    field = D.Field.load()
    return T.examples(field, T.read_rows(folder), seed=99, refusals=slice(2, None, 3))


def part(field, **parts):
    return D.Field(*(parts.get(k, getattr(field, k)) for k in ("hashed", "dense", "move", "grams")))


def judged(field, data):
    return D.verdicts(field, [p for p, *_ in data], [" ".join(parts) for _, parts, _, _ in data])


def test_held_out_wordings(held):
    right, by_kind = T.measure(D.Field.load(), held)
    print(right, by_kind)
    assert right > 0.97 and by_kind["refusal"] > 0.95 and by_kind["answer"] > 0.98 and min(by_kind.values()) > 0.8


def test_every_part_of_the_field_decides(held):
    field = D.Field.load()
    whole, _ = T.measure(field, held)
    before = judged(field, held)
    for name in ("hashed", "dense", "move", "grams"):
        without = part(field, **{name: np.zeros_like(getattr(field, name))})
        changed = sum(a != b for a, b in zip(before, judged(without, held)))
        score, _ = T.measure(without, held)
        print(name, changed, round(whole, 4), round(score, 4))
        assert changed > 0 and score < whole


def test_transitions_are_learnt():
    move = D.Field.load().move
    assert move[D.REFUSAL, D.REFUSAL] > move[D.REFUSAL, D.ANSWER] and move[D.FOREIGN, D.FOREIGN] > move[D.FOREIGN, D.ANSWER]


def test_viterbi_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    n = len(D.TAGS)
    field = D.Field(np.zeros((D.BUCKETS, n)), np.zeros((D.N_DENSE, n)), rng.normal(size=(n, n)), np.zeros((D.GRAMS, len(D.LANGS))))
    counts = np.array([1, 4, 3, 4])
    emitted = rng.normal(size=(counts.sum(), n)).astype(np.float32)
    for tags, e in zip(field.decode(emitted, counts), np.split(emitted, np.cumsum(counts)[:-1])):
        best = max(product(range(n), repeat=len(e)), key=lambda t: sum(e[i, k] for i, k in enumerate(t)) + sum(field.move[a, b] for a, b in zip(t, t[1:])))
        assert tags.tolist() == list(best)


def test_odd_inputs():
    field = D.Field.load()
    problems = ["What is 3 + 4?"] * 8 + [None, "", "💥"]
    solutions = [None, "", " \n\t", "​", "``````", "$$", "N/A " * 1, "7", "The sum is 7.", "3 + 4 = 7.", "First 3 + 4 = 7. " * 20_000]
    got = D.verdicts(field, problems, solutions)
    assert got[:7] == ["empty"] * 7 and got[7:] == [None] * 4
    assert D.verdicts(field, [], []) == []
    long_placeholder = "no answer " * 30
    assert D.verdicts(field, ["What is 3 + 4?"], [long_placeholder]) == ["empty"]
