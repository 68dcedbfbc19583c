"""Leaks of item families: shared texts, templates, and recall on seeded passages."""

import random

from tessera.llm import leakage

THINGS = "apples barrels candles drums eggs ferns gloves hats inks jars".split()
NAMES = "Ada Bram Celia Dov Ema".split()


def template(k: int) -> str:
    rng = random.Random(k)
    a, b, c, d, e, f = rng.sample(range(11, 99), 6)
    name, thing = NAMES[k % 5], THINGS[k // 5]
    return (
        f"On a rainy morning {name} carries {a} crates of {thing} to the harbour and sells {b} of them to the captain for {c} coins "
        f"while {d} more {thing} are kept in the shed for {e} days and {f} are given to friends so how many {thing} does {name} have left"
    )


def test_items_that_share_a_text():
    index = leakage.ItemIndex([(f"i{k}", template(7), None) for k in range(50)])
    found = index.search(["Before. " + template(7).upper() + " after", template(8), " ".join(template(7).split()[:30])])
    names = [{n for p in passages for n in index.names[p]} for passages in found]
    assert names[0] == names[2] == {f"i{k}" for k in range(50)} and not names[1]


def test_each_item_of_a_template():
    index = leakage.ItemIndex([(f"i{k}", template(k), None) for k in range(50)])
    found = index.search([f"so {template(k)} and then" for k in range(50)])
    for k, passages in enumerate(found):
        assert f"i{k}" in {n for p in passages for n in index.names[p]}
    assert sum(map(len, found)) < 100  # those of the same style with other things and numbers are not reported


def test_anchors_lose_nothing():
    """The seeds left out for being common never decide: with and without them the same passages are found."""
    texts = []
    rng = random.Random(4)
    for _ in range(300):
        w = template(rng.randrange(50)).split()
        n = len(w) // 2 + rng.randrange(1, 8)
        at = rng.randrange(len(w) - n)
        part = [x if rng.random() > 0.08 else "zzz" for x in w[at : at + n]]
        texts.append("so " + " ".join(part) + " then")
    items = [(f"i{k}", template(k), None) for k in range(50)]
    index = leakage.ItemIndex(items)
    before = index.search(texts)
    assert not index.anchor.all() or not (index.count > leakage.COMMON).any() or index.needed.max() < 2
    index.anchor[:] = True
    assert index.search(texts) == before


def test_recall_on_altered_passages():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    items = [(f"i{k}", " ".join(rng.choice(words) for _ in range(rng.randrange(20, 120))), None) for k in range(60)]
    index = leakage.ItemIndex(items)
    hit = total = 0
    for name, text, _ in items:
        w = text.split()
        for share in (0.55, 0.6, 0.75, 1.0):
            n = min(len(w), int(share * len(w)) + 1)
            at = rng.randrange(len(w) - n + 1)
            part = w[at : at + n]
            for i in rng.sample(range(n), n // 10):
                part[i] = "other"
            total += 1
            hit += any(name in index.names[p] for p in index.search(["pre " * 30 + " ".join(part) + " post" * 30])[0])
    assert hit >= 0.95 * total, (hit, total)
    print(f"{hit} of {total}")
