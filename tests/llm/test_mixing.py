"""Mixtures: properties of the budgets, and the shares against SQL over the selection."""

import math
import random

import duckdb
import pytest

from tessera.llm import mixing, queries


@pytest.mark.parametrize("seed", range(200))
def test_budgets(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 8)
    weights = [rng.choice((0.0, rng.random(), 10 * rng.random())) for _ in range(n)]
    sizes = [rng.choice((0, rng.randrange(1, 10**rng.randrange(1, 9)))) for _ in range(n)]
    repeats, target = rng.randrange(0, 5), rng.randrange(0, 10**6)
    alpha, shares, budgets = mixing.solve_mixture(weights, sizes, target, repeats)
    rooms = [repeats * s * (w > 0) for w, s in zip(weights, sizes)]
    assert all(0 <= b <= r for b, r in zip(budgets, rooms))
    assert sum(budgets) == min(target, sum(rooms))  # met in full wherever there is enough text
    live = sum(w for w, s in zip(weights, sizes) if s)
    if live:
        wanted = [w / live * target if s else 0 for w, s in zip(weights, sizes)]
        if all(x <= r for x, r in zip(wanted, rooms)):
            assert alpha == 1.0 and all(abs(b - x) <= 1 for b, x in zip(budgets, wanted))  # the stated weights
        assert abs(sum(shares) - 1) < 1e-9
    if alpha < 1 and sum(rooms) > target + n:  # tempered no more than needed: some source is used up
        assert any(abs(b - r) <= n + 1 for b, r in zip(budgets, rooms) if r)


def test_ghosts_are_left_out_first():
    alpha, shares, budgets = mixing.solve_mixture([0.5, 0.3, 0.2], [0, 1000, 1000], 500, 1)
    assert alpha == 1.0 and budgets == [0, 300, 200]


def test_small_source_first():
    """Weight on a small source: its text is used up, and the others take over what is missing."""
    alpha, _, budgets = mixing.solve_mixture([0.8, 0.1, 0.1], [100, 10_000, 5_000], 1_000, 2)
    assert 0 < alpha < 1 and sum(budgets) == 1000 and 195 <= budgets[0] <= 200 and budgets[1] > budgets[2]


def test_target_entropy():
    sizes = [9000, 900, 100]
    for aim in (0.5, 0.8, 1.0):
        _, shares, budgets = mixing.solve_mixture([1, 1, 1], sizes, 200, 1, aim)
        assert math.isclose(mixing.entropy(shares), aim, abs_tol=1e-6) and sum(budgets) == 200


def test_target_entropy_column(spark):
    sources = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 1.0)], "mixture string, path string, weight double")
    targets = spark.createDataFrame([("m", 100, 1, 0.4)], "mixture string, target_tokens long, max_repeats int, target_entropy double")
    sizes = spark.createDataFrame([("a", 9000, 9), ("b", 1000, 3)], "source string, n_tokens long, n_texts long")
    shares = [r.tempered_share for r in mixing.plan_mixtures(sources, targets, sizes).collect()]
    assert math.isclose(mixing.entropy(shares), 0.4, abs_tol=1e-6)


def test_shares_against_sql(spark, folder):
    plan, chosen = queries._mixtures(spark, folder)
    got = mixing.mixture_shares(plan, chosen).toPandas().sort_values(["mixture", "source"])
    p, s = plan.toPandas().drop(columns="paths"), chosen.toPandas()  # noqa: F841 - read by the SQL
    want = duckdb.sql(
        """
        WITH used AS (SELECT mixture, source, sum(n_tokens * copies) AS used_tokens, count(*) AS used_texts, max(copies) AS most_copies FROM s GROUP BY ALL)
        SELECT p.mixture, p.source, coalesce(used_tokens, 0) AS used_tokens, coalesce(used_texts, 0) AS used_texts, coalesce(most_copies, 0) AS most_copies,
               CASE WHEN target_tokens > 0 THEN coalesce(used_tokens, 0) / target_tokens END AS share_of_target,
               coalesce(used_tokens, 0) / nullif(sum(coalesce(used_tokens, 0)) OVER (PARTITION BY p.mixture), 0) AS actual_share,
               wanted_tokens - coalesce(used_tokens, 0) AS missing_tokens
        FROM p LEFT JOIN used USING (mixture, source) ORDER BY 1, 2"""
    ).df()
    assert len(got) == len(want)
    for c in want.columns:
        a, b = got[c].tolist(), want[c].tolist()
        assert all(x == y or (x != x and y != y) or abs(float(x) - float(y)) < 1e-9 for x, y in zip(a, b)), c
    assert (got.most_copies <= got.max_repeats).all() and (got.used_tokens <= got.budget_tokens).all()
    met = plan.toPandas().groupby("mixture").agg({"budget_tokens": "sum", "target_tokens": "max"})
    rooms = got[got.weight > 0].assign(room=lambda d: d.available_tokens * d.max_repeats).groupby("mixture").room.sum()
    for mixture, room in rooms.items():
        assert met.budget_tokens[mixture] == min(met.target_tokens[mixture], room)
