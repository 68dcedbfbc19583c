"""Mixing sources to target weights (problem 1).

Temperature mixing: the shares of the sources are exponentiated, the exponent is bisected until the target can be
met within the repeats allowed (or until the shares have a target entropy), and the normalised shares at that
exponent are realised as budgeted block permutations.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.labels import source_label
from tessera.llm import bpe
from tessera.llm.tokens import count_tokens
from tessera.plans.session import cut_lineage

BLOCK_TEXTS = 1024  #: expected texts in a block
MOST_MIXTURE_ROWS = 100_000  #: a configuration table, checked; a larger one is refused
PLAN_SCHEMA = "mixture string, source string, paths array<string>, weight double, wanted_share double, wanted_tokens bigint, target_tokens bigint, max_repeats int, available_tokens bigint, available_texts bigint, reachable_tokens bigint, budget_tokens bigint, alpha double, tempered_share double"


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def tempered(bases: list[float], alpha: float, towards: list[float] | None = None) -> list[float]:
    """Shares proportional to base**alpha * towards**(1 - alpha); a base of zero stays zero.

    ``towards`` defaults to even shares, which makes it the usual temperature rule (1 / alpha is the temperature).
    """
    towards = towards or [1.0] * len(bases)
    raw = [b**alpha * t ** (1 - alpha) if b > 0 and t > 0 else 0.0 for b, t in zip(bases, towards, strict=True)]
    total = sum(raw)
    return [x / total if total else 0.0 for x in raw]


def bisect_alpha(holds, steps: int = 60) -> float:
    """Largest alpha in [0, 1] for which ``holds`` (which, once false, stays false as alpha grows); 0 if none."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def entropy_alpha(sizes: list[float], target: float) -> float:
    """Exponent of the source sizes at which the shares reach the target entropy; entropy falls as alpha grows."""
    return bisect_alpha(lambda a: entropy(tempered(sizes, a)) >= target)


def whole_budgets(shares: list[float], rooms: list[int], target: int) -> list[int]:
    """Whole tokens that add up to the target as far as the rooms allow: rounded down, the rest by largest remainder."""
    exact = [p * target for p in shares]
    budgets = [min(int(x + 1e-6), r) for x, r in zip(exact, rooms, strict=True)]
    left = min(target, sum(r for p, r in zip(shares, rooms, strict=True) if p > 0)) - sum(budgets)
    for i in sorted(range(len(shares)), key=lambda i: (budgets[i] - exact[i], i)):
        if shares[i] > 0 and left > 0:
            more = min(left, rooms[i] - budgets[i], max(1, round(exact[i]) - budgets[i]))
            budgets[i] += more
            left -= more
    return budgets


def solve_mixture(weights: list[float], sizes: list[int], target: int, repeats: int, target_entropy: float | None = None) -> tuple[float, list[float], list[int]]:
    """(alpha, shares, budgets) of one mixture's sources.

    Sources without text are left out before the weights are normalised. The shares start from the weights, or,
    with a target entropy, from the sizes exponentiated until the shares have it. They are then tempered towards
    the sizes, s**alpha * size**(1 - alpha), with the largest alpha for which no source has to be repeated more
    than ``repeats`` times: alpha is 1 where the stated weights can be met as they are, and 0 where all text
    is needed. Budgets add up to the target whenever the sources with weight hold enough text for it.
    """
    have = [float(n) if w > 0 else 0.0 for w, n in zip(weights, sizes, strict=True)]
    room = [max(0, repeats) * int(n) for n in have]
    base = tempered([w if n > 0 else 0.0 for w, n in zip(weights, have, strict=True)], 1.0)
    if target_entropy is not None:
        base = tempered(have, entropy_alpha(have, target_entropy))
    alpha = bisect_alpha(lambda a: all(p * target <= r + 1 for p, r in zip(tempered(base, a, have), room, strict=True)))
    shares = tempered(base, alpha, have)
    return alpha, shares, whole_budgets(shares, room, target)


def plan_mixtures(sources: DataFrame, targets: DataFrame, sizes: DataFrame) -> DataFrame:
    """Budget of each source of each mixture, by solve_mixture; the wanted shares stay beside it.

    ``sizes`` has source, n_tokens, n_texts. Paths whose last segments name the same source are one row
    with their weights added; null, NaN and negative weights count as zero. Mixtures without a target are
    left out; a source without text or weight has a budget of 0. ``wanted_share`` is the weight's share over all
    paths, ``wanted_tokens`` its tokens, ``reachable_tokens`` what of these the repeats allow; ``alpha`` and
    ``tempered_share`` are what the budget follows. ``targets`` may have a column target_entropy (in nats),
    which replaces the stated weights of the mixtures where it is not null.
    """
    bare = sources.select("mixture", "path", source_label(F.col("path")).alias("source"), F.when(F.isnan("weight") | F.col("weight").isNull() | (F.col("weight") < 0), 0.0).otherwise(F.col("weight")).alias("weight"))
    merged = bare.filter("source IS NOT NULL AND mixture IS NOT NULL").groupBy("mixture", "source").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.sum("weight").alias("weight"))
    wanted_entropy = F.max("target_entropy") if "target_entropy" in targets.columns else F.max(F.lit(None).cast("double"))
    goal = targets.groupBy("mixture").agg(F.max("target_tokens").alias("target_tokens"), F.max("max_repeats").alias("max_repeats"), wanted_entropy.alias("target_entropy"))
    joined = merged.join(goal, "mixture").join(sizes.withColumnsRenamed({"n_tokens": "available_tokens", "n_texts": "available_texts"}), "source", "left")
    joined = joined.select("mixture", "source", "paths", "weight", F.coalesce("target_tokens", F.lit(0)).alias("target_tokens"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "target_entropy", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), F.coalesce("available_texts", F.lit(0)).alias("available_texts"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("source").reset_index(drop=True)
        total, target, repeats = pdf.weight.sum(), max(0, int(pdf.target_tokens[0])), max(0, int(pdf.max_repeats[0]))
        aim = None if pd.isna(pdf.target_entropy[0]) else float(pdf.target_entropy[0])
        share = (pdf.weight / total if total > 0 else pdf.weight * 0.0).tolist()
        alpha, shares, budgets = solve_mixture(share, pdf.available_tokens.tolist(), target, repeats, aim)
        wanted = [round(p * target) for p in share]
        reachable = [min(w, repeats * int(a)) for w, a in zip(wanted, pdf.available_tokens, strict=True)]
        return pdf.assign(wanted_share=share, wanted_tokens=wanted, reachable_tokens=reachable, budget_tokens=budgets, alpha=alpha, tempered_share=shares)

    return joined.groupBy("mixture").applyInPandas(lambda pdf: solve(pdf)[[c.split()[0] for c in PLAN_SCHEMA.split(", ")]], PLAN_SCHEMA)


def select_mixtures(documents: DataFrame, sources: DataFrame, targets: DataFrame, seed: int = 42, vocabulary: str = bpe.DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(plan, selection): which text each mixture takes how often.

    selection has mixture, source, doc_id, n_tokens, copies. The same text in several documents of a source
    is one text, named by its smallest doc_id, so that no text is used more than max_repeats times. Null,
    empty and token-less texts and documents without a source are in no mixture. A budget is spent in whole
    passes over the source, then in whole blocks of a seeded permutation of its blocks, and in the one block
    where it ends by taking in permuted order each text that still fits. The rest left over is smaller than
    any text of that block that was left out; actual shares come from the selection itself.

    Blocks hold about BLOCK_TEXTS texts however large a source is; a source of fewer than twice as many is one
    block. Prefix sums run over one row per block;
    only the blocks in which some budget ends are sorted by row. All that is broadcast is the plan, at most
    MOST_MIXTURE_ROWS rows.
    """
    n_rows = sources.limit(MOST_MIXTURE_ROWS + 1).count()
    if n_rows > MOST_MIXTURE_ROWS:
        raise ValueError("mixture_sources is a configuration table; this one is too large")
    counted = count_tokens(documents.select("doc_id", source_label(F.col("source")).alias("source"), F.md5(F.col("text").cast("binary")).alias("digest"), "text").filter("source IS NOT NULL AND text IS NOT NULL AND text <> ''"), "text", vocabulary=vocabulary)
    texts = counted.filter("n_tokens > 0").groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    rank = F.xxhash64(F.lit(seed), "source", "digest")
    texts = texts.select("source", "doc_id", "n_tokens", rank.alias("rank"))
    texts = cut_lineage(texts)  # texts are tokenised once for sizes, block sums and selection
    sizes = texts.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_texts"))
    plan = cut_lineage(plan_mixtures(sources, targets, sizes))
    blocks = plan.filter("budget_tokens > 0").select("source", F.greatest(F.lit(1), F.floor(F.col("available_texts") / BLOCK_TEXTS)).alias("blocks")).distinct()
    texts = texts.join(F.broadcast(blocks), "source").select("source", "doc_id", "n_tokens", "rank", F.pmod("rank", "blocks").alias("block"))
    per_block = texts.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    small = F.broadcast(plan.filter("budget_tokens > 0").select("mixture", "source", (F.col("budget_tokens") / F.col("available_tokens")).cast("bigint").alias("passes"), F.expr("budget_tokens % available_tokens").alias("rest")))
    before = F.sum("block_tokens").over(W.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block").rowsBetween(W.unboundedPreceding, -1))
    placed = per_block.withColumn("before", F.coalesce(before, F.lit(0)))
    # A block is taken whole, not at all, or is the one in which the rest ends: left is what may still be used there.
    taken = placed.join(small, "source").select("mixture", "source", "block", "passes", F.greatest(F.lit(0), F.col("rest") - F.col("before")).alias("left"), "block_tokens")
    taken = taken.filter("passes > 0 OR left > 0")
    rows = texts.join(taken, ["source", "block"])
    plain = rows.filter("left = 0 OR left >= block_tokens").select("mixture", "source", "doc_id", "n_tokens", (F.col("passes") + F.when(F.col("left") > 0, 1).otherwise(0)).cast("int").alias("copies"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "doc_id"], kind="stable")
        left, extra = int(pdf.left.iloc[0]), []
        for n in pdf.n_tokens:
            fits = n <= left
            extra.append(int(fits))
            left -= n * fits
        return pdf.assign(copies=pdf.passes + extra)[["mixture", "source", "doc_id", "n_tokens", "copies"]]

    edge = rows.filter("left > 0 AND left < block_tokens").groupBy("mixture", "source", "block").applyInPandas(fill, "mixture string, source string, doc_id bigint, n_tokens bigint, copies int")
    return plan, plain.unionByName(edge).filter("copies > 0")


def mixture_shares(plan: DataFrame, selection: DataFrame) -> DataFrame:
    """The plan with what was really reached: tokens and texts used, share of the target and of the mixture, repeats."""
    used = selection.groupBy("mixture", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count(F.lit(1)).alias("used_texts"), F.max("copies").alias("most_copies"))
    out = plan.join(used, ["mixture", "source"], "left").fillna(0, ["used_tokens", "used_texts", "most_copies"])
    whole = F.sum("used_tokens").over(W.partitionBy("mixture"))
    return out.select(
        "mixture", "source", "paths", "weight", "wanted_share", "wanted_tokens", "available_tokens", "max_repeats", "reachable_tokens", "budget_tokens", "used_tokens", "used_texts", "most_copies",
        F.when(F.col("target_tokens") > 0, F.col("used_tokens") / F.col("target_tokens")).alias("share_of_target"),
        F.when(whole > 0, F.col("used_tokens") / whole).alias("actual_share"),
        (F.col("wanted_tokens") - F.col("used_tokens")).alias("missing_tokens"),
        (F.col("reachable_tokens") < F.col("wanted_tokens")).alias("limited"),
        "alpha", "tempered_share",
    )
