"""Further operators: ties and nulls, training rows against a plain loop, item sources, registries, alarms."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import extras, health, leakage, neardup, normalize, ordered, scoring
from tessera.plans.session import spread
from tessera.sources import files, shards
from tessera.streaming import logs


def column(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]


def test_answer_rules(spark):
    cases = {
        "The answer is 3.5. So": "3", "The answer is 7": "7", "The final answer is: x = 4\nmore": "x = 4", "#### 1,234 apples\nThe answer is 9.": "1,234 apples", r"\boxed{5} then \boxed{ 12 }": "12",
        "no numbers": None, "": None, "  ": None, "first 1 then -2.5": "-2.5", "####\n12": "12",
    }
    assert column(spark, cases, X.answer) == list(cases.values())
    normal = {r"\frac{1}{2}": "0.5", r"frac{4}{2}": "2", r"x = \frac{3}{4}": "0.75", "1,234": "1234", "$42$": "42", "-0.50": "-0.5", "3/4": "0.75", "6/3": "2", "1/0": "1/0", "1e3": "1000", r"\frac{a}{b}": "frac{a}{b}", "X Y": "xy", "007": "7"}
    assert column(spark, normal, X.normal_answer) == list(normal.values())
    assert column(spark, ["2 and 3", r"\boxed{1} 2", "none", None], X.box_last_number) == ["2 and 3\n\nThe answer is \\boxed{3}.", r"\boxed{1} 2", "none", None]
    assert column(spark, ["Level 5", "level 5", "Level ?", None], X.level_number) == [5, None, None, None]
    assert column(spark, ["12.0", "-3.7", "x", None], X.whole_number) == ["12", "-3", None, None]
    assert column(spark, ["```json\n{}\n```", "{}", "```\na```"], X.strip_fence) == ["{}", "{}", "a"]
    assert column(spark, ["/checkpoints/sft-a-sft-b", "x"], X.experiment_id) == ["a-b", "x"]


def test_answers_need_no_fallback(spark):
    """The nested expressions stay small enough to be compiled or interpreted in one piece."""
    df = spark.createDataFrame([(r"\boxed{1/2}",)], "x string")
    plan = df.select(X.normal_answer(X.answer(F.col("x"))).alias("a"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 12_000


@pytest.mark.parametrize("parts", [1, 4])
def test_tail_split_keeps_every_row(spark, parts):
    rows = [(k // 3 if k < 54 else None, f"r{k % 2}", k) for k in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(parts)
    out = ordered.tail_split(df, ["a"]).collect()
    assert len(out) == 60 and sum(r.split == "val" for r in out) == 10
    lowest = min(r.a for r in out if r.split == "val")
    assert all(r.split == "val" for r in out if r.a is not None and r.a > lowest) and all(r.split == "train" for r in out if r.a is None)
    same = spark.createDataFrame([(1, "x")] * 300, "a int, b string")
    assert sorted(r["count"] for r in ordered.tail_split(same, ["a"]).groupBy("split").count().collect()) == [15, 285]
    few = spark.createDataFrame([(1,), (2,)], "a int")
    assert [r.split for r in ordered.tail_split(few, ["a"]).collect()] == ["val", "val"] and ordered.tail_split(few.limit(0), ["a"]).count() == 0


def test_packed_rows_against_a_loop(spark):
    rng = random.Random(3)
    samples = [(g, i, [rng.randrange(1, 90) for _ in range(rng.randrange(1, 30))]) for g in (0, 1) for i in range(40)]
    rows = [(g, i, ids, [-100 if k < 2 else x for k, x in enumerate(ids)]) for g, i, ids in samples]
    df = spark.createDataFrame(rows, "g long, i long, ids array<int>, labels array<int>").repartition(4)
    kept = ordered.fitting(df, "ids", "labels", 25, 3)
    packs = ordered.pack_next_fit(kept.select("g", "i", F.size("ids").alias("n")), "g", "i", "n", 32)
    got = {(r.g, r.pack): (r.input_ids, r.attention_mask, r.labels) for r in ordered.packed_rows(kept, packs, "g", "i", 32, 7).collect()}
    want = {}
    for g in (0, 1):
        pack, ids, labels = 0, [], []

        def close():
            pad = 32 - len(ids)
            want[g, pack] = (ids + [7] * pad, [1] * len(ids) + [0] * pad, labels + [-100] * pad)

        for gg, _, new, marks in rows:
            if gg != g or len(new) > 25 or sum(x != -100 for x in marks) < 3:
                continue
            if ids and len(ids) + 1 + len(new) > 32:
                close()
                pack, ids, labels = pack + 1, [], []
            if ids:
                ids, labels = [*ids, 7], [*labels, -100]
            ids, labels = ids + new, labels + marks
        close()
    assert got == want


def test_folds_do_not_depend_on_batches(spark):
    rows = [(g, i, (i * 7) % 50) for g in ("a", None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, n int")
    want = {tuple(r) for r in ordered.assign_shards(df, "g", "o", "n", 300).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in ordered.assign_shards(df.repartition(3), "g", "o", "n", 300).collect()} == want and len(want) == 1000
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered.assign_shards(df.limit(0), "g", "o", "n", 300).count() == 0


def test_shapes_of_conversations(spark):
    turns = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(None, None, [("human", "q 1"), ("gpt", "a 2"), ("gpt", "a 3")]), ("p", "s 4", [("human", "x"), ("gpt", "y")]), ("p", "", [("gpt", "z 5")]), (None, None, None)], f"problem string, solution string, conversations {turns}")
    got = [tuple(r)[:2] for r in normalize.normalize(df, "columns_or_turns", "s").collect()]
    assert got == [("q 1", "a 3\n\nThe answer is \\boxed{3}."), ("p", "s 4\n\nThe answer is \\boxed{4}."), ("p", "z 5\n\nThe answer is \\boxed{5}.")]
    assert [r.problem for r in normalize.normalize(df, "turns", "s").collect()] == ["q 1", "x"]
    chat = spark.createDataFrame([([("user", "u"), ("assistant", "v 1")], None), ([("user", "u")], "w 2"), ([], "w 3")], f"messages {normalize.MESSAGES}, answer string")
    assert [r.solution for r in normalize.normalize(chat, "messages_or_answer", "s").collect()] == ["v 1\n\nThe answer is \\boxed{1}.", "w 2\n\nThe answer is \\boxed{2}."]


def test_item_sources(spark, tmp_path):
    (tmp_path / "alpha.jsonl").write_text('{"problem": "one"}\n\n{"id": "own", "problem": "two"}\n{"problem": "three"}\n')
    (tmp_path / "beta_test.jsonl").write_text('{"problem": "x"}\n')
    got = {(r.dataset, r.id, r.problem) for r in files.read_items(spark, str(tmp_path), "id string, problem string").collect()}
    assert got == {("alpha", "alpha_0000", "one"), ("alpha", "own", "two"), ("alpha", "alpha_0003", "three"), ("beta_test", "beta_test_0000", "x")}
    sha = files.manifest(spark, str(tmp_path), "alpha.jsonl").first().sha256
    entries = "name string, file string, sha256 string, n int"
    good = spark.createDataFrame([("alpha", "alpha.jsonl", sha, 3)], entries)
    assert files.read_checked(spark, str(tmp_path), "alpha", good).count() == 3 and files.read_checked(spark, str(tmp_path), "beta").count() == 1
    for bad in (("alpha", "alpha.jsonl", "sha256:00", 3), ("alpha", "alpha.jsonl", sha, 4)):
        with pytest.raises(ValueError):
            files.read_checked(spark, str(tmp_path), "alpha", spark.createDataFrame([bad], entries))
    with pytest.raises(FileNotFoundError):
        files.read_checked(spark, str(tmp_path), "gamma")
    text = files.manifest_json(files.manifest(spark, str(tmp_path))).first().manifest
    assert set(json.loads(text)["datasets"]) == {"alpha.jsonl", "beta_test.jsonl"}
    assert files.manifest_hash(spark, str(tmp_path / "none.json")) == "" and len(files.manifest_hash(spark, str(tmp_path / "alpha.jsonl"))) == 64
    assert column(spark, [sha, None], files.short_hash) == [sha[7:23], "missing"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.jsonl").write_text('{"text": "", "messages": [{"role": "user", "content": "kept"}]}\n{"text": null, "problem": "p"}\n{"x": 1}\n')
    assert sorted(r.text for r in files.read_texts(spark, str(tmp_path / "t")).collect()) == ["kept", "p"]
    rows = spark.createDataFrame([("a,b", 'say "x"\nnow', 1), (None, "", 2)], "a string, b string, c int")
    files.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert [r.c for r in files.read_csv(spark, str(tmp_path / "csv"), "a string, b string, c int").orderBy("c").collect()] == [1, 2] and files.read_csv(spark, str(tmp_path / "csv"), "a string, b string, c int").filter("c = 1").first().b == 'say "x"\nnow'


def test_shards_by_either_reader(spark, tmp_path):
    shards.register(spark)
    docs = [[1, 2, 3], [4], [65_535, 0], []]
    spark.createDataFrame([("s", i, d) for i, d in enumerate(docs)], shards.SCHEMA).coalesce(1).write.format("token_shards").mode("append").option("shard_tokens", 4).save(str(tmp_path))
    a = sorted(tuple(r) for r in spark.read.format("token_shards").load(str(tmp_path)).collect())
    b = sorted(tuple(r) for r in shards.read_shards(spark, str(tmp_path)).collect())
    assert a == b and [r[2] for r in a] == docs
    first = shards.list_shards(str(tmp_path))[0]
    assert shards.shard_index(first) == [0, 3]
    (tmp_path / os.path.basename(first).replace(".bin", ".idx")).unlink()
    assert shards.shard_index(first) is None and sorted(r.tokens for r in shards.read_shards(spark, str(tmp_path)).collect()) == sorted([[1, 2, 3, 4], [65_535, 0], []])


def test_registries(spark):
    known = spark.createDataFrame([("a", 1)], "k string, v int")
    assert extras.register(known, spark.createDataFrame([("b", 2)], "k string, v int"), "k").count() == 2
    for bad in ([("a", 3)], [("c", 1), ("c", 2)], [(None, 1)]):
        with pytest.raises(ValueError):
            extras.register(known, spark.createDataFrame(bad, "k string, v int"), "k")
    merged = extras.merge(known, spark.createDataFrame([("a", 9), ("z", None), (None, 1)], "k string, v int"), "k")
    assert sorted((r.k, r.v) for r in merged.collect()) == [("a", 9), ("z", None)]
    one = extras.side_by_side(known, "k", "a", "q").first()
    assert json.loads(one.a) == {"k": "a", "v": 1} and one.b is None and one.error == "not found: q"
    tree = spark.createDataFrame([(1, None, "pre"), (2, 1, "sft"), (3, 2, "rl"), (4, 3, "rl"), (5, 6, "x"), (6, 5, "y")], "id long, up long, stage string").withColumn("data", F.concat(F.lit("d"), "id"))
    got = {(r.node, r.ancestor, r.depth) for r in extras.ancestry(tree, "id", "up").collect()}
    assert {(4, 4, 0), (4, 3, 1), (4, 2, 2), (4, 1, 3), (5, 6, 1), (6, 5, 1), (5, 5, 0)} <= got and len(got) == 4 + 3 + 2 + 1 + 4
    lineage = {r.node: r.lineage for r in extras.data_lineage(tree, "id", "up", "stage", "data").collect()}
    assert lineage[4] == {"pre_data": "d1", "sft_data": "d2", "rl_data": "d4"} and lineage[1] == {"pre_data": "d1"}
    with pytest.raises(ValueError):
        extras.validated(spark.createDataFrame([("m", 1.0), ("m", None)], "g string, weight double"), "g")
    assert [r.share for r in extras.validated(spark.createDataFrame([("m", 1.0), ("m", 3.0)], "g string, weight double"), "g").orderBy("share").collect()] == [0.25, 0.75]
    record = spark.createDataFrame([("sft", 1), ("rl", 2), ("other", 3)], "stage string, x int").select(extras.stage_record(F.col("stage"), {"x": F.col("x")}, {"sft": {"lr": F.lit(0.1)}, "rl": {"kl": F.lit(0.2)}}).alias("r"))
    assert [json.loads(r.r) for r in record.collect()] == [{"stage": "sft", "x": 1, "lr": 0.1}, {"stage": "rl", "x": 2, "kl": 0.2}, {"stage": "other", "x": 3}]


def test_alarms(spark):
    nan = float("nan")
    rows = [("good", i, 10.0 - i) for i in range(10)] + [("flat", i, 5.0) for i in range(10)] + [("up", i, 1.0 + i) for i in range(10)] + [("nan", 0, 1.0), ("nan", 1, nan), ("null", 0, None)]
    df = spark.createDataFrame(rows, "s string, t long, v double")
    got = {r.s: (r.broken, r.exploded, r.stuck, r.ended_flat) for r in extras.loss_health(df, "s", "t", "v", 5).collect()}
    assert got["good"] == (False, False, False, False) and got["flat"] == (False, False, True, True) and got["up"][1] and got["nan"][0] and "null" not in got
    assert {r.s: r.saturated for r in extras.saturated(df.filter("s IN ('good', 'flat')"), "s", "t", "v").collect()} == {"good": False, "flat": True}
    runs = spark.createDataFrame([("a", i, int(c)) for i, c in enumerate("0111011")], "s string, t long, v int")
    assert [tuple(r) for r in extras.streaks(runs, "s", ["t"], F.col("v") == 1, 3).collect()] == [("a", 2, 3)]
    assert extras.streaks(runs, "s", ["t"], F.col("v") == 1, 4).count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 10_000])
def test_series_in_chunks(spark, width):
    """Running values, neighbours and streaks do not depend on how a series is cut; ties and null series included."""
    rng = random.Random(2)
    rows = [(s, rng.choice((None, *range(20))), i, None if rng.random() < 0.1 else float(rng.randrange(30))) for s in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, t int, id long, v double").repartition(3)
    df = df.select("*", *[F.lit("clash").alias(c) for c in ("i", "n", "best", "step", "peak", "before", "part", "at", "s2")])
    got = {r.id if r.s else -1 - r.id: r for r in ordered.monitor(df, "s", ["t", "id"], "v", 2, 0.05, width=width).collect()}
    health_rows = {r.s: r for r in health.series_health(df, "s", ["t", "id"], "v", 10.0, 3, 12.0, width).collect()}
    for s in ("a", None):
        mine = sorted((r for r in rows if r[0] == s and r[3] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        values = [r[3] for r in mine]
        for k, r in enumerate(mine):
            g = got[r[2] if s else -1 - r[2]]
            past = values[k - 2] if k >= 2 else None
            assert (g.step, g.best, g.worst) == (k + 1, min(values[: k + 1]), max(values[: k + 1]))
            assert g.monotone == all(y <= x for x, y in zip(values[:k], values[1 : k + 1]))
            assert g.plateau == (past is not None and past != 0 and (past - values[k]) / abs(past) < 0.05)
        peaks = [max(values[: k + 1]) for k in range(len(values))]
        runs = lambda flags: any(all(flags[k - 2 : k + 1]) for k in range(2, len(flags)))
        h = health_rows[s]
        assert (h.n, h.first, h.last, h.best) == (len(values), values[0], values[-1], max(values)) and h.exploded == (max(values) > 2 * values[0])
        assert h.fell == runs([p - v > 10 for p, v in zip(peaks, values)]) and h.stayed_low == runs([v < 12 for v in values])


def test_conversation_masks(spark):
    df = spark.createDataFrame([([("system", "S"), ("user", "a"), ("assistant", "bc")],)], f"m {normalize.MESSAGES}")
    ids, mask = extras.chat_ids(F.col("m"))
    r = df.select(ids.alias("i"), mask.alias("m")).first()
    assert r.i == [1, *map(ord, "S\n\na"), 2, 3, *map(ord, "bc"), 4] and r.m == [0] * 6 + [0, 1, 1, 1]


def test_predictions_join_by_id(spark):
    items = spark.createDataFrame([("a", "1/2"), ("b", r"\boxed{7}"), ("b", r"\boxed{7}"), (None, "3")], "id string, answer string")
    outputs = spark.createDataFrame([("b", "so 7.0"), ("a", r"\boxed{0.5}"), ("a", "none"), ("zz", "1"), (None, "3")], "id string, output string").withColumn("answer", F.lit("clash"))
    got = {(r.id, r.answer): r.correct for r in scoring.against_truth(outputs.drop("answer"), items, "id", "output", "answer").collect()}
    assert got == {("b", "7"): True, ("a", "0.5"): True, ("a", None): False}


def test_comparison(spark):
    both = spark.createDataFrame([("d", i < 50, i < 90) for i in range(100)] + [("same", True, True)] * 5, "ds string, a boolean, b boolean")
    got = {r.ds: r for r in scoring.comparison(both, "ds", 500).collect()}
    r = got["d"]
    assert (r.both, r.neither, r.a_only, r.b_only) == (50, 10, 0, 40) and abs(r.delta - 0.4) < 1e-9 and r.significant and r.improved and not r.overlap and r.low_a < 0.5 < r.high_a
    assert got["same"].overlap and not got["same"].improved


def jaccard(a, b):
    return len(a & b) / len(a | b)


def shingles(t):
    w = t.split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


@pytest.mark.parametrize("side", [2, 7, 1024])
def test_near_duplicates_by_brute_force(spark, monkeypatch, side):
    """Random edits of a few texts of all lengths, and a group that a shared half makes hot."""
    monkeypatch.setattr(neardup, "SIDE", side)
    monkeypatch.setattr(neardup, "FREQUENT", 3)
    rng = random.Random(side)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((3, 6, 9, 14, 25, 60, 200)))]
        for _ in range(9):
            w = list(words)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w[rng.randrange(2) :])))
    shared = " ".join(f"s{k}" for k in range(120))
    rows += [(1000 + k, shared + " " + " ".join(f"t{k}_{j}" for j in range(40 + k % 50))) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, t string")
    member, links = neardup.near_duplicates(df, "id", "t")
    of = {r.id: r["class"] for r in member.collect()}
    first = {}
    for i, t in rows:
        first.setdefault(shingles(t), i)
    assert of == {i: first[shingles(t)] for i, t in rows}
    want = {(a, b) for x, a in first.items() for y, b in first.items() if a < b and jaccard(x, y) >= 0.8}
    assert {(r["class"], r.other) for r in links.collect()} == want and want
    few = neardup.near_duplicates(df.limit(0), "id", "t")
    assert few[0].count() == 0 and few[1].count() == 0


def test_near_duplicates_write_no_sets(spark):
    """What is written stays below the shingle sets, of eight bytes a shingle; copies of a text meet nothing."""
    from pathlib import Path

    from tessera.plans.session import shared_dir

    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(300)) for _ in range(600)]
    texts += [" ".join([*t.split()[:-2], "other", "end"]) for t in texts[:20]]
    df = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(2 * len(texts))], "id long, t string").repartition(4)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    used = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = used()
    member, links = neardup.near_duplicates(df, "id", "t")
    assert {(r["class"], r.other) for r in links.collect()} == {(k, 600 + k) for k in range(20)}
    assert {r.id: r["class"] for r in member.collect()} == {k: k % len(texts) for k in range(2 * len(texts))}
    assert 0 < used() - before < 8 * sum(len(shingles(texts[k % len(texts)])) for k in range(2 * len(texts)))


def test_maps_of_any_width_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(6)
    for size in (1, 7, 63, 64, 65, 250, 260, 2000, 20_000):
        a = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 11 :], rng.integers(1, 1 << 62, size // 11).astype(np.uint64)]))
        near = len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        assert near and neardup.alike(len(a), neardup.parities(a, neardup.width(len(a))), len(b), neardup.parities(b, neardup.width(len(b))), 0.8)
        other = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        if 60 < size <= neardup.MOST_BITS:
            assert not neardup.alike(len(a), neardup.parities(a, neardup.width(len(a))), len(other), neardup.parities(other, neardup.width(len(other))), 0.8)


def test_similar_items_by_brute_force(spark):
    rng = random.Random(5)
    items = [(f"i{k}", " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(4, 80)))) for k in range(30)]
    corpus = []
    for k in range(60):
        w = rng.choice(items)[1].split()
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "other"
        corpus.append((k, " ".join(w)))
    left, right = spark.createDataFrame(items, "id string, t string"), spark.createDataFrame(corpus + [(99, None), (98, " ")], "id long, t string")
    got = {(r.item, int(r.record)) for r in leakage.similar_items(left, "id", "t", right, "id", "t").collect()}
    assert got == {(i, k) for i, a in items for k, b in corpus if jaccard(shingles(a), shingles(b)) >= 0.9} and got


def test_containment_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_BYTES", 20)
    items = spark.createDataFrame([("a", "one two"), ("b", "One  TWO"), ("c", "three"), ("d", ""), ("e", None)], "id string, t string")
    corpus = spark.createDataFrame([(1, "x one two three"), (2, "Two three\tfour"), (3, None)], "id long, t string").withColumn("item", F.lit("clash"))
    assert {tuple(r) for r in leakage.containments(items, "id", "t", corpus, "id", "t").collect()} == {("a", 1), ("b", 1), ("c", 1), ("c", 2)}


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "A b  c d e f"), (3, "x y")], "k smallint, t string").withColumn("id", F.lit("clash"))
    member, links = neardup.near_duplicates(df, "k", "t")
    assert sorted((r.k, r["class"]) for r in member.collect()) == [(1, 1), (2, 1), (3, 3)] and links.count() == 0
    got = leakage.containments(df, "k", "t", df.withColumn("record", F.lit(0)), "k", "t")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_prefixes_and_parities_lose_nothing():
    import numpy as np

    rng = np.random.default_rng(4)
    values = np.sort(rng.choice(np.arange(1, 4000, dtype=np.uint64), 300, replace=False))
    ranks = rng.permutation(300)
    for least in (0.8, 0.9):
        for _ in range(400):
            a = rng.choice(np.arange(1, 4000, dtype=np.uint64), rng.integers(1, 60), replace=False)
            b = np.unique(np.concatenate([a[: max(1, len(a) - rng.integers(0, 5))], rng.choice(np.arange(1, 4000, dtype=np.uint64), rng.integers(0, 5), replace=False)]))
            a = np.unique(a)
            if len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < least:
                continue
            assert set(neardup.prefix(a, least, values, ranks)) & set(neardup.prefix(b, least, values, ranks))
            bits = [np.frombuffer(neardup.parities(x), np.uint64).reshape(1, -1) for x in (a, b)]
            assert neardup.passing((np.array([len(a)]), np.array([len(b)])), tuple(bits), least).all()


def test_spread_and_samples(spark):
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).count() == 100
    many = spark.range(100).repartition(9)
    assert spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()
    kept = [r.id for r in extras.in_order(spark.range(100), "id", 10, "id").collect()]
    assert len(kept) == 10 and kept == sorted(kept)


def test_stream_into_the_shared_folder(spark, tmp_path):
    df = spark.createDataFrame([(k % 3, k) for k in range(30)], "k long, v long")
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = logs.file_stream(spark, str(tmp_path / "in"), df.schema, per_trigger=1)
    out = logs.run_once(logs.latest_per_key(stream, "k", "v"), str(tmp_path / "out"))
    assert sorted((r.k, r.v) for r in out.collect()) == [(0, 27), (1, 28), (2, 29)]
    plain = logs.run_once(logs.file_stream(spark, str(tmp_path / "in"), df.schema, per_trigger=1), str(tmp_path / "plain"), "append")
    assert plain.count() == 30
