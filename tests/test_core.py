"""Expressions on literal rows, folds against brute force, sources by round trip, every query against its SQL."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import labels, text as X
from tessera.operators import leakage, mixture, neardup, normalize, ordered, profile, registry, scoring
from tessera.queries import core, more  # noqa: F401 - more adds its queries
from tessera.sources import files, shards
from tessera.streaming import logs


def values(spark, rows, expr):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(expr(F.col("x"))).collect()]


def test_answers(spark):
    rows = [r"so \boxed{1} and \boxed{42}", "work\n#### 1,234", "The final answer is 7.", "maybe 3 or 4.5", "none", "", None, r"\boxed{ }"]
    assert values(spark, rows, X.answer) == ["42", "1,234", "7", "4.5", None, None, None, None]
    assert values(spark, [r"\frac{1}{2}", "1,000", "3.0", "$5$", "X y", "1/0", "7/4", None], X.normal_answer) == ["0.5", "1000", "3", "5", "xy", "1/0", "1.75", None]
    assert values(spark, ["a 5", r"\boxed{1}", "x"], X.ensure_boxed) == ["a 5\n\nThe answer is \\boxed{5}", r"\boxed{1}", "x"]
    assert values(spark, [" 1,2.. ", None], X.clean_answer) == ["12", None]
    assert values(spark, ["a<think> b </think> c", "d"], X.unwrap_think) == ["b\n\nc", "d"]


def test_text(spark):
    assert values(spark, ["　A  b\n", "", None], X.normal_form) == ["a b", "", None]
    assert values(spark, ["a b c a b c a b c", "a b c d"], lambda c: X.repeats(X.words(c), 3, 3)) == [True, False]
    assert values(spark, ["a b c d e f g h", "a"], lambda c: F.concat_ws(" ", X.truncate_middle(X.words(c), 4))) == ["a b c [...] h", "a"]
    assert values(spark, ["data/x/Forum_QA//", " edu-web", "", None], labels.source_label) == ["forum-qa", "edu-web", None, None]
    assert values(spark, ["EN", "fr_FR", "deu", " ", None], labels.lang_label) == ["en", "fr", "de", None, None]


def test_normalizers(spark):
    df = spark.createDataFrame([("q", "1+1=<<1+1=2>>2\n#### 2"), ("q", "no mark"), ("q", None)], "question string, answer string")
    assert [r.solution for r in normalize.normalize(df, "hashes", "s").collect()] == ["1+1=2\n\nThe answer is \\boxed{2}."]
    chat = spark.createDataFrame([([("human", "a"), ("gpt", "b"), ("human", "c"), ("gpt", "d")],), ([],), (None,)], f"conversations {normalize.MESSAGES}")
    assert [tuple(r) for r in normalize.normalize(chat, "conversation", "s").collect()] == [("c", "d", "s")]
    with pytest.raises(ValueError):
        normalize.normalize(df, "unheard of", "s")


def test_profiles(spark):
    df = spark.createDataFrame([("a", n) for n in range(1, 11)] + [("b", None), ("c", 5)], "s string, n int")
    got = {r.s: r for r in profile.floor_percentiles(df, "s", F.col("n")).collect()}
    assert set(got) == {"a", "c"} and [got["a"][f"p{p}"] for p in (10, 50, 99)] == [sorted(range(1, 11))[min(p * 10 // 100, 9)] for p in (10, 50, 99)]
    counts = profile.key_counts(spark.createDataFrame([("x",)] * 3 + [("y",)], "k string"), F.col("k"))
    assert profile.dedup_profile(counts).first().median == sorted([3, 1], reverse=True)[1]
    empty = profile.dedup_profile(profile.key_counts(spark.createDataFrame([], "k string"), F.col("k"))).first()
    assert empty.total == 0 and empty.median is None


def test_folds(spark):
    sizes = [30, 70, 50, 10, 100, 5, 5]
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes)], "g long, o long, n int").repartition(3)
    got = [(r.shard, r.offset) for r in ordered.assign_shards(df, "g", "o", "n", 100).orderBy("o").collect()]
    assert got == [(0, 0), (0, 30), (1, 0), (1, 50), (1, 60), (2, 0), (2, 5)]
    packs = [(r.pack, r.start) for r in ordered.pack_next_fit(df, "g", "o", "n", 101).orderBy("o").collect()]
    assert packs == [(0, 0), (0, 31), (1, 0), (1, 51), (2, 0), (3, 0), (3, 6)]
    batches = ordered.budget_batches(df, "g", "o", "n", 100).toPandas()
    assert all(len(b) * b.n_tokens.max() <= 100 for _, b in batches.groupby("batch")) and len(batches) == len(sizes)
    for parts in (1, 5):
        total = ordered.running_total(df.repartition(parts), "g", "o", "n", "t", 2).orderBy("o")
        assert [r.t for r in total.collect()] == pd.Series(sizes).cumsum().tolist()


def test_scoring(spark):
    df = spark.createDataFrame([(n, c) for n in range(1, 9) for c in range(n + 1)], "n int, c int")
    for k in (1, 2, 4):
        for r in df.select("n", "c", scoring.pass_at_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            want = None if r.n < k else 1 - math.comb(r.n - r.c, k) / math.comb(r.n, k)
            assert (r.p is None) if want is None else abs(r.p - want) < 1e-12
    ci = scoring.bootstrap_ci(spark.createDataFrame([("a", 200, 100), ("b", 5, 5)], "s string, n long, n_correct long"), "s").orderBy("s").collect()
    assert 0.4 < ci[0].low < 0.5 < ci[0].high < 0.6 and ci[1].low == ci[1].high == 1.0


def test_registry(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 99), (6, 7), (7, 6), (8, 6)], "id long, up long")
    got = {r.id: (r.root, r.depth) for r in registry.lineage(df, "id", "up").collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (5, 0), 6: (None, None), 7: (None, None), 8: (None, None)}
    assert [r.id for r in registry.missing(df, "up", df, "id").collect()] == [5]
    assert registry.latest(df.limit(0), "id", [F.col("up")]).count() == 0


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join([*base[:59], "other"])), (4, " ".join(base[30:])), (5, ""), (6, None), (7, "one two")]
    df = spark.createDataFrame(rows, "id long, t string")
    sets = {i: {tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows if t}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] != sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    member, links = neardup.near_duplicates(df, "id", "t")
    of = {r.id: r["class"] for r in member.collect()}
    assert of[1] == of[2] and set(of) == set(sets)
    assert {(r["class"], r.other) for r in links.collect()} == {(of[a], of[b]) for a, b in want}


def test_leakage(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    items = spark.createDataFrame([("a", long), ("b", "tiny text"), ("c", None), ("a", long)], "id string, t string")
    corpus = spark.createDataFrame([(1, f"x {long.upper()}\n y"), (2, "a TINY  text."), (3, ""), (4, None)], "id long, t string")
    assert {tuple(r) for r in leakage.containments(items, "id", "t", corpus, "id", "t").collect()} == {("a", 1), ("b", 2)}


def test_mixture(spark):
    df = spark.createDataFrame([("m", 2.0), ("m", None), ("m", float("nan")), ("m", 6.0), ("z", 0.0)], "m string, weight double")
    assert sorted((r.m, r.share) for r in mixture.normalized(df, "m").collect() if r.share) == [("m", 0.25), ("m", 0.75)]


def test_sources(spark, tmp_path):
    shards.register(spark)
    docs = [[1, 2, 3], [4], [65_535, 0]]
    spark.createDataFrame([("s", i, d) for i, d in enumerate(docs)], shards.SCHEMA).coalesce(1).write.format("token_shards").mode("append").save(str(tmp_path / "sh"))
    back = spark.read.format("token_shards").load(str(tmp_path / "sh")).orderBy("shard", "doc_idx").collect()
    assert [r.tokens for r in back] == docs and shards.total_tokens(spark, str(tmp_path / "sh")).first()[0] == 6
    with pytest.raises(ValueError):
        shards.write_shard(str(tmp_path / "bad"), [[70_000]])
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.jsonl").write_text('{"text": "one"}\n\n{"problem": "two"}\n{"messages": [{"role": "user", "content": "three"}]}\n')
    (tmp_path / "c" / "b.txt").write_text("four\nfive")
    assert sorted(r.text for r in files.read_texts(spark, str(tmp_path / "c")).collect()) == ["four\nfive", "one", "three", "two"]
    have = files.manifest(spark, str(tmp_path / "c"), "*.txt")
    want = spark.createDataFrame([("b.txt", "sha256:0"), ("c.txt", "x")], "file string, sha256 string").unionByName(have.select("file", "sha256"))
    assert sorted(r.status for r in files.verify_manifest(want, have).collect()) == ["MISMATCH", "MISSING", "OK"]


def test_stream_equals_batch(spark, folder):
    batch = {r.user_id: r.event_id for r in spark.read.parquet(f"{folder}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("event_id")).collect()}
    assert {r.user_id: r.event_id for r in core.queries()["stream_latest"](spark, folder).collect()} == batch


def test_plateau_stream(spark, tmp_path):
    rows = [("a", i, v) for i, v in enumerate([1.0, 0.9, 0.8, 0.7999, 0.7999, 0.7999, 0.7999])]
    df = spark.createDataFrame(rows, "s string, step long, loss double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = logs.run_once(logs.plateau_monitor(logs.file_stream(spark, str(tmp_path / "in"), df.schema), "s", "step", "loss"), str(tmp_path / "ck"), "append")
    assert [r.plateau for r in out.orderBy("step").collect()] == [False, False, False, False, False, True, True]


def test_parsed_log_takes_every_event(spark, tmp_path):
    spark.createDataFrame([(7, 1.5), (1_000_000, 2.5), (5_000_000_000, 3.5), (8, None)], "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(tuple(r) for r in core.queries()["parsed_log"](spark, str(tmp_path)).collect()) == [(7, 10000, 1.5), (1_000_000, 10000, 2.5), (5_000_000_000, 10000, 3.5)]


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_against_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("documents", "sft_pairs", "eval_items", "mixture_sources", "mixture_targets", "datasets", "events", "lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    a, b = core.queries()[name](spark, folder).toPandas(), con.sql(core.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)

    def canon(df):
        cell = lambda v: "-" if v is None or v is pd.NA or v is pd.NaT or v != v else f"{float(v):.7g}" if hasattr(v, "__float__") and not isinstance(v, str | bool) else str(v)[:19]
        return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))

    assert canon(a) == canon(b)
