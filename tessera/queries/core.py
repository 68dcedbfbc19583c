"""The core queries by name, each beside the SQL that has to give the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import labels as L
from tessera.functions import text as X
from tessera.operators import health, leakage, mixture, neardup, normalize, ordered, profile, registry, scoring
from tessera.plans.session import shared_dir, spread
from tessera.sources import files
from tessera.sources.tables import table
from tessera.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
WS = X.WS


def strip_sql(column: str) -> str:
    return f"regexp_replace({column}, '^{WS}+|{WS}+$', '', 'g')"


def blank_sql(column: str) -> str:
    return f"coalesce({strip_sql(column)} = '', true)"


def normal_sql(column: str) -> str:
    return strip_sql(f"regexp_replace(lower({column}), '{WS}+', ' ', 'g')")


SOURCE_SQL = "nullif(regexp_extract(regexp_replace(lower(" + strip_sql("source") + r"), '[\s_]+', '-', 'g'), '([^/]+)/*$', 1), '')"
LANG_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LANG_CODES.items()) + " ELSE {0} END"
LANG_SQL = "nullif(" + LANG_CASE.format("regexp_extract(lower(" + strip_sql("lang") + "), '^([a-z]+)', 1)") + ", '')"

def n_pair():
    return F.length("problem") + F.length("solution")

_BOXED_SQL, _HASHES_SQL = r"'\\boxed\{([^}]+)\}'", r"'(?m)####[\s]*(.+?)$'"
_IS_SQL = r"'[Tt]he (?:final )?answer is[:\s]*(.+?)[\.\n]'"


def answer_sql(c: str) -> str:
    tries = f"WHEN regexp_matches({c}, {_BOXED_SQL}) THEN {strip_sql(f'regexp_extract_all({c}, {_BOXED_SQL}, 1)[-1]')} "
    tries += " ".join(f"WHEN regexp_matches({c}, {p}) THEN {strip_sql(f'regexp_extract({c}, {p}, 1)')}" for p in (_HASHES_SQL, _IS_SQL))
    return f"nullif(CASE {tries} ELSE regexp_extract_all({c}, '-?[0-9]+\\.?[0-9]*')[-1] END, '')"


_DECIMAL_SQL = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _ratio_sql(top: str, bottom: str) -> str:
    return f"CASE WHEN regexp_matches({top}, {_DECIMAL_SQL}) AND regexp_matches({bottom}, {_DECIMAL_SQL}) AND try_cast({bottom} AS DOUBLE) <> 0 THEN round(try_cast({top} AS DOUBLE) / try_cast({bottom} AS DOUBLE), 6) END"


def _number_sql(value: str) -> str:
    return f"CASE WHEN isfinite({value}) THEN CASE WHEN ({value}) = floor({value}) AND abs({value}) < 1e15 THEN CAST(CAST(({value}) AS BIGINT) AS VARCHAR) ELSE CAST(({value}) AS VARCHAR) END END"


def normal_answer_sql(a: str) -> str:
    frac = r"'\\?frac\{([^}]+)\}\{([^}]+)\}'"
    bare = f"regexp_replace({a}, '[$\\\\,]|{WS}', '', 'g')"
    latex = f"CASE WHEN regexp_matches({a}, {frac}) THEN {_ratio_sql(strip_sql(f'regexp_extract({a}, {frac}, 1)'), strip_sql(f'regexp_extract({a}, {frac}, 2)'))} END"
    slash = r"'^-?[0-9]+/-?[0-9]+$'"
    value = f"CASE WHEN regexp_matches({bare}, {_DECIMAL_SQL}) THEN try_cast({bare} AS DOUBLE) WHEN regexp_matches({bare}, {slash}) THEN {_ratio_sql(f'split_part({bare}, {chr(39)}/{chr(39)}, 1)', f'split_part({bare}, {chr(39)}/{chr(39)}, 2)')} END"
    return f"coalesce({_number_sql(f'({latex})')}, {_number_sql(f'({value})')}, lower({bare}))"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- filters, labels, projections -----------------------------------------------------------------


@query(f"SELECT pair_id, ingested_at FROM sft_pairs WHERE NOT {blank_sql('problem')} AND NOT {blank_sql('solution')}")
def blank_filter(spark, d):
    return normalize.keep_filled(table(spark, d, "sft_pairs"), "problem", "solution").select("pair_id", "ingested_at")


@query("SELECT pair_id, ingested_at FROM sft_pairs WHERE length(problem) + length(solution) BETWEEN 200 AND 800")
def char_band(spark, d):
    return normalize.char_band(table(spark, d, "sft_pairs"), n_pair(), 200, 800).select("pair_id", "ingested_at")


@query(f"SELECT {SOURCE_SQL} AS source, {LANG_SQL} AS lang, count(*) AS n_rows FROM sft_pairs GROUP BY 1, 2")
def label_counts(spark, d):
    return table(spark, d, "sft_pairs").groupBy(L.source_label(F.col("source")).alias("source"), L.lang_label(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("SELECT pair_id, left(problem, 80) AS head, right(solution, 200) AS tail FROM sft_pairs")
def previews(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", F.left("problem", F.lit(80)).alias("head"), F.right("solution", F.lit(200)).alias("tail"))


@query(f"SELECT pair_id, problem, solution FROM sft_pairs WHERE NOT {blank_sql('problem')} AND NOT {blank_sql('solution')}")
def chat_roundtrip(spark, d):
    pairs = table(spark, d, "sft_pairs").withColumn("messages", normalize.chat(F.col("problem"), F.col("solution"), "Solve the problem."))
    back = pairs.select("pair_id", normalize.last_of(F.col("messages"), normalize.USERS).alias("problem"), normalize.last_of(F.col("messages"), normalize.ASSISTANTS).alias("solution"))
    return normalize.keep_filled(back, "problem", "solution")


@query(f"SELECT 'sft' AS source, length(problem) AS p, length(solution) AS s FROM sft_pairs WHERE NOT {blank_sql('problem')} AND NOT {blank_sql('solution')} UNION ALL SELECT 'eval', length(problem), length(solution) FROM eval_items WHERE NOT {blank_sql('problem')} AND NOT {blank_sql('solution')}")
def union_sources(spark, d):
    parts = [table(spark, d, t).select("problem", "solution", F.lit(name).alias("source")) for t, name in (("sft_pairs", "sft"), ("eval_items", "eval"))]
    return normalize.keep_filled(normalize.union_all(parts), "problem", "solution").select("source", F.length("problem").alias("p"), F.length("solution").alias("s"))


# --- scalar text functions ------------------------------------------------------------------------


@query(f"SELECT pair_id, answer, {normal_answer_sql('answer')} AS normal FROM (SELECT pair_id, {answer_sql('solution')} AS answer FROM sft_pairs)")
def answers(spark, d):
    return spread(table(spark, d, "sft_pairs").select("pair_id", "solution")).select("pair_id", X.answer(F.col("solution")).alias("answer")).withColumn("normal", X.normal_answer(F.col("answer")))


@query(r"SELECT pair_id, regexp_extract_all(solution, '\\boxed\{([^}]+)\}', 1)[-1] AS boxed, regexp_extract_all(solution, '-?[0-9]+\.?[0-9]*')[-1] AS number FROM sft_pairs")
def boxed_and_number(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", X.boxed(F.col("solution")).alias("boxed"), X.last_number(F.col("solution")).alias("number"))


@query(rf"""SELECT pair_id, CASE WHEN contains(solution, '\boxed{{') OR found IS NULL THEN solution ELSE solution || chr(10) || chr(10) || 'The answer is \boxed{{' || {strip_sql('found')} || '}}' END AS solution FROM (
 SELECT pair_id, solution, coalesce(CASE WHEN regexp_matches(solution, '(?m)####[\s]*(.+?)$') THEN regexp_extract(solution, '(?m)####[\s]*(.+?)$', 1) END,
  CASE WHEN regexp_matches(solution, '[Tt]he (?:final )?answer is[:\s]*(.+?)[\.\n]') THEN regexp_extract(solution, '[Tt]he (?:final )?answer is[:\s]*(.+?)[\.\n]', 1) END, regexp_extract_all(solution, '-?[0-9]+\.?[0-9]*')[-1]) AS found FROM sft_pairs)""")
def boxed_answers(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", X.ensure_boxed(F.col("solution")).alias("solution"))


@query(rf"SELECT problem_id, regexp_replace(replace({strip_sql('answer')}, ',', ''), '\.+$', '') AS answer FROM eval_items")
def clean_answers(spark, d):
    return table(spark, d, "eval_items").select("problem_id", X.clean_answer(F.col("answer")).alias("answer"))


@query(rf"""SELECT pair_id, CASE WHEN regexp_matches(solution, '(?s)<think>(.*?)</think>(.*)') THEN {strip_sql("regexp_extract(solution, '(?s)<think>(.*?)</think>(.*)', 1)")} || chr(10) || chr(10) || {strip_sql("regexp_extract(solution, '(?s)<think>(.*?)</think>(.*)', 2)")} ELSE solution END AS solution FROM sft_pairs""")
def unwrapped(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", X.unwrap_think(F.col("solution")).alias("solution"))


@query(rf"SELECT problem, {strip_sql('parts[1]')} || chr(10) || chr(10) || 'The answer is \boxed{{' || {strip_sql('parts[-1]')} || '}}.' AS solution FROM (SELECT problem, string_split(regexp_replace(solution, '<<[^>]*>>', '', 'g'), '####') AS parts FROM sft_pairs) WHERE len(parts) > 1 AND {strip_sql('parts[-1]')} <> ''")
def hashes_normalized(spark, d):
    return normalize.from_hashes(table(spark, d, "sft_pairs"), "problem", "solution")


@query(r"SELECT pair_id, CASE WHEN contains(solution, '\boxed{') THEN regexp_extract(solution, '(?s)^(.*)(\\boxed\{.*)$', 1) ELSE solution END AS reasoning, CASE WHEN contains(solution, '\boxed{') THEN regexp_extract(solution, '(?s)^(.*)(\\boxed\{.*)$', 2) END AS answer FROM sft_pairs")
def reasoning_and_answer(spark, d):
    reasoning, answer = X.split_boxed(F.col("solution"))
    return table(spark, d, "sft_pairs").select("pair_id", reasoning.alias("reasoning"), answer.alias("answer"))


@query(r"SELECT pair_id, coalesce(contains(solution, '\boxed{'), false) AS has_boxed, coalesce(regexp_matches(solution, '[0-9]'), false) AS has_number, coalesce(length(solution) - length(replace(solution, chr(10), '')) >= 2, false) AS has_steps FROM sft_pairs")
def format_flags(spark, d):
    s = F.coalesce("solution", F.lit(""))
    return table(spark, d, "sft_pairs").select("pair_id", F.contains(s, F.lit("\\boxed{")).alias("has_boxed"), s.rlike("[0-9]").alias("has_number"), (F.regexp_count(s, F.lit("\n")) >= 2).alias("has_steps"))


WORDS_SQL = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda x: x <> '')"


@query(f"SELECT doc_id, n_words, CAST(CASE WHEN n_words < 100 THEN 1 WHEN n_words < 300 THEN 2 WHEN n_words < 600 THEN 3 WHEN n_words < 1200 THEN 4 ELSE 5 END AS INTEGER) AS level FROM (SELECT doc_id, CAST(len({WORDS_SQL}) AS INTEGER) AS n_words FROM documents)")
def difficulty_levels(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).alias("n_words")).withColumn("level", X.difficulty(F.col("n_words")))


@query(f"SELECT doc_id, array_to_string(CASE WHEN len(w) <= 400 THEN w ELSE list_concat(list_concat(w[1:300], ['[...]']), w[len(w)-99:]) END, ' ') AS text FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def middle_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", F.concat_ws(" ", X.truncate_middle(X.words(F.col("text")), 400)).alias("text"))


@query(f"SELECT doc_id, contains(array_to_string(list_transform(range(1, len(w) - 2), lambda i: CASE WHEN w[i] = w[i + 3] THEN '1' ELSE '0' END), ''), '111111') AS repeats FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def repeating_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.repeats(X.words(F.col("text")), 3, 3).alias("repeats"))


@query("SELECT doc_id, CAST(n_chars * 2 // 7 + 60 AS BIGINT) AS n_estimated FROM documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("n_chars")).alias("n_estimated"))


@query(f"SELECT doc_id, CAST(least(len(w), 10) AS INTEGER) AS n_masked, CAST(greatest(len(w) - 10, 0) AS INTEGER) AS n_kept, array_to_string(w[1:len(w)-1][1:3], ' ') AS first_inputs, array_to_string(w[2:4], ' ') AS first_targets FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def training_rows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", X.words(F.col("text")).alias("w"))
    labels = ordered.loss_mask(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), F.lit(10))
    labels = F.when(F.size("w") > 0, labels).otherwise(F.array().cast("array<int>"))
    inputs, targets = ordered.shifted(F.col("w"))
    return rows.select("doc_id", F.size(F.filter(labels, lambda x: x == -100)).alias("n_masked"), F.size(F.filter(labels, lambda x: x != -100)).alias("n_kept"), F.concat_ws(" ", F.slice(inputs, 1, 3)).alias("first_inputs"), F.concat_ws(" ", F.slice(targets, 1, 3)).alias("first_targets"))


@query("SELECT CAST(range AS BIGINT) AS step, round(CASE WHEN range < 100 THEN 0.0003 * (range + 1) / 100 ELSE 0.0003 * 0.5 * (1 + cos(3.141592653589793 * least(1.0, (range - 100) / 900.0))) END, 12) AS rate FROM range(1000)")
def schedule(spark, d):
    return spark.range(1000).select(F.col("id").alias("step"), F.round(ordered.warmup_cosine(F.col("id"), 100, 1000, 0.0003), 12).alias("rate"))


@query("SELECT CAST(range AS BIGINT) AS item, 'What is ' || a || ' + ' || b || '?' AS problem, CAST(a + b AS VARCHAR) AS answer FROM (SELECT range, CAST(('0x' || left(md5('a' || range), 6)) AS BIGINT) % 100 AS a, CAST(('0x' || left(md5('b' || range), 6)) AS BIGINT) % 100 AS b FROM range(200))")
def arithmetic_items(spark, d):
    a, b = (F.conv(F.left(F.md5(F.concat(F.lit(x), F.col("id").cast("string"))), F.lit(6)), 16, 10).cast("bigint") % 100 for x in "ab")
    return spark.range(200).select(F.col("id").alias("item"), F.concat(F.lit("What is "), a.cast("string"), F.lit(" + "), b.cast("string"), F.lit("?")).alias("problem"), (a + b).cast("string").alias("answer"))


# --- profiles -------------------------------------------------------------------------------------


def _by_source(df):
    return df.withColumn("source", L.source_label(F.col("source")))


@query(f"SELECT {SOURCE_SQL} AS source, count(n_chars) AS n_rows, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS median, coalesce(stddev_samp(n_chars), 0) AS stdev, min(n_chars) AS least, max(n_chars) AS most, quantile_cont(n_chars, 0.95) AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def length_profile(spark, d):
    return profile.length_profile(_by_source(table(spark, d, "documents")), "source", F.col("n_chars"))


_AT = "list_sort(list(n_chars))[least({p} * count(*) // 100, count(*) - 1) + 1]"


@query(f"SELECT {SOURCE_SQL} AS source, count(*) AS n_rows, " + ", ".join(f"{_AT.format(p=p)} AS p{p}" for p in profile.PERCENTILES) + " FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def length_percentiles(spark, d):
    return profile.floor_percentiles(_by_source(table(spark, d, "documents")), "source", F.col("n_chars"))


@query(f"SELECT source, bucket, count(*) AS n_rows, count(*) / sum(count(*)) OVER (PARTITION BY source) AS share FROM (SELECT {SOURCE_SQL} AS source, CASE WHEN n_chars < 3000 THEN '0-3000' WHEN n_chars < 7000 THEN '3000-7000' WHEN n_chars < 14000 THEN '7000-14000' WHEN n_chars < 28000 THEN '14000-28000' ELSE '28000-' END AS bucket FROM documents WHERE n_chars IS NOT NULL) GROUP BY 1, 2")
def length_buckets(spark, d):
    return profile.length_buckets(_by_source(table(spark, d, "documents")), "source", F.col("n_chars"))


@query("SELECT bin, n_rows, n_rows / sum(n_rows) OVER () AS share, sum(n_rows) OVER (ORDER BY bin) / sum(n_rows) OVER () AS share_below FROM (SELECT CAST(n_chars // 5000 * 5000 AS BIGINT) AS bin, count(*) AS n_rows FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)")
def length_histogram(spark, d):
    return profile.length_histogram(table(spark, d, "documents"), F.col("n_chars"))


@query(f"SELECT source, count(*) AS n_rows, " + ", ".join(f"count_if(t <= {s}) AS kept_{s}, avg(CAST(t <= {s} AS INTEGER)) AS rate_{s}" for s in profile.SEQUENCES) + f" FROM (SELECT {SOURCE_SQL} AS source, n_chars * 2 // 7 + 60 AS t FROM documents WHERE n_chars IS NOT NULL) GROUP BY 1")
def sequence_survival(spark, d):
    return profile.sequence_survival(_by_source(table(spark, d, "documents")), "source", F.col("n_chars"))


@query(
    "SELECT source, count(*) AS n_rows, "
    + ", ".join(
        f"avg(CAST({e} AS INTEGER)) AS {n}_rate"
        for n, e in {
            "boxed": r"contains(s, '\boxed{')", "think": "contains(s, '<think>')", "coding": f"(regexp_matches(p, '{profile.CODING}') OR regexp_matches(s, '{profile.CODING}'))", "heading": f"regexp_matches(s, '{profile.HEADING}')",
            "steps": f"regexp_matches(s, '{profile.STEPS}')", "opener": f"regexp_matches(s, '{profile.OPENER}')", "lines": "(length(s) - length(replace(s, chr(10), '')) >= 5)", "number": "regexp_matches(s, '[0-9]')",
        }.items()
    )
    + f" FROM (SELECT {SOURCE_SQL} AS source, coalesce(problem, '') AS p, coalesce(solution, '') AS s FROM sft_pairs) GROUP BY 1"
)
def feature_rates(spark, d):
    return profile.feature_rates(_by_source(spread(table(spark, d, "sft_pairs").select("source", "problem", "solution"))), "source", "problem", "solution")


_KEY = f"left({strip_sql('problem')}, 200)"
_COUNTS = f"SELECT {_KEY} AS key, count(*) AS n FROM sft_pairs WHERE problem IS NOT NULL GROUP BY 1"


@query(f"SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS unique_keys, sum(n) / count(*) AS ratio, min(n) AS least, max(n) AS most, list_reverse_sort(list(n))[count(*) // 2 + 1] AS median, count_if(n = 1) AS keys_1, count_if(n BETWEEN 2 AND 5) AS keys_2_5, count_if(n BETWEEN 6 AND 20) AS keys_6_20, count_if(n BETWEEN 21 AND 50) AS keys_21_50, count_if(n > 50) AS keys_51 FROM ({_COUNTS})")
def dedup_profile(spark, d):
    return profile.dedup_profile(profile.key_counts(table(spark, d, "sft_pairs"), F.left(X.strip(F.col("problem")), F.lit(200))))


@query(f"SELECT {_KEY} AS key, count(*) AS n_rows, min(pair_id) AS first_at FROM sft_pairs WHERE problem IS NOT NULL GROUP BY 1 ORDER BY n_rows DESC, first_at, key LIMIT 5")
def dedup_top(spark, d):
    return profile.top_keys(table(spark, d, "sft_pairs"), F.left(X.strip(F.col("problem")), F.lit(200)), F.col("pair_id"))


@query(f"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY {normal_sql('text')} UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5(X.normal_form(F.col("text")).cast("binary")).alias("digest"))
    return profile.keep_first(docs, F.col("digest"), [F.col("doc_id")]).select("doc_id")


@query(f"SELECT source, count(*) AS seen, count_if(b) AS blank, count_if(NOT b AND n < 150) AS short, count_if(NOT b AND n > 900) AS long, count_if(NOT b AND n BETWEEN 150 AND 900) AS kept, count_if(NOT b AND n BETWEEN 150 AND 900 AND NOT contains(solution, '\\boxed{{')) AS missing_boxed FROM (SELECT {SOURCE_SQL} AS source, solution, {blank_sql('problem')} OR {blank_sql('solution')} AS b, length(problem) + length(solution) AS n FROM sft_pairs) GROUP BY 1")
def source_stats(spark, d):
    return profile.source_stats(_by_source(table(spark, d, "sft_pairs")), "source", "problem", "solution", 150, 900)


# --- order, splits, folds -------------------------------------------------------------------------


@query("SELECT doc_id, split FROM (SELECT doc_id, CASE WHEN sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id) - coalesce(n_chars, 0) < 20000 THEN 'val' ELSE 'train' END AS split FROM documents)")
def holdout_split(spark, d):
    return ordered.holdout(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "source", "doc_id", "n_chars", 20_000).select("doc_id", "split")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id DESC) <= greatest(10, least(200, count(*) OVER () // 20)) THEN 'val' ELSE 'train' END AS split FROM documents")
def tail_split(spark, d):
    return ordered.tail_split(table(spark, d, "documents").select("doc_id"), ["doc_id"])


@query("SELECT l_returnflag, l_orderkey, l_linenumber, sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey RANGE UNBOUNDED PRECEDING) AS upto FROM lineitem")
def running_totals(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("decimal(18,2)").alias("q"))
    return ordered.running_total(rows, "l_returnflag", "l_orderkey", "q", "upto", 5_000).drop("q")


@query("SELECT doc_id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 5")
def first_per_source(spark, d):
    return ordered.first_per_group(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 5)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200")
def seeded_sample(spark, d):
    return ordered.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 200)


@query("WITH e AS (SELECT DISTINCT problem_id, dataset, difficulty FROM eval_items), m AS (SELECT *, count_if(difficulty >= 4) OVER (PARTITION BY dataset) >= 20 AS enough FROM e) SELECT problem_id, dataset, difficulty, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY difficulty DESC NULLS LAST, problem_id) AS rank FROM m WHERE NOT enough OR difficulty >= 4) WHERE rank <= 20")
def stratified_top(spark, d):
    return ordered.stratified_top(table(spark, d, "eval_items").select("problem_id", "dataset", "difficulty").distinct(), "dataset", "difficulty", 4, "problem_id", 20)


def _sized(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("-")).alias("g"), F.size(X.words(F.col("text"))).alias("n"))


def _fold_sql(order: str, keep: str, first: str, then: str, out: str) -> str:
    """A fold over each group in order, row by row."""
    base = f"SELECT coalesce(source, '-') AS g, doc_id, CAST(len({WORDS_SQL}) AS BIGINT) AS n FROM documents"
    return f"WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY {order}) AS i FROM ({base}) WHERE {keep}), f AS (SELECT g, doc_id, n, i, {first} FROM b WHERE i = 1 UNION ALL SELECT b.g, b.doc_id, b.n, b.i, {then} FROM f JOIN b ON b.g = f.g AND b.i = f.i + 1) SELECT g, doc_id, n AS n_tokens, {out} FROM f"


@query(_fold_sql("doc_id", "true", 'CAST(0 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS "offset"', 'f.shard + CASE WHEN f."offset" + f.n >= 20000 THEN 1 ELSE 0 END, CASE WHEN f."offset" + f.n >= 20000 THEN 0 ELSE f."offset" + f.n END', 'shard, "offset"'))
def shard_assignment(spark, d):
    return ordered.assign_shards(_sized(spark, d), "g", "doc_id", "n", 20_000)


@query(_fold_sql("doc_id", "n BETWEEN 1 AND 2048", "CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS start", "f.pack + CASE WHEN f.start + f.n + 1 + b.n > 2048 THEN 1 ELSE 0 END, CASE WHEN f.start + f.n + 1 + b.n > 2048 THEN 0 ELSE f.start + f.n + 1 END", "pack, start"))
def packed_sequences(spark, d):
    return ordered.pack_next_fit(_sized(spark, d), "g", "doc_id", "n", 2_048)


@query(_fold_sql("n, doc_id", "true", "CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held", "f.batch + CASE WHEN (f.held + 1) * b.n > 16384 THEN 1 ELSE 0 END, CASE WHEN (f.held + 1) * b.n > 16384 THEN 1 ELSE f.held + 1 END", "batch"))
def token_budget_batches(spark, d):
    return ordered.budget_batches(_sized(spark, d), "g", "doc_id", "n", 16_384)


@query(
    "WITH e AS (SELECT user_id, ts, event_id, value, row_number() OVER w AS step, lag(value) OVER w AS before, lag(value, 3) OVER w AS past FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT user_id, event_id, CAST(step AS INTEGER) AS step, min(value) OVER u AS best, max(value) OVER u AS worst, bool_and(coalesce(value <= before, true)) OVER u AS monotone, coalesce(CASE WHEN past <> 0 THEN (past - value) / abs(past) < 0.005 END, false) AS plateau FROM e WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
)
def metric_monitor(spark, d):
    return ordered.monitor(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value").drop("ts", "value")


@query("SELECT user_id, max(n) AS n, max(CASE WHEN i = 1 THEN value END) AS first, max(CASE WHEN i = greatest(1, n // 4) THEN value END) AS quarter, max(CASE WHEN i = greatest(1, n // 2) THEN value END) AS half, max(CASE WHEN i = greatest(1, 3 * n // 4) THEN value END) AS three_quarters, max(CASE WHEN i = n THEN value END) AS last FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1")
def metric_trajectory(spark, d):
    return ordered.trajectory(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")


@query("SELECT cost, metric FROM (SELECT *, max(metric) OVER (ORDER BY cost ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM (SELECT o_totalprice AS cost, max(length(o_orderpriority) * 10 + o_custkey % 97) AS metric FROM orders GROUP BY 1)) WHERE best IS NULL OR metric > best")
def pareto_frontier(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_totalprice").alias("cost"), (F.length("o_orderpriority") * 10 + F.col("o_custkey") % 97).alias("metric"))
    return ordered.frontier(rows, "cost", "metric")


# --- mixtures and registries ----------------------------------------------------------------------

_W = "CASE WHEN weight IS NULL OR isnan(weight) OR weight < 0 THEN 0 ELSE weight END"


@query(f"SELECT mixture, path, CASE WHEN sum({_W}) OVER (PARTITION BY mixture) > 0 THEN {_W} / sum({_W}) OVER (PARTITION BY mixture) END AS share FROM mixture_sources")
def mixture_weights(spark, d):
    return mixture.normalized(table(spark, d, "mixture_sources"), "mixture").select("mixture", "path", "share")


@query("SELECT event_id, CASE WHEN CAST(('0x' || left(md5('42|' || event_id), 8)) AS BIGINT) / 4294967296.0 < 0.25 THEN 'a' WHEN CAST(('0x' || left(md5('42|' || event_id), 8)) AS BIGINT) / 4294967296.0 < 0.75 THEN 'b' ELSE 'c' END AS source FROM events")
def weighted_choice(spark, d):
    shares = spark.createDataFrame([("a", 0.25), ("b", 0.5), ("c", 0.25)], "source string, share double")
    return mixture.choose(table(spark, d, "events").select("event_id"), "event_id", shares).select("event_id", "source")


@query(f"SELECT name, total_tokens, coalesce(n_docs, 0) AS n_docs, coalesce(n_chars, 0) AS n_chars FROM datasets LEFT JOIN (SELECT {SOURCE_SQL} AS name, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1) USING (name)")
def registry_totals(spark, d):
    made = table(spark, d, "documents").groupBy(L.source_label(F.col("source")).alias("name")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return table(spark, d, "datasets").select("name", "total_tokens").join(made, "name", "left").fillna(0, ["n_docs", "n_chars"])


@query(f"SELECT mixture, path FROM (SELECT mixture, path, {SOURCE_SQL.replace('source', 'path')} AS name FROM mixture_sources) WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM datasets WHERE name IS NOT NULL)")
def unknown_components(spark, d):
    return registry.missing(table(spark, d, "mixture_sources").withColumn("name", L.source_label(F.col("path"))), "name", table(spark, d, "datasets"), "name").select("mixture", "path")


@query("SELECT pair_id, max(ingested_at) AS ingested_at FROM sft_pairs WHERE pair_id IS NOT NULL GROUP BY 1")
def latest_pairs(spark, d):
    return registry.latest(table(spark, d, "sft_pairs").select("pair_id", "ingested_at"), "pair_id", [F.col("ingested_at")])


@query("WITH RECURSIVE up(node, anc, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION ALL SELECT node, anc // 2, depth + 1 FROM up WHERE anc > 1 AND anc // 2 IN (SELECT p_partkey FROM part)) SELECT node AS p_partkey, arg_max(anc, depth) AS root, max(depth) AS depth FROM up GROUP BY 1")
def lineage_roots(spark, d):
    return registry.lineage(table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 END").alias("parent")), "p_partkey", "parent")


@query("SELECT p_partkey FROM part WHERE p_partkey * 3 NOT IN (SELECT p_partkey FROM part)")
def orphans(spark, d):
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 3).alias("parent"))
    return registry.missing(parts, "parent", parts, "p_partkey").select("p_partkey")


_BOARD = "SELECT user_id, avg(CASE WHEN event_type = 'purchase' THEN value END) AS first_score, avg(CASE WHEN event_type = 'click' THEN value END) AS second_score FROM events GROUP BY 1"


@query(f"SELECT user_id, round(first_score, 6) AS first_score, round(second_score, 6) AS second_score FROM ({_BOARD}) ORDER BY coalesce(first_score, -1) DESC, coalesce(second_score, -1) DESC, user_id LIMIT 20")
def leaderboard(spark, d):
    scored = table(spark, d, "events").groupBy("user_id").agg(*[F.avg(F.when(F.col("event_type") == t, F.col("value"))).alias(n) for t, n in (("purchase", "first_score"), ("click", "second_score"))])
    return registry.leaderboard(scored, ["first_score", "second_score"], "user_id", 20).select("user_id", F.round("first_score", 6).alias("first_score"), F.round("second_score", 6).alias("second_score"))


@query("SELECT l_shipmode_year AS year, round(avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice END), 4) AS a, round(avg(CASE WHEN l_returnflag = 'N' THEN l_extendedprice END), 4) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END), 4) AS r FROM (SELECT year(l_shipdate) AS l_shipmode_year, * FROM lineitem) GROUP BY 1")
def pivot_means(spark, d):
    rows = table(spark, d, "lineitem").select(F.year("l_shipdate").cast("bigint").alias("year"), "l_returnflag", "l_extendedprice")
    out = registry.pivot_mean(rows, "year", "l_returnflag", ["A", "N", "R"], "l_extendedprice")
    return out.select("year", *[F.round(c, 4).alias(c.lower()) for c in "ANR"])


@query("SELECT r.l_returnflag, s.l_linenumber, round(coalesce(avg(l.l_discount), 0), 8) AS mean FROM (SELECT DISTINCT l_returnflag FROM lineitem) r CROSS JOIN (SELECT DISTINCT l_linenumber FROM lineitem) s LEFT JOIN lineitem l ON l.l_returnflag = r.l_returnflag AND l.l_linenumber = s.l_linenumber GROUP BY 1, 2")
def mean_grid(spark, d):
    return registry.full_grid(table(spark, d, "lineitem").select("l_returnflag", "l_linenumber", "l_discount"), "l_returnflag", "l_linenumber", "l_discount").select("l_returnflag", "l_linenumber", F.round("mean", 8).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def group_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("SELECT round(avg(m), 6) AS macro, round(sum(m * n) / sum(n), 6) AS weighted FROM (SELECT event_type, avg(value) AS m, count(value) AS n FROM events GROUP BY 1)")
def macro_and_weighted(spark, d):
    per = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    return per.agg(F.round(F.avg("m"), 6).alias("macro"), F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 6).alias("weighted"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id AS step, CAST(10000 AS BIGINT) AS of, round(value, 2) AS loss FROM events WHERE value IS NOT NULL")
def parsed_log(spark, d):
    lines = table(spark, d, "events").filter("value IS NOT NULL").select(F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit("/10000 | loss: "), F.format_string("%.6f", "value"), F.lit(" | 12.5 tok/s | eta 3m")).alias("value"))
    return files.parse_log(lines).select("step", "of", F.round("loss", 2).alias("loss"))


# --- scoring --------------------------------------------------------------------------------------

_ANSWERED = f"SELECT pair_id, problem_id, {SOURCE_SQL} AS source, {{0}} AS answer FROM (SELECT *, {answer_sql('solution')} AS raw FROM sft_pairs WHERE problem_id IS NOT NULL)".replace("{0}", normal_answer_sql("raw"))
_SCORED = f"WITH a AS ({_ANSWERED}), t AS (SELECT problem_id, first(answer ORDER BY n DESC, answer) AS truth FROM (SELECT problem_id, answer, count(*) AS n FROM a WHERE answer IS NOT NULL GROUP BY 1, 2) GROUP BY 1), s AS (SELECT a.*, coalesce(a.answer = t.truth, false) AS correct FROM a LEFT JOIN t USING (problem_id)) "


def _scored(spark, d):
    return scoring.consensus(_by_source(spread(table(spark, d, "sft_pairs").select("problem_id", "source", "solution"))), "problem_id", "solution", "source")


@query(_SCORED + "SELECT source, count(*) AS n, count_if(correct) AS n_correct, count_if(answer IS NULL) AS failures, avg(CAST(correct AS INTEGER)) AS accuracy, avg(CAST(answer IS NULL AS INTEGER)) AS failure_rate FROM s GROUP BY 1")
def accuracy_by_source(spark, d):
    return scoring.accuracy(_scored(spark, d), "source")


_PASS = "avg(CASE WHEN n >= {k} THEN CASE WHEN n - c < {k} THEN 1.0 ELSE 1 - list_product(list_transform(range({k}), lambda i: (n - c - i) / (n - i))) END END)"


@query(_SCORED + "SELECT count(*) AS n_problems, " + ", ".join(f"round({_PASS.format(k=k)}, 9) AS pass_at_{k}" for k in (1, 4, 8)) + " FROM (SELECT problem_id, count(*) AS n, count_if(correct) AS c FROM s GROUP BY 1)")
def pass_rates(spark, d):
    out = scoring.pass_rates(_scored(spark, d), "problem_id")
    return out.select("n_problems", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


_RATERS = r"contains(solution, '\boxed{')", "regexp_matches(solution, '####')"


@query(f"SELECT source, count(*) AS n, count_if(a AND b) AS both, count_if(NOT a AND NOT b) AS neither, count_if(a AND NOT b) AS a_only, count_if(b AND NOT a) AS b_only, avg(CAST(b AS INTEGER)) - avg(CAST(a AS INTEGER)) AS delta FROM (SELECT {SOURCE_SQL} AS source, {_RATERS[0]} AS a, {_RATERS[1]} AS b FROM sft_pairs) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def rater_agreement(spark, d):
    return scoring.agreement(_by_source(table(spark, d, "sft_pairs")), "source", F.contains("solution", F.lit("\\boxed{")), F.col("solution").rlike("####"))


@query()
def bootstrap_intervals(spark, d):
    return scoring.bootstrap_ci(accuracy_by_source(spark, d).fillna("unknown", ["source"]), "source")


@query()
def paired_significance(spark, d):
    return scoring.paired_bootstrap(rater_agreement(spark, d).fillna("unknown", ["source"]), "source")


@query(f"SELECT {SOURCE_SQL} AS source, count(*) AS n_outputs, count(DISTINCT solution) AS n_distinct, avg(length(solution)) AS mean_length, count(DISTINCT solution) / count(*) AS share, count(DISTINCT solution) / count(*) < 0.3 AS alarm FROM sft_pairs WHERE solution IS NOT NULL GROUP BY 1")
def output_diversity(spark, d):
    return health.output_diversity(_by_source(table(spark, d, "sft_pairs")), "source", "solution")


@query(f"SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_distinct(list_transform(range(1, greatest(1, len(w) - 2) + 1), lambda i: array_to_string(w[i:i+2], ' ')))) / greatest(1, len(w) - 2) END AS diversity FROM (SELECT doc_id, {WORDS_SQL} AS w FROM documents)")
def ngram_diversity(spark, d):
    return table(spark, d, "documents").select("doc_id", health.ngram_diversity(F.col("text")).alias("diversity"))


@query(
    "WITH p AS (SELECT user_id, ts, event_id, value, max(value) OVER w AS peak, first(value) OVER w AS start FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), "
    "q AS (SELECT *, count(*) OVER f = 3 AND bool_and(peak - value > 20) OVER f AS fallen, count(*) OVER f = 3 AND bool_and(value < 10) OVER f AS short FROM p WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)) "
    "SELECT user_id, count(*) AS n, first(value ORDER BY ts, event_id) AS first, last(value ORDER BY ts, event_id) AS last, max(value) AS best, bool_or(isnan(value) OR value > 2 * start) AS exploded, bool_or(fallen) AS fell, bool_or(short) AS stayed_low FROM q GROUP BY 1"
)
def series_health(spark, d):
    return health.series_health(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value", 20.0, 3, 10.0)


@query("SELECT l_linenumber, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END) - avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 9) AS delta FROM lineitem GROUP BY 1")
def stage_deltas(spark, d):
    out = health.stage_delta(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag", "A", "R", "l_discount")
    return out.select("l_linenumber", F.round("delta", 9).alias("delta"))


@query("WITH e AS (SELECT DISTINCT problem_id, dataset, difficulty, solution FROM eval_items) SELECT dataset, count(*) AS n, avg(CAST(coalesce(contains(solution, 'boxed'), false) AS INTEGER)) AS rate, avg(nullif(difficulty, 0)) AS mean_score, " + ", ".join(f"count_if(difficulty = {k}) AS score_{k}" for k in range(1, 6)) + " FROM e GROUP BY 1")
def label_rollup(spark, d):
    return health.label_rollup(table(spark, d, "eval_items").select("problem_id", "dataset", "difficulty", "solution").distinct(), "dataset", F.contains("solution", F.lit("boxed")), F.col("difficulty"))


@query(f"SELECT doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY {SOURCE_SQL} ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 100 // (SELECT count(DISTINCT coalesce({SOURCE_SQL}, '-')) FROM documents)")
def quota_sample(spark, d):
    return health.quota_sample(_by_source(table(spark, d, "documents").select("doc_id", "source")), "source", "doc_id", 100).select("doc_id", "rank")


@query(f"SELECT pair_id, array_to_string(list_filter([CASE WHEN {blank_sql('problem')} THEN 'problem' END, CASE WHEN {blank_sql('solution')} THEN 'solution' END, CASE WHEN source IS NULL THEN 'source' END, CASE WHEN created_at IS NULL OR created_at > ingested_at THEN 'created_at' END], lambda x: x IS NOT NULL), ',') AS errors FROM sft_pairs")
def row_errors(spark, d):
    checks = {"problem": ~X.blank(F.col("problem")), "solution": ~X.blank(F.col("solution")), "source": F.col("source").isNotNull(), "created_at": F.col("created_at") <= F.col("ingested_at")}
    return table(spark, d, "sft_pairs").select("pair_id", F.concat_ws(",", health.errors(checks)).alias("errors"))


# --- leakage, duplicates, sets --------------------------------------------------------------------

_EXACT = f"SELECT DISTINCT problem_id AS item, {normal_sql('problem')} IN (SELECT {normal_sql('problem')} FROM sft_pairs WHERE NOT {blank_sql('problem')}) AS leaked FROM eval_items WHERE NOT {blank_sql('problem')}"


@query(_EXACT)
def leakage_exact(spark, d):
    return leakage.exact_matches(table(spark, d, "eval_items"), "problem_id", "problem", table(spark, d, "sft_pairs"), "problem")


@query(f"WITH l AS ({_EXACT}) SELECT dataset, count(*) AS n_items, count_if(leaked) AS n_leaked, count_if(leaked) / count(*) AS rate FROM (SELECT DISTINCT problem_id AS item, lower(trim(dataset)) AS dataset FROM eval_items) LEFT JOIN l USING (item) GROUP BY 1")
def leakage_report(spark, d):
    return leakage.leak_report(table(spark, d, "eval_items"), "problem_id", "dataset", leakage_exact(spark, d).filter("leaked"))


@query(f"WITH i AS (SELECT DISTINCT problem_id AS item, {normal_sql('problem')} AS t FROM eval_items WHERE NOT {blank_sql('problem')}), d AS (SELECT doc_id AS record, {normal_sql('text')} AS t FROM documents WHERE NOT {blank_sql('text')}) SELECT DISTINCT item, record FROM i JOIN d ON contains(d.t, i.t)")
def leakage_contains(spark, d):
    return leakage.containments(table(spark, d, "eval_items"), "problem_id", "problem", table(spark, d, "documents"), "doc_id", "text")


def shingles_sql(key: str, text: str, source: str) -> str:
    """(id, s): the distinct five-word shingles of each text, the whole text where it is shorter."""
    words = f"SELECT {key} AS id, list_filter(string_split({normal_sql(text)}, ' '), lambda x: x <> '') AS w FROM {source} WHERE {key} IS NOT NULL AND NOT {blank_sql(text)}"
    return f"SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM ({words}))"


@query(
    f"WITH g AS MATERIALIZED ({shingles_sql('doc_id', 'text', 'documents')}), t AS MATERIALIZED (SELECT id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS digest FROM g GROUP BY 1), "
    "c AS MATERIALIZED (SELECT digest, min(id) AS class, count(*) AS n_members, max(n) AS n FROM t GROUP BY 1), cg AS MATERIALIZED (SELECT g.id, g.s FROM g JOIN c ON g.id = c.class), "
    "p AS (SELECT a.id AS x, b.id AS y, count(*) AS k FROM cg a JOIN cg b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2), l AS MATERIALIZED (SELECT x, y FROM p JOIN c cx ON cx.class = x JOIN c cy ON cy.class = y WHERE k / (cx.n + cy.n - k) >= 0.8), "
    "e AS (SELECT id, count(*) AS n_links FROM (SELECT x AS id FROM l UNION ALL SELECT y FROM l) GROUP BY 1) SELECT t.id AS doc_id, class, n_members, coalesce(n_links, 0) AS n_links FROM t JOIN c USING (digest) LEFT JOIN e ON e.id = class"
)
def near_duplicates(spark, d):
    return neardup.duplicate_report(*neardup.near_duplicates(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query(f"SELECT {normal_sql('problem')} AS problem FROM sft_pairs WHERE problem IS NOT NULL INTERSECT SELECT {normal_sql('problem')} FROM eval_items WHERE problem IS NOT NULL")
def shared_problems(spark, d):
    a, b = (table(spark, d, t).filter("problem IS NOT NULL").select(X.normal_form(F.col("problem")).alias("problem")) for t in ("sft_pairs", "eval_items"))
    return a.intersect(b)


@query(f"SELECT {normal_sql('problem')} AS problem FROM eval_items WHERE problem IS NOT NULL EXCEPT SELECT {normal_sql('problem')} FROM sft_pairs WHERE problem IS NOT NULL")
def unseen_problems(spark, d):
    a, b = (table(spark, d, t).filter("problem IS NOT NULL").select(X.normal_form(F.col("problem")).alias("problem")) for t in ("sft_pairs", "eval_items"))
    return b.subtract(a)


@query(f"SELECT count(DISTINCT {normal_sql('text')}) AS n_texts FROM documents")
def distinct_texts(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct(F.md5(X.normal_form(F.col("text")).cast("binary"))).alias("n_texts"))


@query(f"SELECT pair_id, coalesce(CAST({normal_answer_sql('a')} = {normal_answer_sql('b')} AS INTEGER), 0) * 1.0 AS reward FROM (SELECT pair_id, {answer_sql('solution')} AS a, regexp_extract_all(solution, '-?[0-9]+\\.?[0-9]*')[-1] AS b FROM sft_pairs)")
def rewards(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", scoring.reward(F.col("solution"), X.last_number(F.col("solution"))).alias("reward"))


# --- files and streams ----------------------------------------------------------------------------


@query()
def file_manifest(spark, d):
    return files.manifest(spark, d, "*.parquet")


@query("SELECT e.user_id, e.ts, e.event_id, e.value FROM events e JOIN (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1) USING (user_id, event_id)")
def stream_latest(spark, d):
    schema = table(spark, d, "events").schema
    stream = logs.file_stream(spark, os.path.join(d, "events.parquet*"), schema).select("user_id", "ts", "event_id", "value")
    return logs.run_once(logs.latest_per_key(stream, "user_id", "event_id"), f"{shared_dir(spark)}/stream-latest-{uuid.uuid4().hex}")
