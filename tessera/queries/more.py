"""Further core queries: evaluation against the truth, item sources, training rows, registries, alarms; each beside its SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tessera.functions import labels as L
from tessera.functions import text as X
from tessera.operators import extras, leakage, normalize, ordered, profile, registry, scoring
from tessera.queries.core import SOURCE_SQL, WORDS_SQL, _fold_sql, _sized, answer_sql, leakage_exact, normal_answer_sql, query, shingles_sql, strip_sql
from tessera.plans.session import shared_dir
from tessera.sources import files, shards
from tessera.sources.tables import table
from tessera.streaming import logs

# --- predictions against the truth ----------------------------------------------------------------

_ITEMS = "SELECT DISTINCT problem_id, lower(trim(dataset)) AS dataset, answer, solution, difficulty FROM eval_items WHERE problem_id IS NOT NULL"
_TRUE_SQL = f"SELECT problem_id, dataset, difficulty, solution, {normal_answer_sql('raw')} AS found, {normal_answer_sql('gold')} AS truth FROM (SELECT *, {answer_sql('solution')} AS raw, coalesce(regexp_extract_all(answer, '\\\\boxed\\{{([^}}]+)\\}}', 1)[-1], answer) AS gold FROM ({_ITEMS}))"


def _items(spark, d):
    return table(spark, d, "eval_items").filter("problem_id IS NOT NULL").select("problem_id", F.lower(F.trim("dataset")).alias("dataset"), "answer", "solution", "difficulty").distinct()


def _judged(spark, d, *keep):
    items = _items(spark, d)
    return scoring.against_truth(items.select("problem_id", "solution", *keep), items.select("problem_id", "answer"), "problem_id", "solution", "answer", *keep)


@query(f"SELECT dataset, count(*) AS n, count_if(found = truth) AS n_correct, count_if(found IS NULL) AS failures, avg(CAST(coalesce(found = truth, false) AS INTEGER)) AS accuracy, avg(CAST(found IS NULL AS INTEGER)) AS failure_rate FROM ({_TRUE_SQL}) GROUP BY 1")
def greedy_scores(spark, d):
    return scoring.accuracy(_judged(spark, d, "dataset"), "dataset")


@query(f"SELECT difficulty, count(*) AS n, count_if(found = truth) AS n_correct, count_if(found IS NULL) AS failures, avg(CAST(coalesce(found = truth, false) AS INTEGER)) AS accuracy, avg(CAST(found IS NULL AS INTEGER)) AS failure_rate FROM ({_TRUE_SQL}) GROUP BY 1")
def accuracy_by_level(spark, d):
    return scoring.accuracy(_judged(spark, d, "difficulty"), "difficulty")


_SAMPLES_SQL = f"SELECT problem_id, CASE WHEN k % 3 = 0 THEN truth WHEN k % 3 = 1 THEN found ELSE NULL END AS got, truth FROM ({_TRUE_SQL}), range(6) t(k)"


@query(f"SELECT problem_id, CAST(count(*) AS BIGINT) AS n, count_if(got = truth) AS c, count_if(got IS NULL) AS failures FROM ({_SAMPLES_SQL}) GROUP BY 1")
def sampled_scores(spark, d):
    items = _items(spark, d)
    outputs = F.array(*[x for _ in range(2) for x in (F.concat(F.lit("\\boxed{"), "answer", F.lit("}")), F.col("solution"), F.lit("I do not know"))])
    samples = items.select("problem_id", F.explode(outputs).alias("output"))
    return scoring.per_problem(scoring.against_truth(samples, items, "problem_id", "output", "answer"), "problem_id")


_RIGHT = f"coalesce(CAST({normal_answer_sql('a')} = {normal_answer_sql('b')} AS INTEGER), 0)"


@query(f"SELECT problem_id, CAST({_RIGHT} AS DOUBLE) AS exact, round(CASE WHEN contains(solution, '\\boxed{{') THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END + CAST(0.9 AS DOUBLE) * {_RIGHT}, 9) AS formatted, round(greatest(CAST(0 AS DOUBLE), {_RIGHT} * (1 - CAST(0.001 AS DOUBLE) * n)), 9) AS shortened FROM (SELECT problem_id, coalesce(solution, '') AS solution, {answer_sql('solution')} AS a, coalesce(regexp_extract_all(answer, '\\\\boxed\\{{([^}}]+)\\}}', 1)[-1], answer) AS b, len({WORDS_SQL.replace('text', 'solution')}) AS n FROM ({_ITEMS}))")
def item_rewards(spark, d):
    items = _items(spark, d)
    made = scoring.shaped_rewards(F.coalesce("solution", F.lit("")), F.col("answer"), F.size(X.words(F.col("solution"))))
    return items.select("problem_id", *[F.round(c, 9).alias(n) for n, c in made.items()])


_BOTH = f"SELECT dataset, coalesce(found = truth, false) AS a, coalesce(contains(solution, truth), false) AS b FROM ({_TRUE_SQL})"


def _two(spark, d):
    items = _items(spark, d)
    a = _judged(spark, d, "dataset")
    truth = X.normal_answer(F.coalesce(X.boxed(F.col("answer")), F.col("answer")))
    last = items.select("problem_id", "dataset", F.when(F.contains("solution", truth), F.concat(F.lit("\n#### "), truth)).otherwise("none").alias("output"))
    b = scoring.against_truth(last, items, "problem_id", "output", "answer", "dataset")
    return scoring.two_models(a, b, "problem_id", "dataset")


@query(f"SELECT dataset, count(*) AS n, count_if(a AND b) AS both, count_if(NOT a AND NOT b) AS neither, count_if(a AND NOT b) AS a_only, count_if(b AND NOT a) AS b_only, avg(CAST(b AS INTEGER)) - avg(CAST(a AS INTEGER)) AS delta FROM ({_BOTH}) GROUP BY 1")
def comparison_cells(spark, d):
    return scoring.agreement(_two(spark, d), "dataset", F.col("a"), F.col("b"))


@query()
def comparison_record(spark, d):
    return scoring.comparison(_two(spark, d), "dataset")


# --- items, prompts, labels -----------------------------------------------------------------------


@query("SELECT problem_id, 'Solve the following math problem step by step. Put your final answer in \\boxed{}.' || chr(10) || chr(10) || 'Problem: ' || problem || chr(10) || chr(10) || 'Solution:' AS prompt FROM (SELECT DISTINCT problem_id, problem FROM eval_items)")
def eval_prompts(spark, d):
    return table(spark, d, "eval_items").select("problem_id", "problem").distinct().select("problem_id", X.eval_prompt(F.col("problem")).alias("prompt"))


@query("SELECT problem_id, 'user' AS role, 'Solve the following math problem step by step. Put your final answer in \\boxed{}.' || chr(10) || chr(10) || problem AS content, 'Q: 1+1?' || chr(10) || 'A: 2' || chr(10) || chr(10) || 'Q: ' || problem || chr(10) || 'A:' AS few_shot FROM (SELECT DISTINCT problem_id, problem FROM eval_items)")
def prompt_variants(spark, d):
    items = table(spark, d, "eval_items").select("problem_id", "problem").distinct()
    turn = F.element_at(X.chat_prompt(F.col("problem")), 1)
    return items.select("problem_id", turn["role"].alias("role"), turn["content"].alias("content"), X.few_shot_prompt([("1+1?", "2")], F.col("problem")).alias("few_shot"))


@query("SELECT pair_id, 'Problem: ' || problem || chr(10) || chr(10) || 'Solution: ' || solution AS text FROM sft_pairs")
def pair_documents(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", X.as_document(F.col("problem"), F.col("solution")).alias("text"))


@query("SELECT DISTINCT problem_id, difficulty AS level FROM eval_items")
def level_labels(spark, d):
    named = table(spark, d, "eval_items").select("problem_id", F.concat(F.lit("Level "), F.col("difficulty").cast("string")).alias("label")).distinct()
    return named.select("problem_id", X.level_number(F.col("label")).alias("level"))


@query("SELECT DISTINCT problem_id, CAST(CAST(trunc(try_cast(answer AS DOUBLE)) AS BIGINT) AS VARCHAR) AS answer FROM eval_items")
def whole_answers(spark, d):
    return table(spark, d, "eval_items").select("problem_id", X.whole_number(F.col("answer")).alias("answer")).distinct()


@query(rf"SELECT 'set_' || printf('%04d', row_number() OVER (ORDER BY problem_id) - 1) AS problem_id, 'set' AS dataset, problem, regexp_replace(replace({strip_sql('a')}, ',', ''), '\.+$', '') AS answer FROM (SELECT problem_id, problem, coalesce(regexp_extract_all(a, '\\boxed\{{([^}}]+)\}}', 1)[-1], a, '') AS a FROM (SELECT DISTINCT problem_id, nullif(problem, '') AS problem, coalesce(nullif(answer, ''), nullif(solution, '')) AS a FROM eval_items))")
def built_items(spark, d):
    rows = table(spark, d, "eval_items").select("problem_id", "problem", "answer", "solution").distinct()
    return normalize.eval_items(rows, "set", "problem_id").select("problem_id", "dataset", "problem", "answer")


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'math') ORDER BY doc_id LIMIT 300")
def of_source(spark, d):
    return normalize.of_source(table(spark, d, "documents").select("doc_id", "source"), "MATH", 300, "doc_id")


@query(f"SELECT CASE WHEN n_words < 300 THEN 'easy' ELSE 'hard' END AS part, count(*) AS n FROM (SELECT len({WORDS_SQL}) AS n_words FROM documents) GROUP BY 1")
def easy_and_hard(spark, d):
    level = X.difficulty(F.size(X.words(F.col("text"))))
    return table(spark, d, "documents").select(level.alias("level")).groupBy(F.when(F.col("level") <= 2, "easy").otherwise("hard").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT pair_id, CASE WHEN contains(solution, '\boxed{') OR n IS NULL THEN solution ELSE solution || chr(10) || chr(10) || 'The answer is \boxed{' || n || '}.' END AS solution FROM (SELECT pair_id, solution, regexp_extract_all(solution, '-?[0-9]+\.?[0-9]*')[-1] AS n FROM sft_pairs)")
def boxed_last_numbers(spark, d):
    return table(spark, d, "sft_pairs").select("pair_id", X.box_last_number(F.col("solution")).alias("solution"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100) ORDER BY doc_id")
def sample_in_order(spark, d):
    return extras.in_order(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 100, "doc_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CASE WHEN props IS NULL THEN 'no text' WHEN event_id % 5 = 0 THEN 'not JSON' END AS error FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS p, props FROM events) WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, NULL, 'not JSON' FROM events WHERE event_id % 5 = 0")
def fenced_json(spark, d):
    text = F.concat(F.lit("```json\n"), F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.col("props")), F.lit("\n```"))
    record, error = extras.parsed_json(text, "k string")
    return table(spark, d, "events").select("event_id", record["k"].alias("k"), error.alias("error"))


@query("SELECT path, replace(replace(ltrim(path, '/'), 'checkpoints/', ''), 'sft-', '') AS experiment_id FROM (SELECT DISTINCT '/checkpoints/sft-' || path AS path FROM mixture_sources)")
def experiment_ids(spark, d):
    return table(spark, d, "mixture_sources").select(F.concat(F.lit("/checkpoints/sft-"), "path").alias("path")).distinct().select("path", X.experiment_id(F.col("path")).alias("experiment_id"))


@query("SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'xs' WHEN 2 THEN 's' WHEN 3 THEN 'm' WHEN 4 THEN 'l' WHEN 5 THEN 'xl' ELSE 'd' || l_linenumber END AS label FROM (SELECT DISTINCT l_linenumber FROM lineitem)")
def depth_labels(spark, d):
    names = F.create_map(*[F.lit(x) for pair in enumerate(("xs", "s", "m", "l", "xl"), 1) for x in pair])
    depth = F.col("l_linenumber")
    return table(spark, d, "lineitem").select("l_linenumber").distinct().select("l_linenumber", F.coalesce(F.try_element_at(names, depth.cast("int")), F.concat(F.lit("d"), depth.cast("string"))).alias("label"))


@query("SELECT path, trim(option) AS option FROM (SELECT path, unnest(string_split(path, '/')) AS option FROM (SELECT DISTINCT path FROM mixture_sources)) WHERE trim(option) <> ''")
def option_lists(spark, d):
    return table(spark, d, "mixture_sources").select("path").distinct().select("path", F.explode(F.filter(F.transform(F.split("path", "/"), F.trim), lambda x: x != "")).alias("option"))


# --- rows for training ----------------------------------------------------------------------------


@query("SELECT doc_id, CAST(coalesce(length(text), 0) + 1 AS INTEGER) AS n_ids, 50256 AS last FROM documents")
def ended_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.with_end(X.code_points(F.col("text"))).alias("ids")).select("doc_id", F.size("ids").alias("n_ids"), F.element_at("ids", -1).alias("last"))


def _samples(spark, d):
    """Pairs as ids and labels by code points, the problem ignored in the labels."""
    pairs = table(spark, d, "sft_pairs").filter("pair_id IS NOT NULL AND problem IS NOT NULL AND solution IS NOT NULL").groupBy("pair_id").agg(F.min("problem").alias("problem"), F.min("solution").alias("solution"))
    ids = X.with_end(X.code_points(F.concat("problem", "solution")))
    return pairs.select("pair_id", F.lit(0).cast("bigint").alias("g"), F.expr("pair_id div 500").alias("shard"), ids.alias("ids"), F.length("problem").alias("prompt")).withColumn("labels", ordered.loss_mask(F.col("ids"), F.col("prompt")))


_PAIRS_SQL = "SELECT pair_id, min(problem) AS problem, min(solution) AS solution FROM sft_pairs WHERE pair_id IS NOT NULL AND problem IS NOT NULL AND solution IS NOT NULL GROUP BY 1"


@query(f"SELECT pair_id, CAST(length(problem) + length(solution) + 1 AS INTEGER) AS n FROM ({_PAIRS_SQL}) WHERE length(problem) + length(solution) + 1 <= 600 AND length(solution) + 1 >= 5")
def fitting_samples(spark, d):
    return ordered.fitting(_samples(spark, d), "ids", "labels", 600).select("pair_id", F.size("ids").alias("n"))


_CODES = "coalesce(CAST(list_sum(list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS BIGINT))) AS BIGINT), 0)"


@query(
    "WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY pair_id) AS i FROM (SELECT pair_id, pair_id // 500 AS shard, CAST(length(problem) + length(solution) + 1 AS BIGINT) AS n, "
    + f"CASE WHEN problem = '' THEN 0 ELSE {_CODES.format('problem')} END + CASE WHEN solution = '' THEN 0 ELSE {_CODES.format('solution')} END + 50256 AS ids, CASE WHEN solution = '' THEN 0 ELSE {_CODES.format('solution')} END + 50256 - 100 * length(problem) AS labels, length(solution) + 1 AS learnt FROM ({_PAIRS_SQL})) WHERE n <= 2048 AND learnt >= 5), "
    "f AS (SELECT shard, i, n, ids, labels, CAST(0 AS BIGINT) AS pack, n AS held FROM b WHERE i = 1 UNION ALL SELECT b.shard, b.i, b.n, b.ids, b.labels, f.pack + CASE WHEN f.held + 1 + b.n > 2048 THEN 1 ELSE 0 END, CASE WHEN f.held + 1 + b.n > 2048 THEN b.n ELSE f.held + 1 + b.n END FROM f JOIN b ON b.shard = f.shard AND b.i = f.i + 1) "
    "SELECT shard, pack, CAST(2048 AS INTEGER) AS n, t AS n_tokens, CAST(ids + (c - 1 + 2048 - t) * 50256 AS BIGINT) AS id_sum, CAST(labels - 100 * (c - 1 + 2048 - t) AS BIGINT) AS label_sum FROM (SELECT shard, pack, count(*) AS c, CAST(sum(n) + count(*) - 1 AS BIGINT) AS t, sum(ids) AS ids, sum(labels) AS labels FROM f GROUP BY 1, 2)"
)
def packed_training_rows(spark, d):
    """Packs of 2,048 over shards of 500 pairs: sizes and sums of the three arrays (tests hold the arrays against a plain loop)."""
    samples = ordered.fitting(_samples(spark, d), "ids", "labels", 2_048)
    packs = ordered.pack_next_fit(samples.select("shard", "pair_id", F.size("ids").alias("n")), "shard", "pair_id", "n", 2_048)
    rows = ordered.packed_rows(samples, packs, "shard", "pair_id", 2_048)
    total = lambda c: F.aggregate(F.transform(c, lambda x: x.cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("shard", "pack", F.size("input_ids").alias("n"), total("attention_mask").alias("n_tokens"), total("input_ids").alias("id_sum"), total("labels").alias("label_sum"))


@query(
    "WITH c AS (SELECT doc_id, list_transform(range(1, 67), lambda i: CASE WHEN i <= least(coalesce(length(text), 0), 65) THEN unicode(substring(text, CAST(i AS BIGINT), 1)) ELSE 0 END) AS ids, list_transform(range(1, 67), lambda i: i <= least(coalesce(length(text), 0), 65) AND i > 10) AS mask, coalesce(length(text), 0) AS n FROM documents) "
    "SELECT doc_id, array_to_string(ids[1:64], ' ') AS inputs, array_to_string(list_transform(range(2, 66), lambda i: CASE WHEN mask[i] THEN ids[i] ELSE -1 END), ' ') AS targets FROM c WHERE least(n, 65) - 10 >= 3"
)
def shifted_batches(spark, d):
    ids = X.code_points(F.col("text"))
    rows = table(spark, d, "documents").select("doc_id", ids.alias("ids")).withColumn("mask", F.transform("ids", lambda x, i: (i >= 10).cast("int")))
    short, marks, keep = ordered.cut_and_masked(F.col("ids"), F.col("mask"), 64)
    rows = rows.select("doc_id", short.alias("ids"), marks.alias("mask"), keep.alias("keep")).filter("keep")
    inputs, targets = ordered.shifted_batch(F.col("ids"), F.col("mask"), 64)
    return rows.select("doc_id", F.array_join(inputs.cast("array<string>"), " ").alias("inputs"), F.array_join(targets.cast("array<string>"), " ").alias("targets"))


@query(f"SELECT pair_id, CAST(length(problem) + length(solution) + 10 AS INTEGER) AS n_ids, CAST(length(solution) + 1 AS INTEGER) AS n_learnt FROM ({_PAIRS_SQL})")
def chat_masks(spark, d):
    pairs = table(spark, d, "sft_pairs").filter("pair_id IS NOT NULL AND problem IS NOT NULL AND solution IS NOT NULL").groupBy("pair_id").agg(F.min("problem").alias("problem"), F.min("solution").alias("solution"))
    ids, mask = extras.chat_ids(normalize.chat(F.col("problem"), F.col("solution"), "Help"))
    return pairs.select("pair_id", F.size(ids).alias("n_ids"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_learnt"))


@query("WITH b AS (" + _fold_sql("n, doc_id", "true", "CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held", "f.batch + CASE WHEN (f.held + 1) * b.n > 16384 THEN 1 ELSE 0 END, CASE WHEN (f.held + 1) * b.n > 16384 THEN 1 ELSE f.held + 1 END", "batch") + ") SELECT g, batch, CAST(row_number() OVER (PARTITION BY g ORDER BY md5('45|' || batch), batch) AS INTEGER) AS position FROM (SELECT DISTINCT g, batch FROM b)")
def epoch_batches(spark, d):
    return ordered.batch_order(ordered.budget_batches(_sized(spark, d), "g", "doc_id", "n", 16_384), "g", 3)


@query("SELECT range AS step, range * 4096 // 1000003 AS epoch, range * 4096 % 1000003 AS position FROM range(2000)")
def reader_positions(spark, d):
    return ordered.read_positions(spark.range(2_000), 1_000_003, 4_096)


# --- registries, results, alarms ------------------------------------------------------------------


@query(f"SELECT mixture, array_to_string(list_sort(list_distinct(list(name) FILTER (name IS NOT NULL))), ',') AS members FROM (SELECT t.mixture, {SOURCE_SQL.replace('source', 's.path')} AS name FROM (SELECT DISTINCT mixture FROM mixture_targets) t LEFT JOIN mixture_sources s USING (mixture)) GROUP BY 1")
def mixture_members(spark, d):
    lists = table(spark, d, "mixture_sources").select("mixture", L.source_label(F.col("path")).alias("name"))
    return extras.members(table(spark, d, "mixture_targets"), lists, "mixture", "name").select("mixture", F.array_join("members", ",").alias("members"))


@query(f"SELECT DISTINCT mixture, name AS member FROM (SELECT mixture, {SOURCE_SQL.replace('source', 'path')} AS name FROM mixture_sources) WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM datasets WHERE name IS NOT NULL)")
def unknown_members(spark, d):
    lists = table(spark, d, "mixture_sources").groupBy("mixture").agg(F.collect_set(L.source_label(F.col("path"))).alias("names"))
    return extras.unknown_members(lists, "mixture", "names", table(spark, d, "datasets"), "name")


@query(f"SELECT name, coalesce(n.n_docs, -1) AS n_docs FROM (SELECT name FROM datasets WHERE name IS NOT NULL UNION SELECT {SOURCE_SQL} FROM documents WHERE {SOURCE_SQL} IS NOT NULL) LEFT JOIN (SELECT {SOURCE_SQL} AS name, count(*) AS n_docs FROM documents GROUP BY 1) n USING (name)")
def merged_registry(spark, d):
    new = table(spark, d, "documents").groupBy(L.source_label(F.col("source")).alias("name")).agg(F.count(F.lit(1)).alias("n_docs"))
    return extras.merge(table(spark, d, "datasets").select("name", F.lit(-1).cast("bigint").alias("n_docs")), new, "name")


@query("SELECT pair_id, count(*) AS n FROM sft_pairs WHERE pair_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return extras.duplicates(table(spark, d, "sft_pairs"), "pair_id")


@query("SELECT (SELECT name FROM datasets WHERE name = 'edu-web') AS a, CAST(NULL AS VARCHAR) AS b, CASE WHEN (SELECT count(*) FROM datasets WHERE name = 'edu-web') = 0 THEN 'not found: edu-web, no-such-set' ELSE 'not found: no-such-set' END AS error")
def two_records(spark, d):
    out = extras.side_by_side(table(spark, d, "datasets").select("name", "dataset_type"), "name", "edu-web", "no-such-set")
    return out.select(F.get_json_object("a", "$.name").alias("a"), F.get_json_object("b", "$.name").alias("b"), "error")


@query(
    "WITH RECURSIVE up(node, anc, depth) AS (SELECT p_partkey, p_partkey, CAST(0 AS BIGINT) FROM part UNION ALL SELECT node, anc // 2, depth + 1 FROM up WHERE anc > 1 AND anc // 2 IN (SELECT p_partkey FROM part)), "
    "n AS (SELECT node, CASE anc % 3 WHEN 0 THEN 'pretrain' WHEN 1 THEN 'sft' ELSE 'rl' END AS stage, arg_min(CAST(anc AS VARCHAR), depth) AS data FROM up GROUP BY 1, 2) SELECT node AS p_partkey, string_agg(stage || '_data=' || data, ',' ORDER BY stage || '_data') AS lineage FROM n GROUP BY 1"
)
def data_lineage(spark, d):
    stage = F.when(F.col("p_partkey") % 3 == 0, "pretrain").when(F.col("p_partkey") % 3 == 1, "sft").otherwise("rl")
    parts = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey > 1 THEN p_partkey div 2 END").alias("parent"), stage.alias("stage"), F.col("p_partkey").cast("string").alias("data"))
    out = extras.data_lineage(parts, "p_partkey", "parent", "stage", "data")
    return out.select(F.col("node").alias("p_partkey"), F.array_join(F.transform(F.map_entries("lineage"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("lineage"))


@query("SELECT user_id, m AS metric FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'sft' ELSE 'rl' END AS stage FROM events) JOIN (VALUES ('sft', 'click'), ('sft', 'view'), ('sft', 'purchase'), ('rl', 'click'), ('rl', 'view'), ('rl', 'kl')) r(stage, m) USING (stage) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id IS NOT DISTINCT FROM user_id AND e.event_type = m AND e.user_id = user_id) AND (user_id, m) NOT IN (SELECT (user_id, event_type) FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)")
def missing_metrics(spark, d):
    needed = extras.required_metrics(spark, ["click", "view"], {"sft": ["purchase", "view"], "rl": ["kl"]})
    found = table(spark, d, "events").select("user_id", F.when(F.col("user_id") % 2 == 0, "sft").otherwise("rl").alias("stage"), "event_type")
    return extras.missing_metrics(found, needed, "user_id", "stage", "event_type")


@query("SELECT level FROM range(1, 11) t(level) WHERE level NOT IN (SELECT difficulty FROM eval_items WHERE difficulty IS NOT NULL)")
def open_levels(spark, d):
    return registry.missing(spark.range(1, 11).select(F.col("id").alias("level")), "level", table(spark, d, "eval_items").select(F.col("difficulty").cast("bigint").alias("difficulty")), "difficulty")


@query(f"SELECT dataset, string_agg(k || '=' || CAST(round(v, 9) AS VARCHAR), ',' ORDER BY k) AS results FROM (SELECT 'all' AS dataset, dataset || '_greedy' AS k, avg(CAST(coalesce(found = truth, false) AS INTEGER)) AS v FROM ({_TRUE_SQL}) GROUP BY dataset UNION ALL SELECT 'all', dataset || '_extraction', avg(CAST(found IS NOT NULL AS INTEGER)) FROM ({_TRUE_SQL}) GROUP BY dataset) GROUP BY 1")
def flat_results(spark, d):
    scores = greedy_scores(spark, d).filter("dataset IS NOT NULL").withColumn("run", F.lit("all"))
    out = extras.flat_results(scores, "run", "dataset", {"greedy": F.col("accuracy"), "extraction": 1 - F.col("failure_rate")})
    return out.select(F.col("run").alias("dataset"), F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 9).cast("string"))), ",").alias("results"))


@query("SELECT step, round(avg(value), 9) AS loss FROM (SELECT 0 AS step, value FROM events WHERE event_type = 'view' UNION ALL SELECT (user_id % 5 + 1) * 100, value FROM events WHERE event_type <> 'view' AND user_id IS NOT NULL) GROUP BY 1")
def checkpoint_sweep(spark, d):
    events = table(spark, d, "events")
    base = events.filter("event_type = 'view'").agg(F.round(F.avg("value"), 9).alias("loss"))
    steps = events.filter("event_type <> 'view' AND user_id IS NOT NULL").groupBy(((F.col("user_id") % 5 + 1) * 100).cast("bigint").alias("step")).agg(F.round(F.avg("value"), 9).alias("loss"))
    return extras.sweep(base, steps, "step")


@query("SELECT l_linenumber, l_returnflag, round(avg(l_discount), 9) AS mean, round(avg(l_discount - 0.01), 9) AS low, round(avg(l_discount + 0.02), 9) AS high FROM lineitem GROUP BY 1, 2")
def interval_curve(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_discount", (F.col("l_discount") - 0.01).alias("lo"), (F.col("l_discount") + 0.02).alias("hi"))
    out = extras.interval_curve(rows, ["l_linenumber", "l_returnflag"], "l_discount", "lo", "hi")
    return out.select("l_linenumber", "l_returnflag", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@query("SELECT l_linenumber, round(avg(CASE WHEN l_returnflag = 'A' THEN l_discount END), 9) AS a_mean, round(avg(CASE WHEN l_returnflag = 'A' THEN l_tax / 2 END), 9) AS a_half, round(avg(CASE WHEN l_returnflag = 'R' THEN l_discount END), 9) AS r_mean, round(avg(CASE WHEN l_returnflag = 'R' THEN l_tax / 2 END), 9) AS r_half FROM lineitem GROUP BY 1")
def interval_pivot(spark, d):
    rows = table(spark, d, "lineitem").select("l_linenumber", "l_returnflag", "l_discount", F.lit(0.0).alias("lo"), F.col("l_tax").alias("hi"))
    out = extras.interval_pivot(rows, "l_linenumber", "l_returnflag", ["A", "R"], "l_discount", "lo", "hi")
    return out.select("l_linenumber", *[F.round(f"{c}_{m}", 9).alias(f"{c.lower()}_{m}") for c in "AR" for m in ("mean", "half")])


@query("SELECT event_type, best, coalesce(best > max(best) OVER (ORDER BY first_id, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), best IS NOT NULL) AS improved FROM (SELECT event_type, max(value) AS best, min(event_id) AS first_id FROM events GROUP BY 1)")
def best_of_stage(spark, d):
    return extras.best_of_stage(table(spark, d, "events"), "event_type", "event_id", "value")


@query("SELECT user_id, event_id, round(spent, 6) AS spent, round(gain, 6) AS gain, round(CASE WHEN gain > 0 THEN spent / gain END, 4) AS per_point FROM (SELECT user_id, event_id, sum(CAST(1 AS DOUBLE)) OVER w AS spent, value - first(value) OVER w AS gain FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))")
def cost_per_point(spark, d):
    rows = table(spark, d, "events").filter("value IS NOT NULL AND user_id IS NOT NULL").select("user_id", "event_id", "value", F.lit(1.0).alias("cost"))
    out = extras.cost_per_point(rows, "user_id", "event_id", "cost", "value")
    return out.select("user_id", "event_id", F.round("spent", 6).alias("spent"), F.round("gain", 6).alias("gain"), F.round("per_point", 4).alias("per_point"))


@query("SELECT event_type, CAST(sum(round(CAST(value AS DECIMAL(28,8)), 2)) AS DOUBLE) AS total FROM events GROUP BY 1")
def rounded_totals(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(extras.rounded_sum(F.col("value")).cast("double").alias("total"))


@query("WITH s AS (SELECT user_id, max(event_id) AS e, min(event_id) AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1), m AS (SELECT user_id, min(CASE WHEN NOT event_id > e - 0.1 * (e - b) THEN value END) AS before, min(CASE WHEN event_id > e - 0.1 * (e - b) THEN value END) AS late FROM events JOIN s USING (user_id) WHERE value IS NOT NULL GROUP BY 1) SELECT user_id, before, late, before - least(before, late) < 0.01 AS saturated FROM m")
def saturated_series(spark, d):
    return extras.saturated(table(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query(
    "WITH s AS (SELECT user_id, arg_min(value, event_id) AS f, max(event_id) AS e, min(event_id) AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1) "
    "SELECT user_id, false AS broken, max(value) > 2 * first(f) AS exploded, coalesce(min(CASE WHEN event_id >= 500 THEN value END) > 0.95 * first(f), false) AS stuck, coalesce(min(CASE WHEN event_id > e - 0.1 * (e - b) THEN value END) >= min(CASE WHEN NOT event_id > e - 0.1 * (e - b) THEN value END), false) AS ended_flat FROM events JOIN s USING (user_id) WHERE value IS NOT NULL GROUP BY 1"
)
def loss_alarms(spark, d):
    return extras.loss_health(table(spark, d, "events").filter("user_id IS NOT NULL").select("user_id", "event_id", "value"), "user_id", "event_id", "value", 500)


@query(
    "WITH r AS (SELECT user_id, value < 20 AS a, row_number() OVER w AS i FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "q AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS run FROM r WHERE a), c AS (SELECT user_id, count(*) AS n, min(i) AS i FROM q GROUP BY user_id, run HAVING count(*) >= 2) SELECT user_id, CAST(min(i) AS INTEGER) AS first_at, max(n) AS longest FROM c GROUP BY 1"
)
def low_streaks(spark, d):
    rows = table(spark, d, "events").filter("value IS NOT NULL AND user_id IS NOT NULL").select("user_id", "ts", "event_id", "value")
    return extras.streaks(rows, "user_id", ["ts", "event_id"], F.col("value") < 20, 2)


@query("SELECT event_type, count(*) AS n, round(corr(value, CAST(user_id AS DOUBLE)), 9) AS correlation FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY 1")
def correlations(spark, d):
    out = extras.correlations(table(spark, d, "events").select("event_type", "value", F.col("user_id").cast("double").alias("u")), "event_type", "value", "u")
    return out.select("event_type", "n", F.round("correlation", 9).alias("correlation"))


@query("SELECT length, min_chars, min_chars > 0 AND min_chars > floor(length * 3.5) * 0.9 AS unfittable FROM (VALUES (2048), (4096), (8192)) a(length), (VALUES (0), (5000), (7000), (14000)) b(min_chars)")
def unfittable_bands(spark, d):
    lengths = spark.createDataFrame([(n, m) for n in (2048, 4096, 8192) for m in (0, 5000, 7000, 14000)], "length int, min_chars int")
    return lengths.select("length", "min_chars", extras.unfittable(F.col("min_chars"), F.col("length")).alias("unfittable"))


@query(f"SELECT source, avg(CAST(contains(s, '\\boxed{{') AS INTEGER)) < 0.95 AS few_boxed, avg(CAST(length(s) > 1000 AS INTEGER)) > 0.2 AS many_cut FROM (SELECT {SOURCE_SQL} AS source, coalesce(solution, '') AS s FROM sft_pairs) GROUP BY 1")
def quality_alarms(spark, d):
    pairs = table(spark, d, "sft_pairs").select(L.source_label(F.col("source")).alias("source"), F.coalesce("solution", F.lit("")).alias("s"))
    rates = pairs.groupBy("source").agg(F.avg(F.contains("s", F.lit("\\boxed{")).cast("double")).alias("boxed_rate"), (F.avg((F.length("s") > 1000).cast("double")) > 0.2).alias("many_cut"))
    return profile.quality_alarms(rates).select("source", "few_boxed", "many_cut")


@query("SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1) WHERE NOT starts_with(o_orderpriority, '1') AND coalesce(n, 0) >= 10")
def filtered_board(spark, d):
    counted = table(spark, d, "orders").na.drop(subset=["o_totalprice"]).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(~F.startswith("o_orderpriority", F.lit("1")) & (F.coalesce("n", F.lit(0)) >= 10))


@query("SELECT o_orderkey, bucket FROM orders, (VALUES ('low'), ('high'), ('other')) b(bucket) WHERE (bucket = 'low' AND contains(o_orderpriority, 'LOW')) OR (bucket = 'high' AND contains(o_orderpriority, 'H')) OR (bucket = 'other' AND NOT contains(o_orderpriority, 'LOW') AND NOT contains(o_orderpriority, 'H'))")
def id_buckets(spark, d):
    p = F.col("o_orderpriority")
    low, high = F.contains(p, F.lit("LOW")), F.contains(p, F.lit("H"))
    buckets = F.array_compact(F.array(F.when(low, "low"), F.when(high, "high"), F.when(~low & ~high, "other")))
    return table(spark, d, "orders").select("o_orderkey", F.explode(buckets).alias("bucket"))


@query(f"SELECT m.mixture, m.path, coalesce(n_docs, 0) AS n_docs, coalesce(n_chars, 0) AS n_chars FROM (SELECT mixture, path, {SOURCE_SQL.replace('source', 'path')} AS name FROM mixture_sources) m LEFT JOIN (SELECT {SOURCE_SQL} AS name, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY 1) d ON m.name = d.name")
def mixture_info(spark, d):
    held = table(spark, d, "documents").groupBy(L.source_label(F.col("source")).alias("name")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"))
    return table(spark, d, "mixture_sources").select("mixture", "path", L.source_label(F.col("path")).alias("name")).join(held, "name", "left").fillna(0, ["n_docs", "n_chars"]).drop("name")


# --- leakage, files -------------------------------------------------------------------------------


@query(f"WITH l AS (SELECT DISTINCT problem_id AS item, lower(trim(dataset)) AS dataset FROM eval_items WHERE dataset IS NOT NULL), x AS (SELECT DISTINCT problem_id AS item FROM eval_items e WHERE NOT coalesce({strip_sql('problem')} = '', true) AND {strip_sql('regexp_replace(lower(problem), ' + chr(39) + X.WS + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} IN (SELECT {strip_sql('regexp_replace(lower(problem), ' + chr(39) + X.WS + '+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} FROM sft_pairs WHERE NOT coalesce({strip_sql('problem')} = '', true))) SELECT dataset, grouping(dataset) = 1 AS total, count(*) AS n_items, count(x.item) AS n_leaked, coalesce(string_agg(x.item, ',' ORDER BY x.item), '') AS items FROM l LEFT JOIN x USING (item) GROUP BY ROLLUP (dataset)")
def leakage_totals(spark, d):
    return leakage.leak_totals(table(spark, d, "eval_items"), "problem_id", "dataset", leakage_exact(spark, d).filter("leaked"))


@query(
    f"WITH a AS MATERIALIZED ({shingles_sql('problem_id', 'problem', '(SELECT DISTINCT problem_id, problem FROM eval_items)')}), b AS MATERIALIZED ({shingles_sql('CAST(pair_id AS VARCHAR)', 'problem', 'sft_pairs')}), "
    "na AS (SELECT id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT id, count(*) AS n FROM b GROUP BY 1), p AS (SELECT a.id AS item, b.id AS record, count(*) AS k FROM a JOIN b USING (s) GROUP BY 1, 2) "
    "SELECT item, record, round(k / (na.n + nb.n - k), 9) AS similarity FROM p JOIN na ON na.id = item JOIN nb ON nb.id = record WHERE k / (na.n + nb.n - k) >= 0.9"
)
def similar_items(spark, d):
    found = leakage.similar_items(table(spark, d, "eval_items"), "problem_id", "problem", table(spark, d, "sft_pairs"), "pair_id", "problem")
    return found.select("item", "record", F.round("similarity", 9).alias("similarity"))


@query()
def manifest_entries(spark, d):
    return files.manifest_json(files.manifest(spark, d, "n*.parquet"))


@query()
def result_document(spark, d):
    return extras.envelope(greedy_scores(spark, d).filter("dataset IS NOT NULL"), {"version": "1", "mode": "greedy"}, "dataset", F.round("accuracy", 6))


# --- files by round trip, conversations of every shape --------------------------------------------


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("SELECT pair_id, problem, solution FROM sft_pairs")
def jsonl_roundtrip(spark, d):
    path = _folder(spark)
    files.write_jsonl(table(spark, d, "sft_pairs").select("pair_id", "problem", "solution"), path, ascii_only=True)
    return files.read_jsonl(spark, path, "pair_id bigint, problem string, solution string")


@query("SELECT doc_id, nullif(site, '') AS site, nullif(url, '') AS url, n_chars FROM documents")
def csv_roundtrip(spark, d):
    path = _folder(spark)
    files.write_csv(table(spark, d, "documents").select("doc_id", F.nullif("site", F.lit("")).alias("site"), F.nullif("url", F.lit("")).alias("url"), "n_chars"), path)
    return files.read_csv(spark, path, "doc_id bigint, site string, url string, n_chars bigint")


@query("SELECT n_tokens, count(*) AS n FROM (SELECT CAST(coalesce(length(text), 0) AS INTEGER) AS n_tokens FROM documents) GROUP BY 1")
def shard_roundtrip(spark, d):
    """Texts as 16-bit ids in token shards, written by tasks and read again by Spark's own file reader."""
    shards.register(spark)
    path = _folder(spark)
    ids = F.transform(X.code_points(F.col("text")), lambda c: c % 65_536)
    table(spark, d, "documents").select(F.lit("s").alias("shard"), F.col("doc_id").alias("doc_idx"), ids.alias("tokens")).write.format("token_shards").option("shard_tokens", 100_000).mode("append").save(path.removeprefix("file://"))
    return shards.read_shards(spark, path).groupBy(F.size("tokens").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT * FROM (VALUES ('nation.parquet', 'OK'), ('region.parquet', 'MISMATCH'), ('supplier.parquet', 'OK'), ('absent.parquet', 'MISSING')) t(file, status)")
def manifest_status(spark, d):
    found = files.manifest(spark, d, "*.parquet")
    wanted = found.filter(F.col("file").isin("nation.parquet", "region.parquet", "supplier.parquet")).select("file", F.when(F.col("file") == "region.parquet", "sha256:0").when(F.col("file") == "supplier.parquet", "pending").otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_manifest(wanted.unionByName(spark.createDataFrame([("absent.parquet", "sha256:1")], "file string, sha256 string")), found)


@query("SELECT name, true AS stamped FROM datasets UNION ALL SELECT name, true FROM datasets")
def appended_log(spark, d):
    path = _folder(spark)
    for _ in range(2):
        files.append_log(table(spark, d, "datasets").select("name"), path)
    return files.read_jsonl(spark, path, "name string, timestamp string").select("name", F.col("timestamp").isNotNull().alias("stamped"))


@query(f"SELECT md5(t) AS digest FROM (SELECT problem AS t FROM eval_items UNION SELECT answer FROM eval_items UNION SELECT problem FROM sft_pairs) WHERE NOT coalesce({strip_sql('t')} = '', true)")
def training_texts(spark, d):
    path = _folder(spark)
    items = table(spark, d, "eval_items")
    files.write_jsonl(items.select(F.col("problem").alias("text")), f"{path}/a", "error")
    turns = F.array(F.struct(F.lit("system").alias("role"), F.lit("no").alias("content")), F.struct(F.lit("user").alias("role"), F.col("answer").alias("content")))
    for name, df in (("texts", items.select(F.col("problem").alias("text"))), ("turns", items.select(F.lit("").alias("text"), turns.alias("messages"))), ("problems", table(spark, d, "sft_pairs").select("problem"))):
        df.write.option("ignoreNullFields", False).json(f"{path}/{name}")
    return files.read_texts(spark, path, "*.json*").select(F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT dataset, round(avg(CAST(coalesce(found = truth, false) AS INTEGER)), 9) AS accuracy, round(avg(CAST(coalesce(found = truth, false) AS INTEGER)) - 0.1, 9) AS ci_low, round(avg(CAST(coalesce(found = truth, false) AS INTEGER)) + 0.1, 9) AS ci_high FROM ({_TRUE_SQL}) WHERE dataset IS NOT NULL GROUP BY 1")
def result_files(spark, d):
    """Result documents written as JSON files, read with their intervals as columns; a broken file among them is left out."""
    path = _folder(spark)
    scores = greedy_scores(spark, d).filter("dataset IS NOT NULL")
    entry = F.struct(F.col("dataset"), F.struct(F.col("accuracy"), F.array(F.col("accuracy") - 0.1, F.col("accuracy") + 0.1).alias("ci")))
    scores.agg(F.to_json(F.struct(F.lit("x").alias("run"), F.map_from_entries(F.collect_list(entry)).alias("results"))).alias("value")).write.text(path)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    documents = files.read_documents(spark, path, "run string, results map<string,struct<accuracy:double,ci:array<double>>>")
    out = files.flatten_results(documents, "results", ["run"], "ci")
    return out.select("dataset", *[F.round(c, 9).alias(c) for c in ("accuracy", "ci_low", "ci_high")])


_BOX_LAST = r"CASE WHEN contains({0}, '\boxed{{') OR regexp_extract_all({0}, '-?[0-9]+\.?[0-9]*')[-1] IS NULL THEN {0} ELSE {0} || chr(10) || chr(10) || 'The answer is \boxed{{' || regexp_extract_all({0}, '-?[0-9]+\.?[0-9]*')[-1] || '}}.' END"
_FILLED = f"NOT coalesce({strip_sql('problem')} = '', true) AND NOT coalesce({strip_sql('solution')} = '', true)"


def _turns(spark, d):
    names = "array<struct<from:string,value:string>>"
    pair = F.array(F.struct(F.lit("human").alias("from"), F.lit("first").alias("value")), F.struct(F.lit("gpt").alias("from"), F.lit("old 1").alias("value")), F.struct(F.lit("human").alias("from"), F.col("problem").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("solution").alias("value")))
    return table(spark, d, "sft_pairs").filter("problem <> '' AND solution <> ''").select("pair_id", "problem", "solution", pair.cast(names).alias("conversations"))


@query(f"SELECT problem, {_BOX_LAST.format('solution')} AS solution, 's' AS source FROM sft_pairs WHERE {_FILLED}")
def turns_normalized(spark, d):
    return normalize.normalize(_turns(spark, d), "turns", "s")


@query(f"SELECT CASE WHEN pair_id % 2 = 0 THEN 'own' ELSE problem END AS problem, CASE WHEN pair_id % 2 = 0 THEN 'own 7' || chr(10) || chr(10) || 'The answer is \\boxed{{7}}.' ELSE {_BOX_LAST.format('solution')} END AS solution, 's' AS source FROM sft_pairs WHERE {_FILLED} AND pair_id IS NOT NULL")
def columns_or_turns_normalized(spark, d):
    even = F.col("pair_id") % 2 == 0
    rows = _turns(spark, d).filter(F.col("pair_id").isNotNull() & ~X.blank(F.col("problem")) & ~X.blank(F.col("solution")))
    return normalize.normalize(rows.select(F.when(even, "own").alias("problem"), F.when(even, "own 7").otherwise("").alias("solution"), "conversations"), "columns_or_turns", "s")


@query(f"SELECT problem, CASE WHEN pair_id % 2 = 0 THEN 'own 7' || chr(10) || chr(10) || 'The answer is \\boxed{{7}}.' ELSE {_BOX_LAST.format('solution')} END AS solution, 's' AS source FROM sft_pairs WHERE {_FILLED} AND pair_id IS NOT NULL")
def messages_or_answer_normalized(spark, d):
    pairs = table(spark, d, "sft_pairs").filter("pair_id IS NOT NULL")
    pairs = normalize.keep_filled(pairs, "problem", "solution")
    rows = pairs.select(normalize.chat(F.col("problem"), F.col("solution"), "S").alias("messages"), F.when(F.col("pair_id") % 2 == 0, "own 7").alias("answer"))
    return normalize.normalize(rows, "messages_or_answer", "s")


@query("SELECT name FROM datasets")
def registered(spark, d):
    names = table(spark, d, "datasets").select("name")
    return extras.register(names.filter("name < 'm'"), names.filter("NOT name < 'm'"), "name")


@query("SELECT name, dataset_type AS stage, CASE WHEN dataset_type = 'pretrain' THEN CAST(total_tokens AS VARCHAR) END AS tokens, CASE WHEN dataset_type = 'sft' THEN source END AS source FROM datasets")
def stage_records(spark, d):
    record = extras.stage_record(F.col("dataset_type"), {"name": F.col("name")}, {"pretrain": {"tokens": F.col("total_tokens")}, "sft": {"source": F.col("source")}})
    fields = [F.get_json_object("r", f"$.{k}").alias(k) for k in ("stage", "tokens", "source")]
    return table(spark, d, "datasets").select("name", record.alias("r")).select("name", *fields)


@query("SELECT user_id, event_id, value, min(value) OVER u AS best, coalesce(past <> 0 AND (past - value) / abs(past) < 0.005, false) AS plateau FROM (SELECT *, lag(value, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS past FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL) WINDOW u AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def stream_monitor(spark, d):
    schema = table(spark, d, "events").schema
    stream = logs.file_stream(spark, os.path.join(d, "events.parquet*"), schema).filter("value IS NOT NULL AND user_id IS NOT NULL").select("user_id", "event_id", "value")
    return logs.run_once(logs.plateau_monitor(stream, "user_id", "event_id", "value"), _folder(spark), "append")


_RAW_AT = "list_sort(list(n_chars))[{p} * count(*) // 100 + 1]"


@query(f"SELECT {SOURCE_SQL} AS source, count(*) AS n_rows, " + ", ".join(f"{_RAW_AT.format(p=p)} AS p{p}" for p in (50, 90, 100)) + " FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def raw_percentiles(spark, d):
    rows = table(spark, d, "documents").select(L.source_label(F.col("source")).alias("source"), "n_chars")
    return profile.floor_percentiles(rows, "source", F.col("n_chars"), (50, 90, 100), clamped=False)
