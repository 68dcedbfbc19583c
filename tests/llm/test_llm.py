"""The training-data operators against brute force, exact round trips and stated cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, defects, leakage, mixing, packing, pii, queries, tokens


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PIECE_PATTERN, mergeable_ranks=bpe.read_ranks(bpe.vocabulary_bytes()), special_tokens={})


def test_bpe_is_exact(reference):
    raw = bpe.vocabulary_bytes()
    encoder, counter, rng = bpe.PrefixEncoder(raw), bpe.MergeCounter(raw), random.Random(1)
    alphabet = "aaaabbb theinson  \n\t0123éß中文字😀́\x1c\x85²½Ⅷ'’stre  "
    texts = ["", " ", "\r\n\r\n", "a" * 5000, "ab" * 3000, " " * 4000 + "x", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000))]
    for t in texts:
        want = reference.encode_ordinary(t)
        assert encoder.encode(t) == want and counter.count(t) == len(want)


def test_suffix_matches_by_trying_every_suffix():
    encoder, rng = bpe.PrefixEncoder(bpe.vocabulary_bytes()), random.Random(4)
    for _ in range(300):
        data = "".join(rng.choice(" theinsonaé中\n1") for _ in range(rng.randrange(1, 40))).encode()
        found = {(end + 1 - length, end + 1, token) for end, (length, token) in encoder.automaton.iter(data.decode("latin-1"))}
        assert found == {(i, j, encoder.ranks[data[i:j]]) for i in range(len(data)) for j in range(i + 1, len(data) + 1) if data[i:j] in encoder.ranks}


def test_ids_and_counts(spark, reference):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (4, "x" * 300_000), (4, "Hello  world")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids_", F.lit(1))
    got = tokens.encode_texts(df).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, reference.encode_ordinary(t or "")) for i, t in rows)
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_token_totals(spark):
    docs = spark.createDataFrame([(1, "a b", "X/edu_web/", "EN", "Algebra"), (2, None, None, None, None)], "doc_id long, text string, source string, lang string, subject string")
    pairs = spark.createDataFrame([(1, "a b c", "s", "en", "x", 1), (1, "a b c", "s", "en", "x", 2), (None, "a", "s", "en", "x", 1), (None, "a", "s", "en", "x", 1)], "pair_id long, solution string, source string, lang string, subject string, ingested_at int")
    counted = tokens.record_tokens(docs, pairs)
    assert sorted((r.corpus, r.n_tokens) for r in counted.collect()) == [("documents", 0), ("documents", 2), ("sft_pairs", 1), ("sft_pairs", 1), ("sft_pairs", 3)]
    totals = tokens.token_totals(counted)
    for name in ("source,lang,subject", "source", "lang", "subject", "all"):
        assert {r.corpus: r.n for r in totals.filter(F.col("slice") == name).groupBy("corpus").agg(F.sum("n_tokens").alias("n")).collect()} == {"documents": 2, "sft_pairs": 5}


def test_packing(spark, reference):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(("alpha", "be", "gamma delta", "7")) for _ in range(rng.randrange(1, 90))) for _ in range(300)] + ["long " * 500, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = packing.pack_sequences(df, capacity=128, group_items=100).collect()
    assert all(r.n_tokens == len(r.ids) == sum(p.length for p in r.pieces) <= 128 for r in out) and len({r.sequence_id for r in out}) == len(out)
    parts = {}
    for r in out:
        at = 0
        for p in r.pieces:
            parts.setdefault(p.doc_id, {})[p.start] = r.ids[at : at + p.length]
            at += p.length
    for i, t in enumerate(texts):
        want = reference.encode_ordinary(t or "")
        assert [x for s in sorted(parts.get(i, {})) for x in parts[i][s]] == want
        assert len(parts.get(i, {})) == -(-len(want) // 128)  # only what is longer than a sequence is cut
    sizes = [len(reference.encode_ordinary(t)) for t in texts if t]
    sizes = [n % 128 for n in sizes if n % 128]
    # No packing has fewer bins than this: items over 128 - k stand alone, those over half part ways, the rest fills up.
    least = max(sum(n > 128 - k for n in sizes) + max(0, -(-sum(n for n in sizes if k <= n <= 128 - k) // 128)) for k in range(1, 65))
    assert len(packing.swap_search(packing.best_fit(sizes, 128), sizes, 128)) <= least + 2
    assert len(out) <= sum(len(reference.encode_ordinary(t)) // 128 for t in texts if t) + 1.05 * least + 4
    sizes = [6, 6, 6, 5, 5, 5, 4, 4, 4, 1]
    assert len(packing.swap_search([[i] for i in range(len(sizes))], sizes, 15)) <= 5
    with pytest.raises(ValueError):
        packing.best_fit([5], 4)


def test_mixing(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 7), "Big_one/" if i % 3 else "small") for i in range(400)] + [(900, "text number 1 text number 1 ", "big-one"), (901, None, "small"), (902, "", None)], "doc_id long, text string, source string")
    sources = spark.createDataFrame([("m", "d/big-one", 0.2), ("m", "d/Big-One//", 0.1), ("m", "small", 0.7), ("m", "ghost", None), ("n", "small", float("nan")), ("x", "small", 1.0)], "mixture string, path string, weight double")
    targets = spark.createDataFrame([("m", 20_000, 2), ("n", 100, 1)], "mixture string, target_tokens long, max_repeats int")
    plan, chosen = mixing.select_mixtures(docs, sources, targets)
    shares = {(r.mixture, r.source): r for r in mixing.mixture_shares(plan, chosen).collect()}
    big, small, ghost = (shares["m", s] for s in ("big-one", "small", "ghost"))
    assert abs(big.wanted_share - 0.3) < 1e-12 and ghost.used_tokens == 0 and shares["n", "small"].used_tokens == 0 and ("x", "small") not in shares
    assert small.limited and small.used_tokens == 2 * small.available_tokens and small.most_copies == 2
    assert 0 <= big.budget_tokens - big.used_tokens < 60 and big.most_copies <= 2 and 901 not in {r.doc_id for r in chosen.collect()}
    assert abs(mixing.entropy(mixing.tempered([8, 1, 1], mixing.entropy_alpha([8, 1, 1], 1.0))) - 1.0) < 1e-6


def test_mixing_fills_small_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TEXTS", 4)
    docs = spark.createDataFrame([(i, f"number {i} " * 9, "big") for i in range(200)] + [(1000 + i, f"little {i} " * (1 + 3 * i), "small") for i in range(7)], "doc_id long, text string, source string")
    goals = range(40, 180, 20)
    sources = spark.createDataFrame([(str(g), "small", 1.0) for g in goals], "mixture string, path string, weight double")
    plan, chosen = mixing.select_mixtures(docs, sources, spark.createDataFrame([(str(g), g, 1) for g in goals], "mixture string, target_tokens long, max_repeats int"))
    encoder = bpe.PrefixEncoder(bpe.vocabulary_bytes())
    size = {1000 + i: len(encoder.encode(f"little {i} " * (1 + 3 * i))) for i in range(7)}
    used = {str(g): set() for g in goals}
    for r in chosen.collect():
        used[r.mixture].add(r.doc_id)
    for r in plan.collect():
        left = r.budget_tokens - sum(size[i] for i in used[r.mixture])
        assert 0 <= left < min((n for i, n in size.items() if i not in used[r.mixture]), default=1)


ITEM = "When the museum of Fernmouth moves to a new wing Celia packs its collection of oak barrels by hand and exactly 48 chests are opened while each of these chests turns out to contain 74 pieces later that week 38 are damaged by rain"


def test_leaks(spark):
    w = ITEM.split()
    rows = [
        (1, f"<p>{ITEM.upper()}</p>"), (2, "intro " + " ".join(w[:24]) + " and more"), (3, " ".join(w[:12])), (4, ITEM.replace("48", "31").replace("74", "22").replace("38", "90").replace("Celia", "Bram").replace("Fernmouth", "Drumlow").replace("oak barrels", "tin toys")),
        (5, " ".join(x if i % 13 else x + "e" for i, x in enumerate(w, 5))), (6, " ".join([*w[:20], "(see", "figure)", *w[20:]])), (7, None), (8, ""), (9, "word " * 50_000 + ITEM),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, None, ITEM), (1, None, ITEM), (2, "x", None)], "pair_id long, problem string, solution string")
    items = spark.createDataFrame([("i", ITEM, None), ("i", ITEM, None), ("short", "Add 2", "4"), (None, ITEM, None)], "problem_id string, problem string, solution string")
    got = {tuple(r) for r in leakage.find_leaks(docs, pairs, items).collect()}
    assert got == {("documents", i, "i") for i in (1, 2, 5, 6, 9)} | {("sft_pairs", 1, "i")}
    assert leakage.find_leaks(docs, pairs, items.limit(0)).count() == 0


def test_leaks_beside_a_variant():
    w = ITEM.split()
    variant = ITEM.replace("48", "31").replace("74", "22").replace("38", "90").replace("Celia", "Bram").replace("Fernmouth", "Drumlow").replace("oak barrels", "tin toys").split()
    index = leakage.ItemIndex([("i", ITEM, None)])
    n = len(w)
    whole = {"before": variant + w[: n // 2 + 1], "after": w[n // 2 - 1 :] + variant, "two": variant + ["so"] * 5 + variant + w[: n // 2 + 1]}
    joined = {"joined": variant[: int(0.7 * n)] + w[n // 2 - 1 :]}
    for texts, want in ((whole | joined, {0}), ({"variants": variant * 3, "less": variant + w[: n // 4]}, set())):
        for text in texts.values():
            assert index.search([" ".join(text)]) == [want]


def test_leaks_of_short_and_chinese_items():
    items = [("short", "What is 12 times 15?", "180"), ("han", "小明有48个苹果，他给了小红23个，又买来17个。", None), ("tiny", "Add 2", "4")]
    index = leakage.ItemIndex(items)
    texts = ["So, what is **12** times 15? It is 180.", "what is 12 times 16", "问：小明有48个苹果，他给了小红23个，然后", "小明有31个苹果，他吃了", "Add 2 and 4", "what is 12 times"]
    assert [{n for p in found for n in index.names[p]} for found in index.search(texts)] == [{"short"}, set(), {"han"}, set(), set(), set()]
    assert leakage.words("共有48个 x_1ー") == ["共", "有", "48", "个", "x", "1ー"]


def test_alignment_by_brute_force():
    rng = random.Random(5)
    import numpy as np

    for _ in range(60):
        a, b = (np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 12))], np.int32) for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -2), h[i - 1][j] - 2, h[i][j - 1] - 2)
        path = leakage.align(a, b)
        assert sum(2 if i >= 0 and j >= 0 and a[i] == b[j] else -2 for i, j in path) == max(map(max, h))


def test_defects(spark):
    p = "Hana buys 24 boxes with 21 clay whistles in each box and gives away 23 of them. How many whistles does Hana have left?"
    cases = {
        "empty": [None, "", "​ ", "N/A", "$\\boxed{ }$", "Answer:", "<think>\n</think>"],
        "truncated": ["First, $24 \\times 21 = 504$. Then $504 - 23 =", "First, $24 \\times 21 = 504$. The remaining quan", "So $24 \\times 21 = 504$. It helps to… [max length]"],
        "refusal": ["I'm sorry, but I can't help with this request. Let me know if there is anything else.", "First, $24 \\times 21 = 504$. Regretfully I'd rather not give the result here."],
        "copy": [p, "You asked: " + p.upper()],
        "language": ["Zuerst gilt $24 \\times 21 = 504$. Das ergibt $504 - 23 = 481$. Die Antwort lautet 481.", "首先，$24 \\times 21 = 504$。因此$504 - 23 = 481$。所以结果为481。"],
        None: ["481", "\\boxed{481}", "First, $24 \\times 21 = 504$. I am sorry, I misread a digit. So $504 - 23 = 481$. The answer is 481", p + " First, $24 \\times 21 = 504$. So the answer is $504 - 23 = 481$.", "The data do not fix it, so the number cannot be determined from the data given. The answer is: not enough information.", "So $504 - 23 = 481$. The Latin phrase quod erat demonstrandum closes the proof."],
    }
    rows, want = [], set()
    for defect, solutions in cases.items():
        for s in solutions:
            rows.append((len(rows), p, s))
            if defect:
                want.add((rows[-1][0], defect))
    rows += [(500, None, "The sum is 5."), (0, p, None)]
    assert {tuple(r) for r in defects.find_defects(spark.createDataFrame(rows, "pair_id long, problem string, solution string")).collect()} == want


def test_personal_data(spark):
    lexicon = spark.createDataFrame([(w, "family") for w in ("Velmork", "Tarnmork", "Osmork", "Velwickel", "Power")] + [("Hana", "given"), ("Will", "given"), (None, "given")], "word string, word_kind string")
    cases = {
        "Mail hana.v+x@mail.host.example, or a.b (at) host (dot) test.": {("email", "hana.v+x@mail.host.example"), ("email", "a.b (at) host (dot) test")},
        "Call +44 (0)20 7946 0877 or 07700-900-254; exercise 637-4564, Order no. 36294629.": {("phone", "+44 (0)20 7946 0877"), ("phone", "07700-900-254")},
        "SSN 000-58-4203, but compute 694-96-1894. DNI 00910766-R. | NINO | QQ 72 43 79 B |": {("id_number", "000-58-4203"), ("id_number", "00910766-R"), ("id_number", "QQ 72 43 79 B")},
        "She lives at 155A Ottermere Rd, Norrhaven. He walks 81 blocks down Quillback Street. Am Kupferbach 55\n149 bis avenue de la Grange-aux-Oies\nC/ de la Noria, 1 or P.O. Box 279.": {("address", x) for x in ("155A Ottermere Rd", "Am Kupferbach 55", "149 bis avenue de la Grange-aux-Oies", "C/ de la Noria, 1", "P.O. Box 279")},
        "Dr. Hana K. Velmork and OSMORK, HANA met. The Tarnmork–Osmork inequality. Will Power series converge? When Y. Tarnwickel asked": {("name", "Hana K. Velmork"), ("name", "OSMORK, HANA")},
        "Hana went home @hana81 2 @ 4.50": set(),
    }
    docs = spark.createDataFrame([*enumerate(cases), (50, None), (51, "")], "doc_id long, text string")
    detected = pii.detect(docs, lexicon)
    got = {}
    for r in pii.found(detected).collect():
        got.setdefault(r.doc_id, set()).add((r.kind, r.found_text))
    for i, want in enumerate(cases.values()):
        assert got.get(i, set()) == want
    text = {r.doc_id: r.text for r in detected.collect()}
    assert text[50] is None and text[51] == "" and text[5] == list(cases)[5] and text[0] == "Mail [EMAIL], or [EMAIL]."
    assert pii.mod97_key("199037512345697"[:13] + f"{97 - int('1990375123456') % 97:02d}") and pii.luhn("79927398713") and pii.letter_23("00000014Z")


ADDRESSES = {
    "en": ("121 Copperbeck Way", "93 Larkspindle Lane", "5 Elm St"),
    "fr": ("3 rue Mila", "4 rue Nod", "149 bis avenue de la Grange-aux-Oies"),
    "FR": ("3 RUE MILA", "4 RUE NOD", "7 QUAI SUD"),
    "de": ("Lindenweg 12", "Hauptstraße 5", "Alte Gasse 7"),
    "es": ("C/ de la Noria, 1", "calle Mayor 22", "Plaza Nueva 3"),
    "box": ("PO Box 12", "Postfach 33", "P.O. Box 279"),
}


@pytest.mark.parametrize("kind", ADDRESSES)
@pytest.mark.parametrize("between", ["\n", "; ", " and "])
def test_addresses_close_together(kind, between):
    text = between.join(ADDRESSES[kind])
    spans = pii.find_spans(text, pii.NameFinder([]))
    assert [(s.kind, text[s.start : s.end]) for s in spans] == [("address", a) for a in ADDRESSES[kind]]


@pytest.mark.parametrize(
    ("text", "numbers"),
    [
        ("national ID: 00080386X\n\nstudent ID: S-05868-8", ["00080386X", "S-05868-8"]),
        ("SSN: 000584203, passport: 12345678", ["000584203", "12345678"]),
        ("passport or student ID 1234567", ["1234567"]),
        ("Das gilt nie. Steuer-ID: 12345678901", ["12345678901"]),
        ("student ID card number 7654321", ["7654321"]),
        ("passport, Steuer-Identifikationsnummer 12345678901", ["12345678901"]),
    ],
)
def test_labelled_numbers_close_together(text, numbers):
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text, pii.NameFinder([]))] == [("id_number", n) for n in numbers]


@pytest.mark.parametrize("at", [f"{o}{g}{w}{g}{c}" for o, c in ("[]", "()", "{}", "<>") for w in ("at", "AT", "At") for g in ("", " ", "\t", "\u00a0", "\u202f")] + ["@", "＠", "&#64;", "&#x40;", "%40", "_at_", "_AT_", " at "])
def test_emails_however_disguised(at):
    for dot in (".", " dot ", " DOT\u00a0", "\tdot\t") if at != " at " else (" dot ", " DOT\u00a0", "\tdot\t"):
        mail = f"a.bo{at}host{dot}test"
        spans = pii.find_spans(f"Mail {mail}!", pii.NameFinder([]))
        assert [(s.kind, s.start, s.end) for s in spans] == [("email", 5, 5 + len(mail))]


def test_queries_agree(spark, folder, reference, tmp_path):
    """Over the whole smallest tables: ids as the public library has them; counts, ids and sequences add up to the same; totals as SQL has them."""
    duckdb = pytest.importorskip("duckdb")
    made = queries.queries()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    ids = {r.doc_id: r.ids for r in made["p5_ids"](spark, folder).collect()}
    assert ids == {k: reference.encode_ordinary(t or "") for k, t in texts.items()}
    counted = made["p4_record_tokens"](spark, folder)
    counted.write.parquet(str(tmp_path / "counted"))
    assert {r.record_id: r.n_tokens for r in counted.filter("corpus = 'documents'").collect()} == {k: len(v) for k, v in ids.items()}
    assert made["p6_fill"](spark, folder).first().n_tokens == sum(map(len, ids.values()))
    want = duckdb.sql(
        f"""SELECT corpus, CASE grouping(source, lang, subject) WHEN 0 THEN 'source,lang,subject' WHEN 3 THEN 'source' WHEN 5 THEN 'lang' WHEN 6 THEN 'subject' ELSE 'all' END AS slice, source, lang, subject, count(*) AS n_records, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
        FROM (SELECT corpus, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(subject, 'unknown') AS subject, n_tokens FROM '{tmp_path}/counted/*.parquet')
        GROUP BY GROUPING SETS ((corpus, source, lang, subject), (corpus, source), (corpus, lang), (corpus, subject), (corpus))"""
    ).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in tokens.token_totals(counted).collect())


CLASHES = ("ids", "n_tokens", "key", "group", "block", "rank", "spans", "corpus", "record_id", "digest", "kind", "found_text", "defect", "copies", "packed", "start", "length", "last", "seed", "mixture", "left")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_tables(spark, folder, name, tmp_path):
    """Nulls in every column, empty tables, repeated rows and columns whose names clash: the same rows as without, and no failure."""
    import shutil

    shutil.copytree(folder, tmp_path / "plain")
    shutil.copytree(folder, tmp_path / "clash")
    shutil.copytree(folder, tmp_path / "empty")
    for t in ("documents", "sft_pairs"):
        df = spark.read.parquet(f"{folder}/{t}.parquet")
        few = df.limit(40).unionByName(df.limit(5)).unionByName(spark.createDataFrame([[None] * len(df.columns)] * 2, df.schema))
        few = spark.createDataFrame(few.collect(), df.schema).coalesce(1)
        for kind, made in (("plain", few), ("clash", few.select("*", *[F.lit("clash").alias(c) for c in CLASHES])), ("empty", df.limit(0))):
            shutil.rmtree(tmp_path / kind / f"{t}.parquet", ignore_errors=True)
            (tmp_path / kind / f"{t}.parquet").unlink(missing_ok=True)
            made.write.parquet(f"{tmp_path}/{kind}/{t}.parquet")
    rows = {k: sorted(map(str, queries.queries()[name](spark, str(tmp_path / k)).collect())) for k in ("plain", "clash", "empty")}
    assert rows["plain"] == rows["clash"] and rows["plain"]
    assert not rows["empty"] or name in ("p1_shares", "p6_fill")  # these report zeros


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, folder, name):
    assert queries.queries()[name](spark, folder).count() > 0
