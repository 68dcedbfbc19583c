"""Broken prompt and response pairs (problem 3).

The clauses of an answer are tagged answer, refusal, echo, foreign or unfinished (or hollow: a placeholder or a
frame that says nothing) by a linear-chain conditional random field; how much of the answer the tags cover
decides whether the pair is defective and how. The field sees the clause's words and word pairs, what stands at
the end of the last clause, how much of the clause is the problem's wording, and how well its letters fit the
problem's language; no list of phrases decides anything. The weights in defect_crf.npz come from
train_defects.py.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished", "hollow")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED, HOLLOW = range(len(TAGS))
LANGS = ("en", "de", "fr", "es", "ru", "zh")
BUCKETS = 1 << 14  #: hashed words, word pairs and endings
GRAMS = 1 << 13  #: hashed letter groups of the language scores
SLICE_ROWS = 2048
CACHE_CLAUSES = 150_000
CACHE_WORDS = 300_000
SHARE = 0.6  #: of the words that an echo or a foreign language has to cover
N_DENSE = 18

_UNSEEN = re.compile("[­​-‏⁠﻿]")
_THINK = re.compile(r"</?think>")
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,60}>|&nbsp;")
_LIST = re.compile(r"(?m)^[ \t]*(?:\d{1,3}[.)]|[-*•])[ \t]+(?=\S)")
_SPLIT = re.compile(r"(?<=[.!?])[\"”»)]*\s+|(?<=[。！？])|(?<=[:：])\s+|\n+")
_TOKEN = re.compile(r"[一-鿿぀-ヿ]|[^\W_一-鿿぀-ヿ]+")
_NUMBER = re.compile(r"\d+")
_COMMAND = re.compile(r"\\[a-zA-Z]+")
_SHAPE = re.compile(r"\$[^$]*\$|\d+")
_RESULT = re.compile(r"=\s*(\d+)")


def tokens(text: str) -> list[str]:
    """Words and numbers in lower case without markup; each ideograph is a word."""
    return _TOKEN.findall(_COMMAND.sub(" ", text.lower()) if "\\" in text else text.lower())


@lru_cache(100_000)
def bucket(name: str, of: int = BUCKETS) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % of


def letter_groups(word: str) -> list[int]:
    """Hashed groups of two and three letters of a word; of another script, the script."""
    if word > "ʯ":
        code = ord(word[0])
        return [bucket("script" + ("cyrillic" if 0x400 <= code < 0x530 else "han" if 0x3400 <= code < 0xA000 else str(code >> 8)), GRAMS)]
    held = f"^{word}$"
    return [bucket(held[i : i + n], GRAMS) for n in (2, 3) for i in range(len(held) - n + 1)]


class Clause(NamedTuple):
    n: int
    words: frozenset[str]
    numbers: frozenset[str]
    lexical: np.ndarray  #: what the words and word pairs add to each tag
    lang: np.ndarray  #: how the letters speak for each language


class Problem(NamedTuple):
    words: frozenset[str]
    n: int
    lang: np.ndarray


class Field:
    """Weights of the conditional random field, and the best tags for a batch of answers."""

    def __init__(self, hashed: np.ndarray, dense: np.ndarray, move: np.ndarray, grams: np.ndarray):
        self.hashed, self.dense, self.move, self.grams = (x.astype(np.float32) for x in (hashed, dense, move, grams))
        self._words: dict[str, tuple[int, np.ndarray]] = {}
        self._shapes: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._clauses: dict[str, Clause] = {}
        self._grams_of_numbers = np.zeros(len(LANGS), np.float32)

    @classmethod
    @cache
    def load(cls) -> Field:
        with np.load(Path(__file__).parent / "defect_crf.npz") as held:
            return cls(held["hashed"], held["dense"], held["move"], held["grams"])

    def word(self, word: str) -> tuple[int, np.ndarray]:
        """Hash of a word and its language scores; a number is just a number."""
        known = self._words.get(word)
        if known is None:
            if word[0].isdigit() or not word.isalpha():
                known = bucket("#", 1 << 31), self._grams_of_numbers
            else:
                known = bucket(word, 1 << 31), self.grams[letter_groups(word)].mean(0)
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            if len(word) <= 64:
                self._words[word] = known
        return known

    def lexicon_rows(self, shape: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words and word pairs of a clause whose numbers and formulas are blanked, and its language scores."""
        told = [self.word(w) for w in tokens(shape)]
        if not told:
            return np.array([bucket("<no words>")]), self._grams_of_numbers
        ids = np.array([1, *(t[0] for t in told), 2], np.int64)
        pairs = (ids[:-1] * 31 + ids[1:] * 17) % (BUCKETS - 1)
        return np.concatenate([ids[1:-1] % BUCKETS, pairs]), np.sum([t[1] for t in told], axis=0)

    def clause(self, text: str) -> Clause:
        """What can be said of a clause by itself; many recur, so a worker remembers them."""
        known = self._clauses.get(text)
        if known is None:
            shape = _SHAPE.sub("0", text)
            held = self._shapes.get(shape)
            if held is None:
                rows, lang = self.lexicon_rows(shape)
                held = self.hashed[rows].sum(0) / np.sqrt(len(rows)), lang
                if len(self._shapes) >= CACHE_CLAUSES:
                    self._shapes.clear()
                if len(shape) < 400:
                    self._shapes[shape] = held
            words = tokens(text)
            known = Clause(len(words), frozenset(words), frozenset(w for w in words if w[0].isdigit()), *held)
            if len(self._clauses) >= CACHE_CLAUSES:
                self._clauses.clear()
            if len(text) < 400:
                self._clauses[text] = known
        return known

    def problem(self, text: str | None) -> Problem:
        words = tokens(text) if text else []
        return Problem(frozenset(words), len(words), np.sum([self.word(w)[1] for w in words], axis=0) if words else self._grams_of_numbers)

    def features(self, problems: list[Problem], parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[Clause]]]:
        """A row of numbers for each clause of all answers, what its words add to each tag, the hashed endings of each answer, and its clauses."""
        inside, fresh, told, covered, inside_all, fresh_all, ends, all_told = [], [], [], [], [], [], [], []
        for problem, of in zip(problems, parts, strict=True):
            own = problem.words
            mine = [self.clause(p) for p in of]
            told += mine
            all_told.append(mine)
            new = 0
            for c in mine:
                inside.append(len(c.words & own))
                k = 0 if c.numbers <= own else len(c.numbers - own)
                fresh.append(k)
                new += k
            said = frozenset().union(*[c.words for c in mine])
            both = len(said & own)
            covered.append(both / len(own) if own else 0.0)
            inside_all.append(both / len(said) if said and not new else 0.0)
            fresh_all.append(float(new > 0))
            ends.append(ending(of, mine[-1]))
        counts = np.array([len(of) for of in parts])
        owner = np.repeat(np.arange(len(parts)), counts)
        n = np.array([c.n for c in told], np.float32)
        distinct = np.array([len(c.words) for c in told], np.float32)
        numbered = np.array([bool(c.numbers) for c in told])
        spoken = np.array([c.lang for c in told], np.float32)
        within = np.array(inside, np.float32) / np.maximum(1, distinct)
        fresh, fresh_all = np.array(fresh) > 0, np.array(fresh_all, np.float32)
        of_problem = np.array([p.lang for p in problems], np.float32)
        ranked = np.sort(of_problem, axis=1)
        lang, sure = of_problem.argmax(1), ranked[:, -1] - ranked[:, -2] > 0.25
        starts = np.cumsum(counts) - counts
        fit = fits(spoken, lang[owner], n) * sure[owner]
        whole = (fits(np.add.reduceat(spoken, starts), lang, np.add.reduceat(n, starts)) * sure)[owner]
        at = np.arange(len(owner)) - starts[owner]
        dense = np.stack(
            [
                np.ones(len(owner)), within, np.maximum(0, within - 0.6), within * ~fresh * (1 - fresh_all[owner]), fresh, numbered & ~fresh,
                np.log1p(n), np.maximum(0, fit), np.maximum(0, -fit), np.maximum(0, whole), np.maximum(0, -whole),
                at == 0, at == counts[owner] - 1, counts[owner] == 1, np.array(covered)[owner], np.array(inside_all)[owner], fresh_all[owner], distinct == 0,
            ],
            axis=1,
        ).astype(np.float32)
        return dense, np.array([c.lexical for c in told], np.float32), np.array(ends), all_told

    def score(self, dense: np.ndarray, lexical: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What each clause of all answers adds to each tag."""
        emitted = dense @ self.dense + lexical
        emitted[np.cumsum(counts) - 1] += self.hashed[ends].sum(1)
        return emitted

    def tag(self, problems: list[Problem], parts: list[list[str]]) -> tuple[list[list[Clause]], list[np.ndarray]]:
        """(clauses, best tags) of each answer; no answer may be without clauses."""
        if not parts:
            return [], []
        counts = np.array([len(of) for of in parts])
        *seen, told = self.features(problems, parts)
        return told, self.decode(self.score(*seen, counts), counts)

    def decode(self, emitted: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Viterbi over all answers at once, the longest first, so that no step works on padding."""
        offset = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        lengths, first = counts[order], offset[order]
        steps = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # answers longer than t
        score = emitted[first]
        back = [np.zeros(0)]
        for t in range(1, steps):
            n = live[t]
            paths = score[:n, :, None] + self.move
            back.append(paths.argmax(1))
            score[:n] = paths.max(1) + emitted[first[:n] + t]
        tags = np.zeros(len(emitted), np.int8)
        at = score.argmax(1)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            tags[first[:n] + t] = at[:n]
            if t:
                at[:n] = back[t][np.arange(n), at[:n]]
        return np.split(tags, offset[1:])


def fits(scores: np.ndarray, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How much better a row's language fits than the best other one, per root of the words, within -3 and 3."""
    at = np.arange(len(scores))
    others = scores.copy()
    others[at, lang] = -np.inf
    return np.clip((scores[at, lang] - others.max(1)) / np.sqrt(np.maximum(1, n)), -3, 3)


def clauses(solution: str | None) -> list[str]:
    """Clauses in order, without markup; none for null, blank and texts of invisible characters."""
    if not solution:
        return []
    text = solution
    if not text.isascii():
        text = _UNSEEN.sub("", unicodedata.normalize("NFC", text))
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", _THINK.sub("\n", text))
    return [c for c in map(str.strip, _SPLIT.split(_LIST.sub("", text.strip()))) if c]


def ending(parts: list[str], clause: Clause) -> list[int]:
    """Hashed descriptions of how the last clause ends: its last characters, its last words, what is left open."""
    last = parts[-1]
    tail = last.rstrip("*_ \t")[-6:]
    final = tail[-1:]
    kind = "letter" if final.isalpha() else "digit" if final.isdigit() else final
    words = _TOKEN.findall(last[-120:].lower())[-2:]
    told = [("#" if w[:1].isdigit() else w) for w in ["", "", *words][-2:]]
    plain = clause.n - len(clause.numbers)
    size = "0" if plain <= 0 else "1" if plain == 1 else "2-3" if plain <= 3 else "4+"
    opened = (last.count("$") % 2, last.count("{") > last.count("}"), last.count("(") > last.count(")"), last.count("[") > last.count("]"), last.count("```") % 2)
    before = " ".join(parts[-4:-1])
    prefix = False  # is the last number the beginning of the last result before?
    if kind == "digit" and (at := before.rfind("=")) >= 0:
        result, shown = _RESULT.match(before, at), _NUMBER.findall(last)[-1:]
        prefix = bool(result and shown and result[1] != shown[0] and result[1].startswith(shown[0]))
    only = len(parts) == 1
    trailing = re.sub(r"\w+", "w", tail)
    frame = "=" in last or "####" in last or "boxed" in last
    return [bucket(f"E|{x}") for x in (f"k{kind}", f"k{kind}|{size}", f"k{kind}|o{any(opened)}", f"o{opened}", f"t{trailing}", f"k{kind}|w{told[1]}", f"k{kind}|w{told[0]}", f"p{prefix}", f"k{kind}|{size}|{only}|{frame}")]


def judge(problem: Problem, told: list[Clause], tags: np.ndarray) -> str | None:
    """The defect that the tags' coverage of the words amounts to, if any."""
    cover = [0] * len(TAGS)
    last, tail = HOLLOW, 0  # the last tag that says something, and the words after the last refusal
    for c, tag in zip(told, tags.tolist(), strict=True):
        cover[tag] += c.n
        tail = 0 if tag == REFUSAL else tail + c.n * (tag != HOLLOW)
        if tag == UNFINISHED or tag != HOLLOW and c.n:
            last = tag
    total = sum(cover) - cover[HOLLOW]
    if not total and last != UNFINISHED:
        return "empty"
    if cover[REFUSAL] > tail:
        return "refusal"  # whatever was worked out before, little or nothing follows
    if problem.n and cover[ECHO] >= SHARE * total and last in (ECHO, UNFINISHED) and not cover[ANSWER] > cover[ECHO] / 4:
        return "copy"
    if cover[FOREIGN] and cover[FOREIGN] >= SHARE * (total - cover[ECHO]):
        return "language"
    return "truncated" if last == UNFINISHED else None


def verdicts(field: Field, problems: list[str | None], solutions: list[str | None]) -> list[str | None]:
    """The defect of each pair, or nothing."""
    known: dict[str | None, Problem] = {}
    of = [known.get(p) or known.setdefault(p, field.problem(p)) for p in problems]
    parts = [clauses(s) for s in solutions]
    filled = [k for k, p in enumerate(parts) if p]
    out: list[str | None] = ["empty"] * len(parts)
    for k, told, tags in zip(filled, *field.tag([of[k] for k in filled], [parts[k] for k in filled]), strict=True):
        out[k] = judge(of[k], told, tags)
    return out


def find_defects(pairs: DataFrame) -> DataFrame:
    """pair_id and defect of each defective pair, once.

    A null or blank solution, or one whose clauses are all hollow, is empty. A null or blank problem is no
    defect and excludes copy and language. A pair delivered again is judged once (its texts are the same);
    rows without pair_id come out with a null one. Short answers, formulas alone and answers that restate the
    problem first are no defects. Columns besides pair_id, problem and solution are ignored; an empty table
    has no defects. Narrow but for a last exchange of the found rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field.load()
        for whole in batches:
            for batch in (whole.slice(i, SLICE_ROWS) for i in range(0, whole.num_rows, SLICE_ROWS)):
                ids, problems, solutions = (c.to_pylist() for c in batch.columns)
                rows = [(i, d) for i, d in zip(ids, verdicts(field, problems, solutions), strict=True) if d]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["pair_id", "defect"])

    return pairs.select(F.col("pair_id").cast("bigint").alias("pair_id"), "problem", "solution").mapInArrow(run, "pair_id bigint, defect string").distinct()
