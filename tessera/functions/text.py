"""Text expressions: normal forms, answer extraction and format flags, all inside the JVM.

The patterns use explicit character classes, so that Java and RE2 read them alike: WS is what Unicode counts
as white space, and (?d) keeps the dot from stopping at other line ends than the line feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BOXED = r"\\boxed\{([^}]+)\}"
NUMBER = r"-?[0-9]+\.?[0-9]*"
HASHES = r"(?dm)####[\s]*(.+?)$"
ANSWER_IS = r"(?d)[Tt]he (?:final )?answer is[:\s]*(.+?)[\.\n]"
FRACTION = r"\\?frac\{([^}]+)\}\{([^}]+)\}"
THINK = r"(?s)<think>(.*?)</think>(.*)"
CALCULATOR = r"<<[^>]*>>"


def strip(col: Column) -> Column:
    """White space of any script removed at both ends."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def blank(col: Column) -> Column:
    """True for null, empty and white space only."""
    return F.coalesce(strip(col) == "", F.lit(True))


def normal_form(col: Column) -> Column:
    """Lower case with single spaces: equal for texts that differ only in case and spacing."""
    return strip(F.regexp_replace(F.lower(col), f"{WS}+", " "))


def last_match(col: Column, pattern: str, group: int = 1) -> Column:
    """A group of the last match, null where nothing matches."""
    return F.try_element_at(F.regexp_extract_all(col, F.lit(pattern), F.lit(group)), F.lit(-1))


def first_match(col: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches (an empty match stays empty)."""
    return F.when(col.rlike(pattern), F.regexp_extract(col, pattern, group))


def boxed(col: Column) -> Column:
    """Content of the last \\boxed{...}, which may not hold a closing brace."""
    return last_match(col, BOXED)


def last_number(col: Column) -> Column:
    return last_match(col, NUMBER, 0)


def bind(col: Column, step: Callable[[Column], Column]) -> Column:
    """step(col) with ``col`` evaluated once: bound to a lambda variable, which the optimizer does not replace by its expression."""
    return F.element_at(F.transform(F.array(col), step), 1)


def answer(col: Column) -> Column:
    """Answer of a solution: boxed, else after ####, else after "the answer is" up to a full stop or line end, else the last number; blank is null.

    The first rule that matches decides, also where its content is blank.
    """
    found = bind(col, lambda t: F.coalesce(strip(last_match(t, BOXED)), strip(F.try_element_at(F.regexp_extract_all(t, F.lit(HASHES), F.lit(1)), F.lit(1))), strip(F.try_element_at(F.regexp_extract_all(t, F.lit(ANSWER_IS), F.lit(1)), F.lit(1))), last_match(t, NUMBER, 0)))
    return bind(found, lambda a: F.nullif(a, F.lit("")))


def _number_form(value: Column) -> Column:
    """A finite number as a string, an integral one without its point; null otherwise."""
    plain = F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), plain)


def normal_answer(col: Column) -> Column:
    """Form in which equal answers are equal strings.

    A fraction of two numbers (\\frac or a/b) becomes its value to six places, an integral number loses its
    point, currency signs, commas, backslashes and white space go; whatever is no number is lower case. Each
    step is bound once, so that the whole stays small however it is nested.
    """
    decimal = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(top.rlike(decimal) & bottom.rlike(decimal) & (bottom.try_cast("double") != 0), F.round(top.try_cast("double") / bottom.try_cast("double"), 6))

    def plain(bare: Column) -> Column:
        value = F.when(bare.rlike(decimal), bare.try_cast("double")).when(bare.rlike(r"^-?[0-9]+/-?[0-9]+$"), ratio(F.split_part(bare, F.lit("/"), F.lit(1)), F.split_part(bare, F.lit("/"), F.lit(2))))
        return F.coalesce(bind(value, _number_form), F.lower(bare))

    def form(text: Column) -> Column:
        fraction = bind(F.when(text.rlike(FRACTION), ratio(strip(F.regexp_extract(text, FRACTION, 1)), strip(F.regexp_extract(text, FRACTION, 2)))), _number_form)
        return F.coalesce(fraction, bind(F.regexp_replace(text, rf"[$\\,]|{WS}", ""), plain))

    return bind(col, form)


def ensure_boxed(col: Column) -> Column:
    """The text with a boxed answer put after it where it has none, taken from ####, "the answer is" or the last number."""

    def boxed_in(t: Column) -> Column:
        found = F.coalesce(first_match(t, HASHES), first_match(t, ANSWER_IS), last_number(t))
        return F.when(F.contains(t, F.lit("\\boxed{")), t).otherwise(F.coalesce(bind(found, lambda a: F.concat(t, F.lit("\n\nThe answer is \\boxed{"), strip(a), F.lit("}"))), t))

    return bind(col, boxed_in)


def box_last_number(col: Column) -> Column:
    """The text with its last number boxed after it, in a sentence with a full stop, where it has no boxed answer; the simpler form of ensure_boxed."""
    return bind(col, lambda t: F.when(F.contains(t, F.lit("\\boxed{")), t).otherwise(F.coalesce(bind(last_number(t), lambda n: F.concat(t, F.lit("\n\nThe answer is \\boxed{"), n, F.lit("}."))), t)))


def level_number(col: Column) -> Column:
    """5 of "Level 5"; null where no such label is."""
    return F.regexp_extract(col, r"^\s*Level ([0-9]+)\s*$", 1).try_cast("int")


def whole_number(col: Column) -> Column:
    """An answer such as "12.0" as a whole number, cut towards zero; null where it is no number."""
    return col.try_cast("double").cast("bigint").cast("string")


def item_id(name: Column, position: Column) -> Column:
    """Made-up id of an item: its file or data set and its position in four digits or more."""
    return F.concat(name, F.lit("_"), F.when(position < 10_000, F.lpad(position.cast("string"), 4, "0")).otherwise(position.cast("string")))


def eval_prompt(problem: Column) -> Column:
    """The instruction that evaluated models are given, around the problem."""
    # Fixed value: the wording of the instruction.
    return F.concat(F.lit("Solve the following math problem step by step. Put your final answer in \\boxed{}.\n\nProblem: "), problem, F.lit("\n\nSolution:"))


def chat_prompt(problem: Column) -> Column:
    """The same instruction as the one user turn of a conversation, for models with a chat template."""
    # Fixed value: the wording of the instruction.
    said = F.concat(F.lit("Solve the following math problem step by step. Put your final answer in \\boxed{}.\n\n"), problem)
    return F.array(F.struct(F.lit("user").alias("role"), said.alias("content")))


def few_shot_prompt(examples: list[tuple[str, str]], problem: Column) -> Column:
    """Worked examples as questions and answers, then the problem and an open answer, for models without one."""
    shown = "".join(f"Q: {q}\nA: {a}\n\n" for q, a in examples)
    return F.concat(F.lit(shown + "Q: "), problem, F.lit("\nA:"))


def as_document(problem: Column, solution: Column) -> Column:
    """A pair as one text for pretraining."""
    return F.concat(F.lit("Problem: "), problem, F.lit("\n\nSolution: "), solution)


def strip_fence(col: Column) -> Column:
    """The content of a text that is one fenced block, else the text, stripped."""
    return strip(F.regexp_replace(strip(col), r"^```[A-Za-z]*[\s]*|[\s]*```$", ""))


def experiment_id(col: Column) -> Column:
    """Id of an experiment from the path of its adapter: leading slashes, the checkpoint folder and "sft-" go."""
    return F.regexp_replace(F.regexp_replace(col, r"^/+", ""), "checkpoints/|sft-", "")


def code_points(col: Column) -> Column:
    """Code points of a text as ids: the tokenizer that needs no vocabulary. Null has none."""
    return F.transform(F.filter(F.split(F.coalesce(col, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c))


def with_end(ids: Column, end: int = 50_256) -> Column:
    """Ids with the end-of-text token after them."""
    return F.concat(ids, F.array(F.lit(end)))


def clean_answer(col: Column) -> Column:
    """Stripped, without commas and trailing full stops."""
    return F.regexp_replace(F.regexp_replace(strip(col), ",", ""), r"\.+$", "")


def unwrap_think(col: Column) -> Column:
    """Reasoning and answer of the first think block as two paragraphs; other texts unchanged."""
    return F.when(col.rlike(THINK), F.concat(strip(F.regexp_extract(col, THINK, 1)), F.lit("\n\n"), strip(F.regexp_extract(col, THINK, 2)))).otherwise(col)


def split_hashes(col: Column) -> tuple[Column, Column]:
    """(working, answer) of a solution of the form working #### answer; the last part is the answer, null if there is none."""
    parts = F.split(F.regexp_replace(col, CALCULATOR, ""), "####")
    return strip(F.element_at(parts, 1)), F.when(F.size(parts) > 1, strip(F.element_at(parts, -1)))


def split_boxed(col: Column) -> tuple[Column, Column]:
    """(reasoning, answer) at the last \\boxed{; without one all is reasoning."""
    at = r"(?s)^(.*)(\\boxed\{.*)$"
    return F.when(col.rlike(at), F.regexp_extract(col, at, 1)).otherwise(col), first_match(col, at, 2)


def words(col: Column) -> Column:
    """Words of the default splitter: runs without white space. Not the tokens of any public vocabulary."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), f"{WS}+"), lambda w: w != "")


def difficulty(n_tokens: Column) -> Column:
    """Level 1 to 5 by length."""
    return F.when(n_tokens < 100, 1).when(n_tokens < 300, 2).when(n_tokens < 600, 3).when(n_tokens < 1200, 4).otherwise(5)


def estimated_tokens(n_chars: Column) -> Column:
    """floor(chars / 3.5) + 60 in whole numbers."""
    return F.floor(n_chars * 2 / F.lit(7)).cast("bigint") + 60


def truncate_middle(tokens: Column, most: int, marker: str = "[...]") -> Column:
    """Head, marker and tail of a token array that is longer than ``most``; min(200, most / 4) tokens stay at the end."""
    tail = min(200, most // 4)
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.concat(F.slice(tokens, 1, most - tail), F.array(F.lit(marker)), F.slice(tokens, F.size(tokens) - tail + 1, tail)))


def repeats(tokens: Column, window: int = 20, times: int = 3) -> Column:
    """Does a window of tokens recur ``times`` times on end? (window * (times - 1) equal neighbours at that distance)"""
    n = window * (times - 1)
    rest = F.greatest(F.size(tokens) - window, F.lit(0))
    same = F.zip_with(F.slice(tokens, 1, rest), F.slice(tokens, window + 1, rest), lambda a, b: (a == b).cast("int"))
    longest = F.aggregate(same, F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), lambda a, s: F.struct(F.when(s == 1, a["run"] + 1).otherwise(0).alias("run"), F.greatest(a["best"], F.when(s == 1, a["run"] + 1).otherwise(0)).alias("best")))
    return longest["best"] >= n


def window_hashes(words: Column, n: int) -> Column:
    """Distinct hashes of the n-word windows, the whole array being one if it is shorter.

    The array is bound to a lambda variable first: inside a lambda the optimizer would put the expression
    that makes it in place of its name, and split the text again for every window.
    """
    bound = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, n)))))
    return F.array_distinct(F.element_at(bound, 1))
