"""Normalizers: tables of several shapes to problem, solution, source; and back to chat form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X

MESSAGES = "array<struct<role:string,content:string>>"
# Names of the two speakers in foreign conversations.
USERS, ASSISTANTS = ("user", "human"), ("assistant", "gpt")


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that is there and not empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(None).cast("string"))


def turns(df: DataFrame, messages: str) -> Column:
    """Messages of either naming, role and content or from and value, as role and content; the first name that is there and filled counts."""
    fields = df.schema[messages].dataType.elementType.fieldNames()

    def named(m: Column, *names: str) -> Column:
        return F.coalesce(*[F.nullif(m[n], F.lit("")) for n in names if n in fields], F.lit(""))

    return F.transform(messages, lambda m: F.struct(named(m, "role", "from").alias("role"), named(m, "content", "value").alias("content")))


def last_of(messages: Column, roles: tuple[str, ...]) -> Column:
    """Content of the last message of the roles, null if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: F.lower(m["role"]).isin(*roles)), F.lit(-1))["content"]


def from_columns(df: DataFrame, problem: tuple[str, ...], solution: tuple[str, ...], boxed: bool = True) -> DataFrame:
    """Aliased columns; the solution gets a boxed answer put after it where it has none."""
    s = first_filled(df, *solution)
    return df.select(first_filled(df, *problem).alias("problem"), (X.ensure_boxed(s) if boxed else s).alias("solution"))


def from_columns_or_turns(df: DataFrame, messages: str = "conversations") -> DataFrame:
    """problem and solution columns where both are filled, else the last turns of both speakers; the last number boxed after it."""
    p, s = first_filled(df, "problem"), first_filled(df, "solution")
    if messages in df.columns:
        t = turns(df, messages)
        both = p.isNotNull() & s.isNotNull()
        # A column that is filled alone stays unless the conversation has that speaker.
        p, s = F.when(both, p).otherwise(F.coalesce(last_of(t, USERS), p)), F.when(both, s).otherwise(F.coalesce(last_of(t, ASSISTANTS), s))
    return df.select(p.alias("problem"), X.box_last_number(s).alias("solution"))


def from_turns(df: DataFrame, messages: str) -> DataFrame:
    """The last turns of both speakers of a conversation, whichever way its fields are named; the last number boxed after it."""
    t = turns(df, messages)
    return df.select(last_of(t, USERS).alias("problem"), X.box_last_number(last_of(t, ASSISTANTS)).alias("solution"))


def from_messages_or_answer(df: DataFrame, messages: str = "messages", answer: str = "answer") -> DataFrame:
    """The last user message, and the answer column or else the last assistant message; the last number boxed after it."""
    t = turns(df, messages)
    return df.select(last_of(t, ("user",)).alias("problem"), X.box_last_number(F.coalesce(first_filled(df, answer), last_of(t, ("assistant",)))).alias("solution"))


def eval_items(df: DataFrame, dataset: str, order: str) -> DataFrame:
    """Evaluation items from rows with problem or question, and answer or solution.

    The answer is the boxed content where there is one, without commas and final full stops; ids are made from the
    data set and the position in ``order`` (whose ties have no defined place). Few items, as an evaluation set has.
    """
    a = first_filled(df, "answer", "solution")
    ranked = df.withColumn("__at", F.row_number().over(W.orderBy(order)) - 1)
    return ranked.select(X.item_id(F.lit(dataset), F.col("__at")).alias("problem_id"), F.lit(dataset).alias("dataset"), first_filled(df, "problem", "question").alias("problem"), X.clean_answer(F.coalesce(X.boxed(a), a, F.lit(""))).alias("answer"), first_filled(df, "solution").alias("solution"))


def of_source(df: DataFrame, part: str, most: int, order: str, source: str = "source") -> DataFrame:
    """The first ``most`` rows whose source holds ``part`` in any case."""
    return df.filter(F.contains(F.lower(F.col(source)), F.lit(part.lower()))).orderBy(order).limit(most)


def from_hashes(df: DataFrame, problem: str, solution: str) -> DataFrame:
    """Working #### answer: calculator marks deleted, the answer boxed in a last paragraph; rows without an answer are left out."""
    working, answer = X.split_hashes(F.col(solution))
    return df.withColumn("__w", working).withColumn("__a", answer).filter("__a <> ''").select(F.col(problem).alias("problem"), F.concat("__w", F.lit("\n\nThe answer is \\boxed{"), "__a", F.lit("}.")).alias("solution"))


def from_messages(df: DataFrame, messages: str, think: bool = False) -> DataFrame:
    """Last user and last assistant message; a think block is unwrapped on request."""
    m = F.col(messages)
    s = last_of(m, ASSISTANTS)
    return df.select(last_of(m, USERS).alias("problem"), (X.unwrap_think(s) if think else s).alias("solution"))


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "hashes": lambda df: from_hashes(df, "question", "answer"),
    "query_response": lambda df: from_columns(df, ("query",), ("response",)),
    "problem_solution": lambda df: from_columns(df, ("problem", "question", "instruction"), ("solution", "answer", "output", "response", "generated_solution")),
    "conversation": lambda df: from_messages(df, "conversations"),
    "messages": lambda df: from_messages(df, "messages", think=True),
    "columns_or_turns": lambda df: from_columns_or_turns(df),
    "turns": lambda df: from_turns(df, "conversations"),
    "messages_or_answer": lambda df: from_messages_or_answer(df),
}


def normalize(df: DataFrame, shape: str, source: str, low: int = 0, high: int = 0) -> DataFrame:
    """problem, solution, source by the named shape, without blank rows and rows outside the character band (0: no bound)."""
    if shape not in NORMALIZERS:
        raise ValueError(f"no normalizer {shape!r}; there are {', '.join(NORMALIZERS)}")
    out = keep_filled(NORMALIZERS[shape](df), "problem", "solution").withColumn("source", F.lit(source))
    return char_band(out, F.length("problem") + F.length("solution"), low, high)


def keep_filled(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which none of the columns is null or blank."""
    for n in names:
        df = df.filter(~X.blank(F.col(n)))
    return df


def char_band(df: DataFrame, n: Column, low: int, high: int) -> DataFrame:
    """low <= n <= high; a bound of 0 or less is none."""
    if low > 0:
        df = df.filter(n >= low)
    return df.filter(n <= high) if high > 0 else df


def chat(problem: Column, solution: Column, system: str) -> Column:
    """System, user and assistant message."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", problem), ("assistant", solution))]).cast(MESSAGES)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts, columns by name; a part that lacks one has nulls there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole
