"""Predicates over a lexicon (id, str, freq, first_cpos): matches in ascending id order."""

from __future__ import annotations

import re

from pyspark.errors import PySparkValueError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LITERAL = re.compile(r"[^\\^$.|?*+()\[\]{}]*")


def build(tokens: DataFrame) -> DataFrame:
    """Types of (word, cpos) numbered by falling frequency, then by first position.

    Types of one frequency are cut into blocks by first position, so that the
    hapaxes of a large corpus are numbered by many tasks.
    """
    from lexaxis.operators.numbering import block_of, numbered
    from lexaxis.sources.shared import settled

    types = settled(tokens.groupBy(F.col("word").alias("str")).agg(F.count("*").alias("freq"), F.min("cpos").alias("first_cpos")))
    types = types.withColumns({"rank": -F.col("freq"), "block": block_of(F.col("first_cpos"), 1 << 20)})
    return numbered(types, ["rank", "block"], ["first_cpos"], "id").select("id", "str", "freq", "first_cpos")


def checked(spark: SparkSession, pattern: str) -> str:
    """`pattern` if it is a valid Java regular expression; else a PySparkValueError, before any job runs."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as error:
        raise PySparkValueError(f"invalid regular expression {pattern!r}") from error
    return pattern


def full_match(spark: SparkSession, value, pattern: str, ignore_case: bool = False):
    """Whether the whole of `value` matches. Literal heads and tails become predicates that reach the scan."""
    checked(spark, pattern)
    if not ignore_case:
        if _LITERAL.fullmatch(pattern):
            return value == pattern
        for head, tail, make in ((".*", "", value.endswith), ("", ".*", value.startswith), (".*", ".*", value.contains)):
            inner = pattern[len(head) : len(pattern) - len(tail)]
            if len(pattern) >= len(head) + len(tail) and pattern == head + inner + tail and inner and _LITERAL.fullmatch(inner):
                return make(inner)
    return value.rlike(f"^(?{'iu' if ignore_case else ''}:{pattern})$")


def exact(lex: DataFrame, s: str) -> DataFrame:
    return lex.where(F.col("str") == s)


def prefix(lex: DataFrame, s: str) -> DataFrame:
    return lex.where(F.col("str").startswith(s))


def suffix(lex: DataFrame, s: str) -> DataFrame:
    return lex.where(F.col("str").endswith(s))


def contains(lex: DataFrame, s: str) -> DataFrame:
    return lex.where(F.col("str").contains(s))


def regex_search(lex: DataFrame, pattern: str) -> DataFrame:
    """Types that the expression matches anywhere."""
    return lex.where(F.col("str").rlike(checked(lex.sparkSession, pattern)))


def regex_full(lex: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Types that it matches as a whole."""
    return lex.where(full_match(lex.sparkSession, F.col("str"), pattern, ignore_case))


def first(lex: DataFrame) -> DataFrame:
    """The row of least id: an aggregate, so that no sort is needed."""
    return lex.agg(F.min_by(F.struct(*lex.columns), "id").alias("r")).where("r is not null").select("r.*")


def get(lex: DataFrame, type_id: int) -> DataFrame:
    return lex.where(F.col("id") == type_id)


def get_all(lex: DataFrame, ids: list[int]) -> DataFrame:
    """(rank, id, str): one row per listed id, in the list's order; unknown ids give none."""
    wanted = lex.sparkSession.createDataFrame(list(enumerate(ids)), "rank long, id long")
    return F.broadcast(wanted).join(lex.where(F.col("id").isin(*set(ids)) if ids else F.lit(False)), "id").select("rank", "id", "str")


def matching(lex: DataFrame, pattern) -> DataFrame:
    """Types that any predicate holds for: a function of the string's Column, or a string or character to be contained."""
    return lex.where(pattern(F.col("str")) if callable(pattern) else F.col("str").contains(pattern))


class Regex:
    """A checked expression that matches as a whole; `optimised` tells whether it became a plain string predicate."""

    def __init__(self, spark: SparkSession, pattern: str, ignore_case: bool = False) -> None:
        self.spark, self.pattern, self.ignore_case = spark, checked(spark, pattern), ignore_case
        literal = pattern.removeprefix(".*").removesuffix(".*")
        self.optimised = not ignore_case and _LITERAL.fullmatch(literal) is not None and (bool(literal) or literal == pattern)

    def is_match(self, value):
        return full_match(self.spark, value, self.pattern, self.ignore_case)


def sort_ranks(lex: DataFrame) -> DataFrame:
    """(id, str, sort): each type's place in byte order.

    Blocks are the strings' first two bytes: a block that holds very many types is the limit here.
    """
    from lexaxis.operators.numbering import numbered

    keyed = lex.select("id", "str", F.hex(F.substring(F.encode("str", "utf-8"), 1, 2)).alias("head"))
    return numbered(keyed, ["head"], ["str"], "sort").select("id", "str", "sort")
