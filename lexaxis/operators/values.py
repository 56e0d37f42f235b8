"""Integer, plain, set and pointer variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_with(df: DataFrame, name: str, value) -> DataFrame:
    """The positions whose value is `value`: all of them, however often it occurs."""
    return df.where(F.col(name) == value).select("cpos")


def first_with(df: DataFrame, name: str, value) -> DataFrame:
    """The least position with that value; no row if there is none."""
    return rows_with(df, name, value).agg(F.min("cpos").alias("cpos")).where("cpos is not null")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(name).agg(F.count("*").alias("n"))


def set_lexicon(sets: DataFrame, name: str, key: str = "seg_id") -> DataFrame:
    """(id, str, freq, first_cpos) of a set variable's members by falling frequency, then first row."""
    from lexaxis.operators import lexicon

    return _by_string(lexicon, sets.select(F.col(key).alias("cpos"), F.explode(name).alias("word")))


def _by_string(lexicon, members: DataFrame) -> DataFrame:
    # several members can first occur in one row: the string breaks that tie
    from lexaxis.operators.numbering import block_of, numbered

    types = members.groupBy(F.col("word").alias("str")).agg(F.count("*").alias("freq"), F.min("cpos").alias("first_cpos"))
    types = types.withColumns({"rank": -F.col("freq"), "block": block_of(F.col("first_cpos"), 1 << 20)})
    return numbered(types, ["rank", "block"], ["first_cpos", "str"], "id").select("id", "str", "freq", "first_cpos")


def set_members(sets: DataFrame, name: str, member: str) -> DataFrame:
    return sets.where(F.array_contains(name, member))


def heads(pointers: DataFrame, tail: int) -> DataFrame:
    return pointers.where(F.col("cpos") == tail).select("cpos", "head")


def tails(pointers: DataFrame, head: int) -> DataFrame:
    return pointers.where(F.col("head") == head).select("cpos")


def out_of_range(pointers: DataFrame, n: int) -> DataFrame:
    """Rows whose head is not a position of the layer; a null head points nowhere and is allowed."""
    return pointers.where((F.col("head") < 0) | (F.col("head") >= n))


def chase(pointers: DataFrame, limit: int = 64) -> DataFrame:
    """(cpos, root): where the chain of heads from each position ends.

    A chain ends at a position that has no head or points to itself. Each round
    doubles the distance looked ahead and is written to the shared folder; what
    is longer than 2**limit, a cycle among them, has a null root.
    """
    from lexaxis.sources.shared import settled

    step = F.when(F.col("head") != F.col("cpos"), F.col("head"))
    state = settled(pointers.select("cpos", F.coalesce(step, F.col("cpos")).alias("at"), step.isNull().alias("done")))
    for _ in range(limit):
        if state.where("not done").isEmpty():
            break
        ahead = state.select(F.col("cpos").alias("at"), F.col("at").alias("next"), F.col("done").alias("ends"))
        moved = state.join(ahead, "at", "left")
        grown = settled(moved.select("cpos", F.when(F.col("done") | F.col("next").isNull(), F.col("at")).otherwise(F.col("next")).alias("at"), (F.col("done") | F.coalesce("ends", F.lit(True))).alias("done")))
        if grown.where("not done").count() == state.where("not done").count():
            state = grown  # only cycles are left
            break
        state = grown
    return state.select("cpos", F.when(F.col("done"), F.col("at")).alias("root"))
