"""Inverted-index operators over postings (word_id, cpos), stored in that order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaxis.operators.numbering import block_of, running_totals


def of_type(postings: DataFrame, type_id: int) -> DataFrame:
    """The positions of one type; the filter reaches the scan of the sorted table."""
    return postings.where(F.col("word_id") == type_id).select("cpos")


def combined(postings: DataFrame, ids: list[int]) -> DataFrame:
    """(word_id, cpos) of the types listed, each once however often it is listed."""
    return postings.where(F.col("word_id").isin(*set(ids)) if ids else F.lit(False))


def combined_multi(postings: DataFrame, ids: list[int]) -> DataFrame:
    """Like combined(), but an id that is listed twice gives its positions twice."""
    wanted = postings.sparkSession.createDataFrame([(i,) for i in ids], "word_id long")
    return combined(postings, ids).join(F.broadcast(wanted), "word_id").select("word_id", "cpos")  # a list given by the caller


def of_types(postings: DataFrame, types: DataFrame) -> DataFrame:
    """(word_id, cpos) of the types in `types` (id): a semi join, whose side Spark chooses by size."""
    return postings.join(types.select(F.col("id").alias("word_id")), "word_id", "left_semi")


def ranked(postings: DataFrame) -> DataFrame:
    """(word_id, cpos, nth): the rank of each position within its type.

    A frequent type's postings are cut by position, so that no task ranks all of them.
    """
    cut = postings.select("word_id", "cpos", block_of(F.col("cpos"), 1 << 20).alias("block"))
    sums = cut.groupBy("word_id", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("word_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("word_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inner = Window.partitionBy("word_id", "block").orderBy("cpos")
    return cut.join(offsets, ["word_id", "block"]).select("word_id", "cpos", (F.col("before") + F.row_number().over(inner) - 1).alias("nth"))


def sliced(postings: DataFrame, type_id: int, start: int, end: int | None = None) -> DataFrame:
    """(nth, cpos) of one type's positions of rank [start, end)."""
    one = postings.where(F.col("word_id") == type_id).withColumn("block", block_of(F.col("cpos"), 1 << 20))
    rows = running_totals(one, ["block"], ["cpos"], {"nth": F.lit(1).cast("long")})
    return rows.where((F.col("nth") >= start) & (F.lit(True) if end is None else F.col("nth") < end)).select("nth", "cpos")


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("word_id").agg(F.count("*").alias("freq"))


#: Positions of one block of the inverted index.
INDEX_BLOCK = 1 << 20


def inverted_index(postings: DataFrame) -> DataFrame:
    """(word_id, block, n, cpos_list): ascending positions by type and block of positions, so that no row grows with the corpus."""
    cut = postings.select("word_id", block_of(F.col("cpos"), INDEX_BLOCK).alias("block"), "cpos")
    return cut.groupBy("word_id", "block").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("cpos")).alias("cpos_list"))
