"""Composed queries over tokens, lexicon, postings and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaxis.operators import segments


def kwic(tokens: DataFrame, hits: DataFrame, width: int = 5, within: DataFrame | None = None) -> DataFrame:
    """(cpos, left, hit, right) of every hit (cpos): up to `width` words on each side.

    The context ends with the corpus, or with the hit's segment of `within`. A
    hit that is listed twice gives its line twice. Hits are exploded to positions
    and joined by equality; no window passes over the tokens.
    """
    often = hits.groupBy("cpos").agg(F.count("*").alias("times"))
    hits = often.select("cpos")
    rows = hits.select("cpos", F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("offset"))
    rows = rows.select("cpos", "offset", (F.col("cpos") + F.col("offset")).alias("at"))
    if within is not None:
        limits = segments.find_containing(hits.select("cpos"), within.select("start", "end")).select("cpos", "start", "end")
        rows = rows.join(limits, "cpos").where("at >= start and at < end").select("cpos", "offset", "at")
    found = rows.join(tokens.select(F.col("cpos").alias("at"), "word"), "at")
    side = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("offset", "word")))), lambda x: x.word), " ")
    lines = found.groupBy("cpos").agg(side(F.col("offset") < 0).alias("left"), F.max(F.when(F.col("offset") == 0, F.col("word"))).alias("hit"), side(F.col("offset") > 0).alias("right"))
    return _repeated(lines, often)


def _repeated(lines: DataFrame, often: DataFrame) -> DataFrame:
    """Each line as many times as its hit is listed."""
    return lines.join(often, "cpos").withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "time")


def followers(tokens: DataFrame, word: str, prefix: str) -> DataFrame:
    """(cpos, word): tokens that begin with `prefix` right after `word`; the word's positions shift by one and join."""
    after = tokens.where(F.col("word") == word).select((F.col("cpos") + 1).alias("cpos"))
    return tokens.where(F.col("word").startswith(prefix)).select("cpos", "word").join(after, "cpos", "left_semi")


def surface(tokens: DataFrame, hits: DataFrame, layer: DataFrame, *annotations: str) -> DataFrame:
    """(hit, seg_id, *annotations, text): the hit's segment as text, the hit between brackets; a hit listed twice gives two rows."""
    often = hits.groupBy("cpos").agg(F.count("*").alias("times"))
    placed = segments.find_containing(often.select("cpos"), layer.select("seg_id", "start", "end", *annotations)).withColumnRenamed("cpos", "hit")
    inside = placed.select("hit", "seg_id", *annotations, F.explode(F.sequence("start", F.col("end") - 1)).alias("cpos"))
    words = inside.join(tokens.select("cpos", "word"), "cpos")
    shown = F.when(F.col("cpos") == F.col("hit"), F.concat(F.lit("["), "word", F.lit("]"))).otherwise(F.col("word"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cpos", shown.alias("w")))), lambda x: x.w), " ")
    lines = words.groupBy("hit", "seg_id", *annotations).agg(text.alias("text"))
    return _repeated(lines.withColumnRenamed("hit", "cpos"), often).withColumnRenamed("cpos", "hit")


def text_of(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """`spans` (seg_id, start, end, ...) with `n_tokens` and their words as `text`."""
    words = segments.find_containing(tokens.select("cpos", "word"), spans.select("seg_id", "start", "end"))
    whole = words.groupBy("seg_id").agg(F.count("*").alias("n_tokens"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cpos", "word"))), lambda x: x.word), " ").alias("text"))
    return spans.join(whole, "seg_id")
