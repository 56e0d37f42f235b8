"""Token frequencies of a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexaxis.sources.axis import words_of


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, freq) over a streaming or static table with `text`: the lexicon's frequencies as documents arrive."""
    return docs.select(F.explode(words_of(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
