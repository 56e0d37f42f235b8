"""From documents to a token axis: dense positions, lexicon, segment layers, postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexaxis.operators import lexicon
from lexaxis.operators.numbering import block_of, in_blocks, numbered, running_totals
from lexaxis.sources.shared import row_numbers, settled


def words_of(text: Column) -> Column:
    """The maximal runs of other characters than white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def document_spans(docs: DataFrame) -> DataFrame:
    """(seg_id, start, end, doc_id, lang, source, n_chars, row) of every document that has a token.

    The axis is in the order of doc_id, nulls last, and of rows of one doc_id in
    that of the files. `row` tells documents apart, whatever their doc_id.
    """
    annotations = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    sizes = row_numbers(docs).select("doc_id", *annotations, "row", F.size(words_of(F.col("text"))).cast("long").alias("n")).where("n > 0")
    placed = _running(sizes, ["doc_id"], {"seg_id": F.lit(1).cast("long"), "start": F.col("n")})
    return placed.select("seg_id", "start", (F.col("start") + F.col("n")).alias("end"), "doc_id", *annotations, "row")


def _running(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Running totals of `df`, which has `row`, in the order of `keys`, nulls last, and row."""
    order = [*(F.col(k).asc_nulls_last() for k in keys), F.col("row")]
    return running_totals(in_blocks(df, order), ["block"], order, totals).drop("block")


def tokens(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(cpos, word, doc_id, line_no, pos_in_doc) of every token; lines are cut at line feeds and numbered from 0."""
    def in_line(line, number):
        return F.transform(words_of(line), lambda w: F.struct(number.alias("line_no"), w.alias("word")))

    each = F.flatten(F.transform(F.split("text", "\n", -1), in_line))
    cut = row_numbers(docs).select("row", "doc_id", "text").join(spans.select("row", "start"), "row").select("doc_id", "start", F.posexplode(each).alias("pos_in_doc", "t"))
    return cut.select((F.col("start") + F.col("pos_in_doc")).alias("cpos"), F.col("t.word").alias("word"), "doc_id", F.col("t.line_no").alias("line_no"), "pos_in_doc")


def type_table(tokens: DataFrame) -> DataFrame:
    return lexicon.build(tokens)


def with_ids(tokens: DataFrame, lex: DataFrame) -> DataFrame:
    """The tokens with word_id. Frequent words make a skewed key, which adaptive execution splits."""
    return tokens.join(lex.select(F.col("str").alias("word"), F.col("id").alias("word_id")), "word")


def line_spans(tokens: DataFrame) -> DataFrame:
    """(seg_id, start, end, doc_id, line_no) of every line that has a token."""
    lines = tokens.groupBy((F.col("cpos") - F.col("pos_in_doc")).alias("document"), "line_no").agg(F.min("cpos").alias("start"), (F.max("cpos") + 1).alias("end"), F.first("doc_id").alias("doc_id"))
    lines = settled(lines.drop("document")).withColumn("block", block_of(F.col("start")))
    return numbered(lines, ["block"], ["start"], "seg_id").select("seg_id", "start", "end", "doc_id", "line_no")


def row_axis(df: DataFrame, *keys: str) -> DataFrame:
    """`df` with `cpos`: all rows, numbered in the order of `keys`, nulls last, and of equal ones in that of the files."""
    return _running(row_numbers(df), list(keys), {"cpos": F.lit(1).cast("long")}).drop("row")


def document_tags(spans: DataFrame, labels: DataFrame) -> DataFrame:
    """(seg_id, tags): the set of language, source and label flags of each document; of a document labelled twice, the flags of both."""
    from lexaxis.functions.parsing import set_parse

    flag = lambda letter, c: F.array_join(F.array_sort(F.collect_set(F.concat(F.lit(letter), c))), "|").alias(letter)
    flags = labels.groupBy("doc_id").agg(flag("q", "quality"), flag("t", "toxic"))
    return spans.join(flags, "doc_id", "left").select("seg_id", set_parse(F.concat_ws("|", "lang", "source", "q", "t")).alias("tags"))


def turn_pointers(conversations: DataFrame) -> DataFrame:
    """(cpos, conv_id, turn, head): each turn points at the previous one of its conversation, the first, and one of no conversation, at itself."""
    rows = row_axis(conversations.select("conv_id", "turn"), "conv_id", "turn")
    alone = F.when(F.col("conv_id").isNull(), F.col("cpos"))
    before = F.lag("cpos").over(Window.partitionBy("conv_id", alone).orderBy("cpos"))
    return rows.withColumn("head", F.coalesce(before, F.col("cpos"))).select("cpos", "conv_id", "turn", "head")
