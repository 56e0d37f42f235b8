"""Tables that are cut from the documents in their order: whole, right, and with no shuffle of single words."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexaxis.operators import lexicon, positions
from lexaxis.sources import axis, texts
from lexaxis.sources.corpus import Encoding

ROWS = [(i * 37 % 50, " \t".join(f"w{(i * j) % 11}\n" * (j % 3) + f"x{i % 4}" for j in range(i % 9))) for i in range(60)]
ROWS += [(None, "e f\n\n g"), (3, None), (3, " \n\t "), (-5, "ä b\u0085c\x1cd \x0be\x0cf\rg"), (None, "h"), (7_000_000_000_000, "i " * 3000), (3, "i")]


@pytest.fixture
def made(spark, tmp_path):
    """An encoding of many blocks."""
    spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield Encoding(spark, str(tmp_path), str(tmp_path / "corpus"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_same_tables_as_word_by_word(spark, made):
    docs = spark.read.parquet(f"{made._sf_dir}/documents.parquet")
    spans = axis.document_spans(docs)
    tokens = axis.tokens(docs, spans)
    lex = lexicon.build(tokens)
    ids = axis.with_ids(tokens, lex)
    rows = lambda df, *by: list(map(tuple, df.orderBy(*by).collect()))
    assert len(made.texts().offsets) > 1
    assert rows(made.table("tokens"), "cpos") == rows(tokens, "cpos")
    assert rows(made.table("seg_doc").drop("row"), "seg_id") == rows(spans.drop("row"), "seg_id")
    assert rows(made.table("seg_line"), "seg_id") == rows(axis.line_spans(tokens), "seg_id")
    assert rows(made.table("lexicon"), "id") == rows(lex, "id")
    assert rows(made.table("ids"), "cpos") == rows(ids.select("cpos", "word_id"), "cpos")
    assert rows(made.table("postings"), "word_id", "cpos") == rows(ids.select("word_id", "cpos"), "word_id", "cpos")
    assert made.size("tokens") == tokens.count() and made.size("seg_line") == made.table("seg_line").count() and made.size("seg_doc") == spans.count()


def test_a_table_is_made_with_no_others_than_it_needs(made):
    made.table("seg_line")
    assert sorted(os.listdir(made.folder)) == ["seg_line", "texts"]
    made.table("lexicon")
    assert sorted(os.listdir(made.folder)) == ["lexicon", "seg_line", "texts", "types"]


def test_no_word_is_shuffled_by_itself(made):
    t = made.texts()
    for df in (texts.tokens(t), texts.lines(t)):
        assert set(re.findall(r"(\w*Exchange)", df._jdf.queryExecution().executedPlan().toString())) == {"BroadcastExchange"}
    assert texts.words(t).count() < made.size("tokens") / 5
    found = texts.places(t, made.table("lexicon"))
    assert found.count() == texts.words(t).count()
    assert found.agg(F.sum(F.octet_length("places"))).first()[0] < 2 * made.size("tokens")


def test_files_ascend_so_that_lookups_are_pruned(spark, made):
    for name, *by in (("tokens", "cpos"), ("ids", "cpos"), ("postings", "word_id", "cpos"), ("lexicon", "id"), ("seg_line", "seg_id")):
        rows = made.table(name).select(F.input_file_name().alias("file"), *by).collect()
        for file in {r.file for r in rows}:
            keys = [tuple(r)[1:] for r in rows if r.file == file]
            assert sum(a > b for a, b in zip(keys, keys[1:], strict=False)) <= len(made.texts().offsets)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = Encoding(spark, str(tmp_path), str(tmp_path / "corpus"))
    assert [made.table(t).count() for t in ("tokens", "seg_doc", "seg_line", "lexicon", "ids", "postings")] == [0] * 6
    assert made.size("tokens") == 0


def test_packed_values_come_back():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, 2**35 - 1, 5], np.int64)
    lengths = np.array([1, 3, 0, 6, 1])
    raw = texts.packed(values, lengths)
    for start, stop in ((0, 5), (1, 4), (2, 3), (3, 5)):
        found, sizes = texts.unpacked(raw.slice(start, stop - start))
        first = lengths[:start].sum()
        assert found.tolist() == values[first : first + lengths[start:stop].sum()].tolist() and sizes.tolist() == lengths[start:stop].tolist()


@pytest.mark.parametrize("chunk", [1, 200, 1 << 20])
def test_chunks_hold_positions_that_follow_each_other(monkeypatch, chunk):
    monkeypatch.setattr(texts, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(texts, "SLICE_BYTES", 9)
    lines = ["a b a", "c\nb", "b b", "d a", "e"]
    starts = [0, 3, 5, 100, 102]
    batches = [pa.RecordBatch.from_arrays([pa.array(lines[s:e]), pa.array(starts[s:e])], ["text", "start"]) for s, e in ((0, 2), (2, 4), (4, 5))]
    found = {base + i: words[x].as_py() for base, words, index in texts._chunks(iter(batches)) for i, x in enumerate(index.tolist())}
    assert found == {s + i: w for s, line in zip(starts, lines, strict=True) for i, w in enumerate(line.split())}
    counts = {}
    for rows in texts._word_rows(iter(batches)):
        for r in rows.to_pylist():
            freq, first = counts.get(r["word"], (0, 1 << 40))
            counts[r["word"]] = (freq + r["freq"], min(first, r["first_cpos"]))
    assert counts == {"a": (3, 0), "b": (4, 1), "c": (1, 3), "d": (1, 100), "e": (1, 102)}


def test_words_are_gathered_from_the_texts(spark, made):
    tokens = made.table("tokens")
    asked = tokens.select("cpos", (F.col("cpos") * 3).alias("i")).where("cpos % 2 = 0")
    spans = tokens.select(F.col("cpos").alias("window_id"), F.col("cpos").alias("start"), (F.col("cpos") + 3).alias("end")).where("cpos % 5 = 0")
    for words in (made.words(), positions.packed(tokens.select("cpos", "word"))):
        assert sorted(map(tuple, positions.gather_packed(words, asked).collect())) == sorted(map(tuple, asked.join(tokens, "cpos").select("cpos", "i", "word").collect()))
        found = positions.windows_packed(words, spans).join(tokens.select("cpos", F.col("word").alias("want")), "cpos").collect()
        assert all(r.word == r.want for r in found) and len(found) == spans.count() * 3 - max(0, (spans.agg(F.max("start")).first()[0] + 3) - made.size("tokens"))
    assert made.words().count() < made.size("tokens") / 10
