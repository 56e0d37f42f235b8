"""The documents written once in the order of the axis, and the tables that are cut from them there.

Documents are shuffled and sorted whole, never word by word. A task counts along
what it writes, so with the totals of the earlier blocks, a row each, every
document's first position and line is known; tokens and lines then leave the scan
in their order. Of words only the different ones of a chunk of texts are shuffled:
with their number for the lexicon, with their positions, packed, for postings and ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lexaxis.operators import positions
from lexaxis.operators.numbering import Blocks, in_order
from lexaxis.sources.shared import row_numbers

#: Bytes of text that are cut at once, and bytes of the texts whose words are counted or packed together.
SLICE_BYTES = 2 << 20
CHUNK_BYTES = 32 << 20


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, words of each line, lines of each text): lines end at line feeds, words at ASCII white space; a null text is empty."""
    lines = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
    words = pc.ascii_split_whitespace(lines.flatten())
    each = words.flatten()
    some = pc.not_equal(each, "")
    upto = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    ends = np.r_[0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]
    return each.filter(some), np.diff(upto[ends]), lines.value_lengths().to_numpy(zero_copy_only=False)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy(zero_copy_only=False)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each of the runs of `values` that are so long."""
    upto = np.r_[0, np.cumsum(values)]
    ends = np.r_[0, np.cumsum(lengths)]
    return np.diff(upto[ends])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of at most SLICE_BYTES of text; a longer text is one by itself."""
    size = np.cumsum(pc.binary_length(_column(batch, "text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _counted(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    """The rows that have a token; their tokens and the lines that have one."""
    tokens, lines = [], []
    for part in _slices(batch):
        _, words, per_text = cut(_column(part, "text"))
        tokens.append(_sums(words, per_text))
        lines.append(_sums(words > 0, per_text))
    tokens, lines = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (tokens, lines))
    some = tokens > 0
    return batch.filter(pa.array(some)), {"tokens": tokens[some], "lines": lines[some]}


def write(docs: DataFrame, path: str, annotations: list[str]) -> Blocks:
    """Writes the documents that have a token in the order of doc_id, nulls last, and of the files; their tokens and lines are counted."""
    rows = row_numbers(docs.select("doc_id", *annotations, "text"))
    return in_order(rows, [F.col("doc_id").asc_nulls_last(), F.col("row")], path, {"tokens", "lines"}, _counted)


def spans(texts: Blocks, annotations: list[str]) -> DataFrame:
    """(seg_id, start, end, doc_id, annotations, row) of every document."""
    placed = texts.placed({"seg_id": "rows", "start": "tokens"})
    return placed.select("seg_id", "start", (F.col("start") + F.col("tokens")).alias("end"), "doc_id", *annotations, "row")


def _id_type(texts: Blocks) -> str:
    return texts.df.schema["doc_id"].dataType.simpleString()


def _mapped(texts: Blocks, counter: str, run: Callable, schema: str | StructType) -> DataFrame:
    """`run` over batches of (first, doc_id, text, start): `first` is the sum of `counter`, `start` of tokens, before the text."""
    placed = texts.placed({"first": counter, "start": "tokens"}).select("first", "doc_id", "text", "start")
    return placed.mapInArrow(run, schema)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs that are so long."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            words, per_line, per_text = cut(_column(part, "text"))
            per = _sums(per_line, per_text)
            of, place = np.repeat(np.arange(len(per)), per), _within(per)
            line = np.repeat(_within(per_text), per_line)
            arrays = [pa.array(_numbers(part, "start")[of] + place), words.cast(pa.string()), _column(part, "doc_id").take(pa.array(of)), pa.array(line.astype(np.int32)), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["cpos", "word", "doc_id", "line_no", "pos_in_doc"])


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            words, per_line, per_text = cut(_column(part, "text"))
            per = _sums(per_line, per_text)
            yield positions.pieces(np.repeat(_numbers(part, "start"), per) + _within(per), {"word": words})


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            _, per_line, per_text = cut(_column(part, "text"))
            some, text = per_line > 0, np.repeat(np.arange(len(per_text)), per_text)
            before = np.cumsum(per_line) - per_line  # words of the slice before the line
            first = np.searchsorted(text, np.arange(len(per_text)))
            of = text[some]
            start = _numbers(part, "start")[of] + before[some] - before[first[of]]
            number = _numbers(part, "first")[of] + _within(np.bincount(of, minlength=len(per_text)))
            arrays = [pa.array(number), pa.array(start), pa.array(start + per_line[some]), _column(part, "doc_id").take(pa.array(of)), pa.array(_within(per_text)[some].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["seg_id", "start", "end", "doc_id", "line_no"])


def tokens(texts: Blocks) -> DataFrame:
    """(cpos, word, doc_id, line_no, pos_in_doc) of every token, ascending in each block."""
    return _mapped(texts, "lines", _token_rows, f"cpos long, word string, doc_id {_id_type(texts)}, line_no int, pos_in_doc int")


def pieces(texts: Blocks) -> DataFrame:
    """The words as positions.packed() has them, a row for some hundred of them."""
    return _mapped(texts, "rows", _piece_rows, positions.pieces_schema([StructField("word", StringType())]))


def lines(texts: Blocks) -> DataFrame:
    """(seg_id, start, end, doc_id, line_no) of every line that has a token, ascending in each block."""
    return _mapped(texts, "lines", _line_rows, f"seg_id long, start long, end long, doc_id {_id_type(texts)}, line_no int")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first position, different words, index of each token's word) of chunks of texts whose positions follow each other."""
    base, ahead, size, held = 0, -1, 0, []

    def made():
        coded = pa.concat_arrays(held).dictionary_encode()
        held.clear()
        return base, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)

    for batch in batches:
        for part in _slices(batch):
            words, per_line, per_text = cut(_column(part, "text"))
            per, start = _sums(per_line, per_text), _numbers(part, "start")
            apart = np.flatnonzero(start[1:] != start[:-1] + per[:-1]) + 1
            at = np.r_[0, np.cumsum(per)]
            for s, e in zip(np.r_[0, apart].tolist(), np.r_[apart, len(per)].tolist(), strict=True):
                if held and (int(start[s]) != ahead or size > CHUNK_BYTES):
                    yield made()
                if not held:
                    base, size = int(start[s]), 0
                held.append(words.slice(at[s], at[e] - at[s]))
                ahead, size = int(start[e - 1] + per[e - 1]), size + held[-1].nbytes
    if held:
        yield made()


def _some(columns: dict[str, pa.Array], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    for at in range(0, whole.num_rows, rows):
        yield whole.slice(at, rows)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for base, words, index in _chunks(batches):
        freq = np.bincount(index, minlength=len(words))
        # words are in the order of their first tokens: a token is the first if its index is above all earlier ones
        high = np.maximum.accumulate(index)
        first = np.flatnonzero(np.r_[True, high[1:] > high[:-1]])
        yield from _some({"word": words.cast(pa.string()), "freq": pa.array(freq), "first_cpos": pa.array(base + first)})


def words(texts: Blocks) -> DataFrame:
    """(word, freq, first_cpos) of the different words of each chunk."""
    return _mapped(texts, "rows", _word_rows, "word string, freq long, first_cpos long")


def lexicon(texts: Blocks, path: str) -> DataFrame:
    """(id, str, freq, first_cpos) of every type, numbered by falling frequency, then first position; `path` gets what is between."""
    types = words(texts).groupBy(F.col("word").alias("str")).agg(F.sum("freq").alias("freq"), F.min("first_cpos").alias("first_cpos"))
    return in_order(types, [F.col("freq").desc(), F.col("first_cpos")], path).placed({"id": "rows"}).select("id", "str", "freq", "first_cpos")


def packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary value for each run of `values`, which are from 0 to 2**35: seven bits a byte, the lowest first, the last with the eighth bit."""
    values = values.astype(np.int64)
    size = 1 + sum((values >> (7 * i) > 0).astype(np.int64) for i in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    for i in range(5):
        some = size > i
        out[(ends - size)[some] + i] = (values[some] >> (7 * i)) & 127
    out[ends - 1] |= 128
    bounds = np.r_[0, ends][np.r_[0, np.cumsum(lengths)]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


def unpacked(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, how many each binary value has): what packed() was given."""
    raw = raw.cast(pa.large_binary())
    bounds = np.r_[0, np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False))]
    _, offsets, data = raw.buffers()
    begin = int(np.frombuffer(offsets, np.int64)[raw.offset]) if len(raw) else 0
    octets = np.frombuffer(data, np.uint8)[begin : begin + int(bounds[-1])] if data is not None else np.zeros(0, np.uint8)
    last = np.flatnonzero(octets & 128)
    size = np.diff(np.r_[-1, last])
    values = np.zeros(len(last), np.int64)
    for i in range(5):
        some = size > i
        values[some] |= (octets[last[some] - size[some] + 1 + i].astype(np.int64) & 127) << (7 * i)
    return values, np.diff(np.searchsorted(last, bounds))


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for base, words, index in _chunks(batches):
        at = np.argsort(index, kind="stable")
        freq = np.bincount(index, minlength=len(words))
        gaps = np.diff(at, prepend=0)
        begins = np.cumsum(freq) - freq
        gaps[begins] = at[begins]
        yield from _some({"word": words.cast(pa.string()), "base": pa.array(np.full(len(words), base)), "places": packed(gaps, freq)})


def places(texts: Blocks, lex: DataFrame) -> DataFrame:
    """(word_id, base, places) of the different words of each chunk: its first position, and the word's positions after that, as packed differences."""
    found = _mapped(texts, "rows", _place_rows, "word string, base long, places binary")
    return found.join(lex.select(F.col("str").alias("word"), F.col("id").alias("word_id")), "word").select("word_id", "base", "places")


def _positions(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word_id, cpos) of packed rows."""
    gaps, size = unpacked(_column(part, "places"))
    begins = np.cumsum(size) - size
    upto = np.cumsum(gaps)
    place = upto - np.repeat(upto[begins] - gaps[begins], size)
    return np.repeat(_numbers(part, "word_id"), size), np.repeat(_numbers(part, "base"), size) + place


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of at most SLICE_BYTES of packed positions, or single rows."""
    size = np.cumsum(pc.binary_length(_column(batch, "places")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES // 8, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _bounded(batch):
            ids, cpos = _positions(part)
            yield from _some({"word_id": pa.array(ids), "cpos": pa.array(cpos)}, 1 << 18)


def postings(texts: Blocks, lex: DataFrame) -> DataFrame:
    """(word_id, cpos) of every token in that order, in partitions that ascend."""
    return places(texts, lex).repartitionByRange("word_id", "base").sortWithinPartitions("word_id", "base").mapInArrow(_posting_rows, "word_id long, cpos long")


def _id_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, base = [], None

    def made():
        ids, cpos = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        stream = np.empty(len(ids), np.int64)
        stream[cpos - base] = ids  # a chunk has every position from its first
        yield from _some({"cpos": pa.array(base + np.arange(len(ids))), "word_id": pa.array(stream)}, 1 << 18)

    for batch in batches:
        bases = _numbers(batch, "base")
        cuts = np.flatnonzero(np.diff(bases)) + 1
        for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(bases)].tolist(), strict=True):
            if s == e:
                continue
            if held and bases[s] != base:
                yield from made()
            base = bases[s]
            held.append(_positions(batch.slice(s, e - s)))
    if held:
        yield from made()


def ids(texts: Blocks, lex: DataFrame, files: int) -> DataFrame:
    """(cpos, word_id) of every token in the order of positions, in `files` partitions that ascend."""
    step = -(-max(texts.total("tokens"), 1) // files)
    placed = places(texts, lex).repartitionById(files, F.expr(f"cast(base div {step} as int)"))
    return placed.sortWithinPartitions("base").mapInArrow(_id_rows, "cpos long, word_id long")
