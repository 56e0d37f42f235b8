"""Access by position to any position-aligned table with a `cpos` column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Positions of one bin; a join by bin moves a bin's rows as arrays, and the bytes of its strings are copied for each row asked for.
BIN = 128


def at(df: DataFrame, cpos: int) -> DataFrame:
    """The row at a position, or none; the filter prunes row groups of the sorted table."""
    return df.where(F.col("cpos") == cpos)


def between(df: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """The rows of [start, end); an empty range is an empty result at any start."""
    rows = df.where(F.col("cpos") >= start)
    return rows if end is None else rows.where(F.col("cpos") < end)


def pieces(cpos: np.ndarray, columns: dict[str, pa.Array], width: int = BIN) -> pa.RecordBatch:
    """A row for each run of positions that follow each other, cut at bins: see packed()."""
    bins = cpos // width
    begins = np.flatnonzero(np.r_[True, (np.diff(cpos) != 1) | (np.diff(bins) != 0)][: len(cpos)])
    bounds = np.r_[begins, len(cpos)]
    size = np.diff(bounds)
    made = {"_bin": pa.array(bins[begins]), "_first": pa.array(cpos[begins]), "_size": pa.array(size)}
    lists = lambda values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
    for name, column in columns.items():
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            texts = column.cast(pa.large_string())
            ends = np.r_[0, np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
            start = ends[:-1] - np.repeat(ends[begins], size)
            if texts.null_count:
                start = np.where(texts.is_null().to_numpy(zero_copy_only=False), -1 - start, start)
                texts = texts.fill_null("")
            _, offsets, data = texts.buffers()
            from_ = int(np.frombuffer(offsets, np.int64)[texts.offset]) if len(texts) else 0
            octets = (data or pa.py_buffer(b"")).slice(from_) if from_ else data or pa.py_buffer(b"")
            whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(ends[bounds].astype(np.int64)), octets])
            made[name] = pa.StructArray.from_arrays([lists(pa.array(start.astype(np.int32))), whole.cast(pa.binary())], ["starts", "octets"])
        else:
            made[name] = lists(column)
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def pieces_schema(columns: list[StructField]) -> StructType:
    kind = lambda t: StructType.fromDDL("starts array<int>, octets binary") if isinstance(t, StringType) else ArrayType(t)
    return StructType([StructField(c, LongType()) for c in ("_bin", "_first", "_size")] + [StructField(f.name, kind(f.dataType)) for f in columns])


def packed(df: DataFrame, width: int = BIN) -> DataFrame:
    """(_bin, _first, _size, each column): the runs of rows whose positions follow each other, cut at bins of `width`.

    A column becomes an array, or of strings their bytes and where each starts
    (-1 - start: null). A table that ascends has a few rows a bin; one in any
    other order has more, and stays whole.
    """
    others = [f for f in df.schema.fields if f.name != "cpos"]
    names = [f.name for f in others]

    def run(batches):
        for batch in batches:
            yield pieces(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), dict(zip(names, batch.columns[1:], strict=True)), width)

    return df.where("cpos is not null").select("cpos", *names).mapInArrow(run, pieces_schema(others))


def _value(df: DataFrame, name: str, cpos: Column) -> Column:
    """A packed column's value at a position of the piece."""
    place = (cpos - F.col("_first")).cast("int")
    if isinstance(df.schema[name].dataType, ArrayType):
        return F.get(name, place).alias(name)
    start, after = (F.get(F.col(name)["starts"], p) for p in (place, place + 1))
    end = F.coalesce(F.when(after < 0, -1 - after).otherwise(after), F.octet_length(F.col(name)["octets"]))
    return F.when(start >= 0, F.substring(F.col(name)["octets"], start + 1, end - start).cast("string")).alias(name)


def _columns(packed: DataFrame) -> list[str]:
    return [c for c in packed.columns if c not in ("_bin", "_first", "_size")]


def gather_packed(table: DataFrame, wanted: DataFrame, width: int = BIN) -> DataFrame:
    """gather() of a table that is packed already."""
    table = table.hint("shuffle_hash")
    inside = (F.expr(f"cpos div {width}") == table["_bin"]) & (F.col("cpos") >= table["_first"]) & (F.col("cpos") < table["_first"] + table["_size"])
    others = [c for c in wanted.columns if c != "cpos"]
    return wanted.join(table, inside).select("cpos", *others, *(_value(table, c, F.col("cpos")) for c in _columns(table)))


def windows_packed(table: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """windows() of a table that is packed already."""
    bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    cut = spans.where("start < end").select("window_id", "start", "end", bins.alias("bin"))
    met = cut.join(table.hint("shuffle_hash"), (F.col("bin") == F.col("_bin")) & (F.col("start") < F.col("_first") + F.col("_size")) & (F.col("_first") < F.col("end")))
    places = F.sequence(F.greatest("start", "_first"), F.least("end", F.col("_first") + F.col("_size")) - 1)
    each = met.select("window_id", "_first", *_columns(table), F.explode(places).alias("cpos"))
    return each.select("cpos", "window_id", *(_value(table, c, F.col("cpos")) for c in _columns(table)))


def gather(df: DataFrame, wanted: DataFrame, width: int = BIN) -> DataFrame:
    """Each row of `wanted` (cpos, ...) with the columns of its position; repeated positions repeat.

    `df` is moved by bins, as arrays, and hashed there, so that neither side is sorted.
    """
    return gather_packed(packed(df, width), wanted, width)


def windows(df: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Each span (window_id, start, end) with the rows of its positions: spans meet the bins they reach into, and what is common is exploded."""
    return windows_packed(packed(df, width), spans, width)


def batched(df: DataFrame, n: int) -> DataFrame:
    """`df` with `batch`: rows of n positions in a row, of which the last may have fewer."""
    if n < 1:
        raise ValueError("a batch has one row at least")
    return df.withColumn("batch", F.floor(F.col("cpos") / n))
