"""Varint, delta and hash functions.

A varint has groups of bits, high ones first. The first byte holds a
continuation flag, the sign and six bits; the next seven hold the flag and seven
bits; a ninth holds eight bits. Negative numbers are stored as complements.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

BLOCK_ROWS = 16
_LIMITS = (6, 13, 20, 27, 34, 41, 48, 55)


def varint_length(x: Column) -> Column:
    """Bytes of the varint of a bigint: plain comparisons, inside code generation."""
    magnitude = F.when(x < 0, F.bitwise_not(x)).otherwise(x)
    steps = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, bits in enumerate(_LIMITS):
        steps = steps.when(magnitude < F.lit(1 << bits), i + 1)
    return steps.otherwise(9)


def encode_array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all varints, n+1 offsets)."""
    values = np.asarray(values, np.int64)
    negative = values < 0
    m = np.where(negative, ~values, values).astype(np.uint64)
    length = np.searchsorted(np.array([1 << b for b in _LIMITS], np.uint64), m, side="right") + 1
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    out = np.zeros(offsets[-1], np.uint8)
    for size in range(1, 10):
        own = np.flatnonzero(length == size)
        if not len(own):
            continue
        part, at = m[own], offsets[:-1][own]
        wide = size == 9
        for k in range(size):
            shift = np.uint64(0 if wide and k == 8 else 7 * (size - 1 - k) + (1 if wide else 0))
            mask = 0xFF if wide and k == 8 else (0x3F if k == 0 else 0x7F)
            byte = ((part >> shift) & np.uint64(mask)).astype(np.uint8)
            if k == 0:
                byte |= negative[own].astype(np.uint8) << 6
            if k < size - 1:
                byte |= np.uint8(0x80)
            out[at + k] = byte
    return out, offsets


def decode_bytes(raw: bytes) -> list[int]:
    """The integers of a series of varints; ValueError if the last is cut off."""
    found, i = [], 0
    while i < len(raw):
        first = raw[i]
        value, k = first & 0x3F, 1
        more = first & 0x80
        while more:
            if i + k >= len(raw):
                raise ValueError("a varint is cut off")
            byte = raw[i + k]
            if k == 8:
                value, more = value << 8 | byte, 0
            else:
                value, more = value << 7 | byte & 0x7F, byte & 0x80
            k += 1
        found.append(~value if first & 0x40 else value)
        i += k
    return found


# Arrow arrays, not pandas series: a null among bigints would make those floating-point numbers.


def _binary(out: np.ndarray, ends: np.ndarray, valid: pa.Array) -> pa.Array:
    """Slices of `out` that end at `ends`; where not `valid`, null."""
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int64))
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(out.tobytes())])
    return pc.if_else(valid, made, pa.scalar(None, pa.large_binary())).cast(pa.binary())


@F.arrow_udf(BinaryType())
def varint_encode(x: pa.Array) -> pa.Array:
    out, offsets = encode_array(x.drop_null().to_numpy(zero_copy_only=False))
    valid = x.is_valid()
    return _binary(out, offsets[np.cumsum(valid.to_numpy(zero_copy_only=False))], valid)


@F.arrow_udf(LongType())
def varint_decode(x: pa.Array) -> pa.Array:
    values = x.drop_null().to_pylist()
    flat = decode_bytes(b"".join(values))
    if len(flat) != len(values) or not all(values):
        raise ValueError("a value isn't exactly one varint")
    at = np.cumsum(x.is_valid().to_numpy(zero_copy_only=False)) - 1
    return pc.if_else(x.is_valid(), pa.array(np.array([*flat, 0], np.int64)[at]), pa.scalar(None, pa.int64()))


@F.arrow_udf(BinaryType())
def varint_encode_block(x: pa.Array) -> pa.Array:
    """The varints of an array, one after the other."""
    out, offsets = encode_array(x.flatten().to_numpy(zero_copy_only=False))
    sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return _binary(out, offsets[np.cumsum(sizes)], x.is_valid())


@F.arrow_udf(ArrayType(LongType()))
def varint_decode_block(x: pa.Array) -> pa.Array:
    return pa.array([None if v is None else decode_bytes(v) for v in x.to_pylist()], pa.list_(pa.int64()))


def delta(xs: Column) -> Column:
    """Each member less the one before; the first stays."""
    return F.transform(xs, lambda v, i: F.when(i == 0, v).otherwise(v - F.get(xs, i - 1)))


def delta_encode(value: Column, block: Column, order: Column) -> Column:
    """Differences within blocks, over rows."""
    return value - F.coalesce(F.lag(value).over(Window.partitionBy(block).orderBy(order)), F.lit(0))


def delta_decode(value: Column, block: Column, order: Column) -> Column:
    """The inverse of delta_encode()."""
    return F.sum(value).over(Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def fnv1a_array(texts: list[bytes]) -> np.ndarray:
    """FNV-1a, 64 bits, reinterpreted as signed: all texts in step, byte by byte."""
    length = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(length) - length
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    h = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-length, kind="stable")
    alive = np.searchsorted(-length[order], -np.arange(1, int(length.max(initial=0)) + 1), side="right")
    for k, n in enumerate(alive):
        own = order[:n]
        h[own] = (h[own] ^ data[start[own] + k]) * np.uint64(0x100000001B3)
    return h.view(np.int64)


@F.arrow_udf(LongType())
def fnv_hash(x: pa.Array) -> pa.Array:
    hashes = fnv1a_array([(v or "").encode() for v in x.to_pylist()])
    return pc.if_else(x.is_valid(), pa.array(hashes), pa.scalar(None, pa.int64()))
