import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexaxis.functions import codec

EDGES = [0, -64, 63, -8192, 8191] + [x for b in (20, 27, 34, 41, 48, 55, 63) for x in (-(1 << b), (1 << b) - 1)]
BYTES = [b"\x00", b"\x7f", b"\x3f"] + [(b"\xff" if x < 0 else b"\xbf") + b"\xff" * (n - 2) + (b"\xff" if n == 9 else b"\x7f") for n in range(2, 10) for x in (-1, 1)]
LENGTHS = [1, 1, 1] + [n for n in range(2, 10) for _ in (0, 1)]
longs = st.integers(-(1 << 63), (1 << 63) - 1)


def test_bytes_at_the_edges():
    out, offsets = codec.encode_array(np.array(EDGES))
    assert [out[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)] == BYTES
    assert codec.decode_bytes(b"".join(BYTES)) == EDGES


@given(st.lists(longs))
def test_round_trip(values):
    assert codec.decode_bytes(codec.encode_array(np.array(values, np.int64))[0].tobytes()) == values


def test_cut_off_varint_is_an_error():
    with pytest.raises(ValueError):
        codec.decode_bytes(b"\xff")


def test_columns(spark):
    df = spark.createDataFrame([(x,) for x in [*EDGES, None]], "x bigint")
    rows = df.select("x", codec.varint_length(F.col("x")).alias("n"), codec.varint_encode("x").alias("raw"), codec.varint_decode(codec.varint_encode("x")).alias("back")).collect()
    assert [r.n for r in rows] == [*LENGTHS, None]
    assert [None if r.raw is None else bytes(r.raw) for r in rows] == [*BYTES, None]
    assert [r.back for r in rows] == [*EDGES, None]


def test_blocks_and_delta(spark):
    lists = [[3, 5, 5, 100], [], None, [7], [-1, -(1 << 40)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, xs array<bigint>")
    rows = df.orderBy("i").select(codec.delta(F.col("xs")).alias("d"), codec.varint_decode_block(codec.varint_encode_block("xs")).alias("back")).collect()
    assert [r.back for r in rows] == lists
    assert [r.d for r in rows] == [[3, 2, 0, 95], [], None, [7], [-1, 1 - (1 << 40)]]


def fnv_slow(raw: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in raw:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h - (1 << 64) if h >> 63 else h


@given(st.lists(st.text(max_size=40)))
def test_hash_is_that_of_a_loop(texts):
    raw = [t.encode() for t in texts]
    assert codec.fnv1a_array(raw).tolist() == [fnv_slow(r) for r in raw]


def test_hash_of_every_type(spark):
    import __spark_entry__ as entry

    found = entry.queries()["fnv_hash"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.hash == fnv_slow(r.str.encode()) for r in found)
