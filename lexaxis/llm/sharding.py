"""Range shards of about equal bytes from sampled splitters.

A sample of the records, drawn in proportion to their size, gives the weighted
quantiles of the key; these are the splitters. Ranges that came out overfull are
subdivided evenly by running size, which is found on keys and sizes alone: the
texts are shuffled once, to their range and piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexaxis.llm.common import bounded, column, fresh, numbered, settled

#: Size of a shard, unless MAX_RANGES such don't hold the table: then a shard is that part of it.
SHARD_BYTES = 64 << 20
#: Most ranges there can be. A size that would need more is an error, so that the splitters, about 64 bytes each, can be broadcast.
MAX_RANGES = 1 << 18
SAMPLES_A_RANGE = 64
#: A range above this multiple of the shard size is overfull.
SLACK = 1.25


def _uniform(*keys):
    """A number in [0, 1) that depends on the keys alone: 32 bits of an MD5."""
    text = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def splitters(records: DataFrame, keys: list[str], total: int, ranges: int) -> DataFrame:
    """One row: `bounds`, the ascending array of key structs that end all ranges but the last.

    `records` has the keys and n_bytes. The expected sample is at most
    ranges * SAMPLES_A_RANGE records, so one task orders it.
    """
    unit = max(1, -(-total // (ranges * SAMPLES_A_RANGE)))
    chance = F.col("n_bytes") / F.lit(float(unit))
    sample = records.where(_uniform(*(F.col(k) for k in keys)) < chance).select(*keys, F.greatest("n_bytes", F.lit(unit)).alias("weight"))
    run = sample.withColumn("upto", F.sum("weight").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)))
    run = run.crossJoin(F.broadcast(sample.agg(F.sum("weight").alias("whole"))))  # one row
    at = lambda x: F.floor(x * ranges / F.col("whole"))
    ends = run.where((at(F.col("upto")) > at(F.col("upto") - F.col("weight"))) & (F.col("upto") < F.col("whole")))
    return ends.agg(F.array_sort(F.collect_set(F.struct(*keys))).alias("bounds"))


def _range_of(bounds, key, most: int):
    """How many bounds are less than the key: a binary search."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, most.bit_length())))))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= F.size(bounds)) & (F.get(bounds, low + step - 1) < key), low + step).otherwise(low))


def cuts(records: DataFrame, keys: list[str], sums: DataFrame) -> DataFrame:
    """(range_id, cuts): of the ranges that have several pieces, the array of (keys, rid, piece) at which each piece after the first begins.

    `records` has the keys, rid, n_bytes and range_id. Rows of one key are summed
    by file split first, so that a key that holds much of the table is ordered by many tasks.
    """
    over = records.join(bounded(sums.where("pieces > 1"), sums.count(), 32), "range_id").withColumn("split", F.shiftright("rid", 33))
    block = ["range_id", *keys, "split"]
    blocks = over.groupBy(*block).agg(F.sum("n_bytes").alias("n"))
    ahead = Window.partitionBy("range_id").orderBy(*keys, "split").rowsBetween(Window.unboundedPreceding, -1)
    offset = blocks.select(*(F.col(k).alias(f"{k}_of") for k in block), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    same = F.lit(True)
    for k in block:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    inner = Window.partitionBy(*block).orderBy("rid").rowsBetween(Window.unboundedPreceding, -1)
    found = over.join(offset, same).select(*block, "rid", "n_bytes", "range_bytes", "pieces", "offset")
    before = F.col("offset") + F.coalesce(F.sum("n_bytes").over(inner), F.lit(0))
    piece = F.least(F.floor(before * F.col("pieces") / F.col("range_bytes")), F.col("pieces") - 1)
    found = found.withColumn("piece", piece.cast("int")).where("piece > 0")
    first = found.groupBy("range_id", "piece").agg(F.min(F.struct(*keys, "rid")).alias("at"))
    return first.groupBy("range_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(f"at.{k}").alias(k) for k in (*keys, "rid")), "piece"))).alias("cuts"))


def shard(docs: DataFrame, keys: tuple[str, ...] = ("source", "doc_id"), shard_bytes: int | None = None, text_col: str = "text") -> DataFrame:
    """`docs` with n_bytes, range_id and piece, partitioned by range and piece and in key order within them.

    (range_id, piece) is the shard. Ranges are intervals of the key. A range
    above SLACK times `shard_bytes` is cut into the least number of even pieces
    of at most `shard_bytes`, but for the record that crosses the cut. Without
    `shard_bytes` it is SHARD_BYTES, or the MAX_RANGES-th part of the table if
    that is more; one so small that it needs more than MAX_RANGES is an error.

    * null keys sort first; records of equal keys stay in one range, but may be in several pieces;
    * null or empty text: size 0; a very long record is a piece, never split;
    * repeated rows all stay; ties within a range are in file order;
    * empty table: an empty result; columns named n_bytes, range_id or piece are replaced.
    """
    table, rid = numbered(docs.drop("n_bytes", "range_id", "piece"))
    size = F.coalesce(F.octet_length(column(table, text_col)), F.lit(0)).cast("long")
    own = [f"key_{i}" for i in range(len(keys))]
    records = settled(table.select(*(column(table, k).alias(o) for k, o in zip(keys, own, strict=True)), column(table, rid).alias("rid"), size.alias("n_bytes")))
    total = records.agg(F.sum("n_bytes")).first()[0] or 0
    least = -(-total // MAX_RANGES)
    shard_bytes = max(SHARD_BYTES, least) if shard_bytes is None else shard_bytes
    if shard_bytes < least:
        raise ValueError(f"{total} bytes in shards of {shard_bytes} are more than {MAX_RANGES} ranges; give {least} at least")
    ranges = max(1, -(-total // shard_bytes))
    bounds = settled(splitters(records, own, total, ranges))  # one row of at most MAX_RANGES splitters
    of = _range_of(F.col("bounds"), F.struct(*own), ranges)
    records = settled(records.crossJoin(F.broadcast(bounds)).select(*own, "rid", "n_bytes", of.alias("range_id")))
    sums = records.groupBy("range_id").agg(F.sum("n_bytes").alias("range_bytes"))
    pieces = F.when(F.col("range_bytes") > int(SLACK * shard_bytes), F.ceil(F.col("range_bytes") / F.lit(float(shard_bytes)))).otherwise(F.lit(1))
    at = settled(cuts(records, own, settled(sums.select("range_id", "range_bytes", pieces.alias("pieces")))))
    hold, held = fresh(table, "bounds_of_ranges"), fresh(table, "cuts_of_range")
    named = table.crossJoin(F.broadcast(bounds.select(F.col("bounds").alias(hold))))
    key = F.struct(*(column(named, k).alias(o) for k, o in zip(keys, own, strict=True)))
    placed = named.select(*(column(named, c) for c in table.columns), size.alias("n_bytes"), _range_of(F.col(hold), key, ranges).alias("range_id"))
    n_cuts = at.agg(F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()[0]
    placed = placed.join(bounded(at.select("range_id", F.col("cuts").alias(held)), n_cuts, 80), "range_id", "left")
    # a cut is at a record, so the records from it on have a cut that isn't greater than themselves
    mine = F.struct(*(column(placed, k).alias(o) for k, o in zip(keys, own, strict=True)), F.col(rid).alias("rid"), F.lit(1 << 30).alias("piece"))
    passed = _range_of(F.col(held), mine, max(1, n_cuts))
    piece = F.when(F.col(held).isNull() | (passed == 0), 0).otherwise(F.get(F.col(held), passed - 1).piece)
    out = placed.select(*(column(placed, c) for c in table.columns), "n_bytes", F.col("range_id").cast("int"), piece.cast("int").alias("piece"))
    out = out.repartition("range_id", "piece").sortWithinPartitions("range_id", "piece", *(f"`{k}`" for k in keys), rid)
    return out.drop(rid)


def oracle(shard_bytes: int = SHARD_BYTES) -> str:
    """The same in SQL, for documents sharded by (source, doc_id); ties aside, since file order has no name there."""
    return f"""
    with r as (select *, cast(coalesce(strlen(text), 0) as bigint) as n_bytes from documents),
    z as (select coalesce(sum(n_bytes), 0) as total, greatest({shard_bytes}, cast(ceil(coalesce(sum(n_bytes), 0) / {MAX_RANGES}.0) as bigint)) as shard_bytes from r),
    t as (select total, shard_bytes, greatest(1, cast(ceil(total / cast(shard_bytes as double)) as bigint)) as ranges from z),
    u as (select ranges, greatest(1, cast(ceil(total / (ranges * {SAMPLES_A_RANGE}.0)) as bigint)) as unit from t),
    s as (select source, doc_id, greatest(n_bytes, unit) as weight, ranges from r, u
          where cast(('0x' || substr(md5(coalesce(source, '') || '|' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) / 4294967296.0 < n_bytes / cast(unit as double)),
    c as (select *, sum(weight) over (order by source, doc_id rows unbounded preceding) as upto, sum(weight) over () as whole from s),
    b as (select distinct source as bs, doc_id as bd from c
          where floor(cast(upto as double) * ranges / whole) > floor(cast(upto - weight as double) * ranges / whole) and upto < whole),
    p as (select r.*, (select count(*) from b where b.bs < r.source or (b.bs = r.source and b.bd < r.doc_id)) as range_id from r),
    g as (select range_id, sum(n_bytes) as range_bytes from p group by range_id),
    h as (select g.*, case when range_bytes > floor({SLACK} * shard_bytes) then ceil(range_bytes / cast(shard_bytes as double)) else 1 end as pieces from g, t),
    w as (select p.*, range_bytes, pieces, sum(n_bytes) over (partition by p.range_id order by source, doc_id rows unbounded preceding) - n_bytes as before from p join h on p.range_id = h.range_id)
    select doc_id, text, lang, source, n_chars, n_bytes, cast(range_id as integer) as range_id,
           cast(least(case when range_bytes > 0 then floor(before * pieces / range_bytes) else 0 end, pieces - 1) as integer) as piece
    from w
    """
