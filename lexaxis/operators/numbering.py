"""Running totals and dense numbers over a whole table without one task that sees every row.

Rows fall into blocks that ascend with the order wanted. Totals by block are few
and are summed up first; within a block a window does the rest. The rows
themselves are shuffled once, by block. Where positions make no blocks of even
size, in_blocks() makes them of the order itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions, or integer keys, of one block.
BLOCK = 1 << 16


def block_of(position: Column, size: int = BLOCK) -> Column:
    """The block of a position or integer key; ascends with it, below zero too."""
    return F.floor(position / F.lit(size)) if size & (size - 1) else F.shiftright(position, size.bit_length() - 1)


def running_totals(df: DataFrame, blocks: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """`df` with, under each name, the sum of its column over all earlier rows (by `blocks`, then `order`).

    `blocks` are non-null columns of `df`; the pair (blocks, order) decides the order for certain.
    """
    amounts = {f"{name}_amount": amount for name, amount in totals.items()}
    df = df.withColumns(amounts)
    sums = df.groupBy(*blocks).agg(*(F.sum(a).alias(a) for a in amounts))
    earlier = Window.orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*blocks, *(F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"{a}_before") for a in amounts))
    inner = Window.partitionBy(*blocks).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(offsets, blocks)
    joined = joined.withColumns({name: F.col(f"{name}_amount_before") + F.coalesce(F.sum(f"{name}_amount").over(inner), F.lit(0)) for name in totals})
    return joined.drop(*amounts, *(f"{a}_before" for a in amounts))


def numbered(df: DataFrame, blocks: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with dense numbers from 0 in the order of (blocks, order)."""
    return running_totals(df, blocks, order, {name: F.lit(1).cast("long")})


def in_blocks(df: DataFrame, order: list[Column], name: str = "block") -> DataFrame:
    """`df` range-partitioned by `order`, with its partition's number; written to the shared folder, since the borders are those of a sample.

    Keys may be sparse, repeated or null: if `order` ends with a row number, every block is of bounded size.
    """
    from lexaxis.sources.shared import settled

    return settled(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()))


class Blocks:
    """A table in an order, whose rows have `block`, and under "<counter>_before" the sum of the block's earlier rows; `offsets` has the sums of earlier blocks."""

    def __init__(self, df: DataFrame, counters: list[str]) -> None:
        sums = df.groupBy("block").agg(F.count("*").alias("rows"), *(F.sum(c).alias(c) for c in counters if c != "rows"))
        self.df, self.offsets, self._totals = df, {}, dict.fromkeys(counters, 0)
        for r in sums.orderBy("block").collect():  # a row a task
            self.offsets[r.block] = dict(self._totals)
            for c in counters:
                self._totals[c] += r[c]

    def total(self, counter: str) -> int:
        return self._totals[counter]

    def placed(self, names: dict[str, str]) -> DataFrame:
        """The rows with, under each name, the sum of its counter over all earlier ones; a scan and no shuffle."""
        fields = ", ".join(f"`{name}_of_block` long" for name in names)
        rows = [(block, *(sums[c] for c in names.values())) for block, sums in self.offsets.items()]
        offsets = self.df.sparkSession.createDataFrame(rows, f"block int, {fields}")
        joined = self.df.join(F.broadcast(offsets), "block")  # a row a task
        return joined.withColumns({name: F.col(f"{name}_of_block") + F.col(f"{c}_before") for name, c in names.items()}).drop(*(f"{name}_of_block" for name in names))


def in_order(df: DataFrame, order: list[Column], path: str, counters: set[str] = frozenset(), counted=None) -> Blocks:
    """Writes `df` range-partitioned and sorted by `order` to `path`, each task counting its rows and what `counted` gives.

    `order` decides the order for certain, so a task that is repeated counts the
    same. `counted` turns a batch into (the rows that stay, {counter: amounts}).
    """
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    names = sorted(counters)

    def run(batches):
        block, so_far = TaskContext.get().partitionId(), dict.fromkeys(["rows", *names], 0)
        for batch in batches:
            batch, amounts = counted(batch) if counted else (batch, {})
            amounts["rows"] = np.ones(batch.num_rows, np.int64)
            before = {}
            for c in so_far:
                upto = so_far[c] + np.cumsum(amounts[c], dtype=np.int64)
                before[c] = upto - amounts[c]
                so_far[c] = int(upto[-1]) if len(upto) else so_far[c]
            more = [pa.array(np.full(batch.num_rows, block, np.int32)), *(pa.array(before[c]) for c in so_far), *(pa.array(amounts[c].astype(np.int64)) for c in names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "block", *(f"{c}_before" for c in so_far), *names])

    schema = StructType([*df.schema.fields, StructField("block", IntegerType()), *(StructField(f"{c}_before", LongType()) for c in ["rows", *names]), *(StructField(c, LongType()) for c in names)])
    df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return Blocks(df.sparkSession.read.schema(schema).parquet(path), ["rows", *names])
