"""Interval lookup over segment layers (seg_id, start, end): half-open, disjoint, numbered by start."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of one bin of the interval join.
BIN = 1024


def _cut(segments: DataFrame, *columns: str, width: int = BIN) -> DataFrame:
    """Segments, once for each bin that they reach into, as a side to be hashed: a bin holds a bounded number of disjoint ones."""
    bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    return segments.where("start < end").select(*columns, bins.alias("bin")).hint("shuffle_hash")


def find_containing(points: DataFrame, segments: DataFrame, how: str = "inner", width: int = BIN) -> DataFrame:
    """`points` (cpos, ...) with the columns of the segment that holds each; how="left" keeps the uncovered.

    An equi-join on bins of `width` positions: a segment counts in each bin that
    it reaches into, a point in one. The span test is left as a residual.
    """
    cut = _cut(segments, "*", width=width)
    placed = points.withColumn("bin", F.expr(f"cpos div {width}"))
    return placed.join(cut, (placed.bin == cut.bin) & (placed.cpos >= cut.start) & (placed.cpos < cut.end), how).drop("bin")


def runs(points: DataFrame) -> DataFrame:
    """(start, end) of the runs of positions that follow each other in `points`; each point is in one, a repeated one in several."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            cpos = batch.column(0).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.diff(cpos, prepend=cpos[:1] - 2) != 1)
            ends = np.r_[begins[1:], len(cpos)][: len(begins)] - 1
            yield pa.RecordBatch.from_arrays([pa.array(cpos[begins], pa.int64()), pa.array(cpos[ends] + 1, pa.int64())], ["start", "end"])

    return points.where("cpos is not null").select(F.col("cpos").cast("long")).mapInArrow(run, "start long, end long")


def positions_within(spans: DataFrame, segments: DataFrame, width: int = BIN) -> DataFrame:
    """`spans` (start, end, ...) with `cpos`, each of their positions that a segment holds, and that segment's other columns than its span.

    Spans and segments meet by bins; what they have in common there is exploded after the join, so that no position is shuffled.
    """
    others, more = ([c for c in df.columns if c not in ("start", "end")] for df in (spans, segments))
    bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    asked = spans.where("start < end").select(*others, F.col("start").alias("_start"), F.col("end").alias("_end"), bins.alias("_bin"))
    cut = _cut(segments, *more, "start", "end", width=width)
    low = F.greatest("_start", "start", F.col("_bin") * width)
    high = F.least("_end", "end", (F.col("_bin") + 1) * width)
    return asked.join(cut, (F.col("_bin") == F.col("bin")) & (low < high)).select(*others, F.explode(F.sequence(low, high - 1)).alias("cpos"), *more)


def start_flags(points: DataFrame, segments: DataFrame, width: int = 256) -> DataFrame:
    """(cpos, at_start): whether a segment starts at the point. The runs of points meet the starts of their bin, an array."""
    bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    asked = runs(points).select("start", "end", bins.alias("bin"))
    starts = segments.groupBy(F.expr(f"start div {width}").alias("bin")).agg(F.collect_set("start").alias("starts"))
    inside = F.sequence(F.greatest("start", F.col("bin") * width), F.least("end", (F.col("bin") + 1) * width) - 1)
    each = asked.join(starts.hint("shuffle_hash"), "bin", "left").select(F.explode(inside).alias("cpos"), "starts")
    return each.select("cpos", F.coalesce(F.array_contains("starts", F.col("cpos")), F.lit(False)).alias("at_start"))


def contains(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """The spans (start, end, ...) that are segments exactly."""
    return spans.join(segments, ["start", "end"], "left_semi")


def contains_start(points: DataFrame, segments: DataFrame) -> DataFrame:
    return points.join(segments.select(F.col("start").alias("cpos")), "cpos", "left_semi")


def contains_end(points: DataFrame, segments: DataFrame) -> DataFrame:
    """The points that are a segment's exclusive end."""
    return points.join(segments.select(F.col("end").alias("cpos")), "cpos", "left_semi")


def uncovered(points: DataFrame, segments: DataFrame, width: int = BIN) -> DataFrame:
    cut = _cut(segments, "start", "end", width=width)
    placed = points.withColumn("bin", F.expr(f"cpos div {width}"))
    return placed.join(cut, (placed.bin == cut.bin) & (placed.cpos >= cut.start) & (placed.cpos < cut.end), "left_anti").drop("bin")


def overlaps(segments: DataFrame, width: int = BIN) -> DataFrame:
    """(seg_id, other) of segments that overlap; a valid layer gives none. Bins again, so no task sees all."""
    bins = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(end - 1) div {width}")))
    cut = segments.where("start < end").select("seg_id", "start", "end", bins.alias("bin"))
    ahead = Window.partitionBy("bin").orderBy("start", "seg_id").rowsBetween(Window.unboundedPreceding, -1)
    reach = cut.select("*", F.max_by("seg_id", "end").over(ahead).alias("other"), F.max("end").over(ahead).alias("reach"))
    return reach.where("start < reach").select("seg_id", "other").distinct()


def join_tokens(points: DataFrame, segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """(seg_id, cpos, word) of all tokens of the segments that hold any of `points`, each segment once."""
    hit = find_containing(points.select("cpos"), segments.select("seg_id", "start", "end")).select("seg_id", "start", "end").distinct()
    return find_containing(tokens.select("cpos", "word"), hit).select("seg_id", "cpos", "word")


def boundary_flags(points: DataFrame, segments: DataFrame) -> DataFrame:
    """`points` with flags: 1 inside, 2 at the first token, 4 at the last token of a segment; 0 outside."""
    found = find_containing(points, segments.select("start", "end"), "left")
    flag = F.when(F.col("start").isNull(), 0).otherwise(1 + F.when(F.col("cpos") == F.col("start"), 2).otherwise(0) + F.when(F.col("cpos") == F.col("end") - 1, 4).otherwise(0))
    return found.select(*points.columns, flag.cast("int").alias("flags"))
