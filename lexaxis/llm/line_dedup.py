"""Incremental, reversible line dedup: sharded cuckoo filters before exact reference counts.

A LineStore keeps, in a folder that all executors share, append-only tables:

* occurrences: every line that an inserted document has (digest, document, line number);
* counts: reference-count changes by line digest, + on insertion, - on deletion;
* owners: the occurrence that keeps a line, for lines that are new or change hands (null: nobody has the line any more);
* filters: one cuckoo filter per shard of the digest space, by version;
* deleted: the documents taken out again;
* commits: one row for each insertion or deletion, written last, that names its tables.

A line that its shard's filter doesn't know is new for certain, so that only
lines that the filter finds are looked up in the counts. Digests are 128-bit
(MD5) and stand for the lines.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaxis.llm.common import bounded, column, fresh, numbered, scratch, settled
from lexaxis.llm.cuckoo import CuckooFilter

SHARDS = 64
#: Text of one shard; more text than SHARDS such is cut into more shards.
SHARD_BYTES = 64 << 20
_COMMIT = "batch int, shards long, occurrences string, counts string, owners string, deleted string, filters string"
_OWNER = "struct<batch:int,none:boolean,doc_id:bigint,rid:bigint,line_no:int>"
_FILTERS = "shard long, capacity long, held long, filter binary"


def _lines(text):
    return F.split(text, "\n", -1)


def _keys(lines: pa.Array) -> np.ndarray:
    """The digests' first eight bytes."""
    fixed = lines.combine_chunks() if isinstance(lines, pa.ChunkedArray) else lines
    fixed = fixed.cast(pa.binary(16))
    raw = np.frombuffer(fixed.buffers()[1], np.uint8)[fixed.offset * 16 :][: len(fixed) * 16]
    return raw.view(np.uint64)[::2].copy()


def _probe(lines: pa.Table, kept: pa.Table) -> pa.Table:
    if not lines.num_rows:
        return pa.table({"line": pa.array([], pa.binary()), "seen": pa.array([], pa.bool_())})
    blob = kept["filter"][0].as_py() if kept.num_rows else None
    seen = CuckooFilter.from_bytes(blob).contains(_keys(lines["line"])) if blob else np.zeros(lines.num_rows, bool)
    return pa.table({"line": lines["line"].cast(pa.binary()), "seen": pa.array(seen)})


def _change(lines: pa.Table, kept: pa.Table) -> pa.Table:
    """The shard's filter with the lines of sign 1 put in and those of sign -1 taken out."""
    shard = (lines if lines.num_rows else kept)["shard"][0].as_py()
    if kept.num_rows:
        made = CuckooFilter.from_bytes(kept["filter"][0].as_py())
    else:
        made = CuckooFilter.for_keys(2 * lines.num_rows)
    if lines.num_rows:
        keys, sign = _keys(lines["line"]), lines["sign"].to_numpy()
        made.delete(keys[sign < 0])
        made.insert(keys[sign > 0])
    return pa.table({"shard": pa.array([shard], pa.int64()), "capacity": pa.array([made.capacity], pa.int64()), "held": pa.array([made.held], pa.int64()), "filter": pa.array([made.to_bytes()], pa.binary())})


class LineStore:
    """A line-dedup state at `path`, new or as an earlier one left it; `shards` is fixed by the first commit.

    insert() and delete() are made visible by one row of commits each, written
    last: a run that is lost midway leaves the state as it was. One store at a
    time writes to a path.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS) -> None:
        self.spark, self.path, self.shards = spark, path, shards
        self._log = self._committed()
        if self._log:
            self.shards = self._log[0]["shards"]

    # -- tables -------------------------------------------------------------------------------

    def _committed(self) -> list[dict]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return []
        rows = self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits").orderBy("batch").collect()  # one a step
        if [x.batch for x in rows] != list(range(len(rows))):
            raise ValueError(f"the commits in {self.path} are not one of each batch: {[x.batch for x in rows]}")
        return [{k: v for k, v in x.asDict().items() if v is not None} for x in rows]

    def _commit(self, step: dict) -> None:
        step = step | {"batch": len(self._log), "shards": self.shards}
        row = tuple(step.get(x.split(" ")[0]) for x in _COMMIT.split(", "))
        self.spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        self._log.append(step)

    def _read(self, kind: str, schema: str, log: list[dict] | None = None) -> DataFrame:
        at = [f"{self.path}/{x[kind]}" for x in (self._log if log is None else log) if kind in x]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{len(self._log)}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def filters(self) -> DataFrame:
        """(shard, capacity, held, filter), the latest of each shard."""
        last = [x["filters"] for x in self._log if "filters" in x][-1:]
        return self.spark.read.schema(_FILTERS).parquet(*(f"{self.path}/{x}" for x in last)) if last else self.spark.createDataFrame([], _FILTERS)

    def counts(self) -> DataFrame:
        """(shard, line, refs): exact reference counts of all lines that a live document has."""
        return self._counts(self._log)

    def _counts(self, log: list[dict], of: DataFrame | None = None, key: str = "line") -> DataFrame:
        changes = self._read("counts", "shard long, line binary, refs long", log)
        if of is not None:
            changes = changes.join(of, key, "left_semi")
        return changes.groupBy("shard", "line").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def occurrences(self) -> DataFrame:
        """(shard, line, owner) of every line of the live documents."""
        rows = self._read("occurrences", f"shard long, line binary, owner {_OWNER}")
        gone = self._read("deleted", "gone_id long, gone_batch int")
        return rows.join(gone, (rows.owner.doc_id == gone.gone_id) & (rows.owner.batch <= gone.gone_batch), "left_anti")

    def owned(self) -> DataFrame:
        """(line, doc_id, batch, rid, line_no): the occurrence that keeps each live line now: of the earliest batch, there of the least (doc_id, row, line number), nulls last."""
        steps = [(i, x["owners"]) for i, x in enumerate(self._log) if "owners" in x]
        read = lambda at: self.spark.read.schema(f"line binary, owner {_OWNER}").parquet(f"{self.path}/{at}")
        if not steps:
            rows = self.spark.createDataFrame([], f"line binary, owner {_OWNER}")
        elif len(steps) == 1:
            rows = read(steps[0][1])
        else:
            rows = read(steps[0][1]).withColumn("step", F.lit(steps[0][0]))
            for i, at in steps[1:]:
                rows = rows.unionByName(read(at).withColumn("step", F.lit(i)))
            rows = rows.groupBy("line").agg(F.max_by("owner", "step").alias("owner"))
        return rows.where("owner is not null").select("line", "owner.doc_id", "owner.batch", "owner.rid", "owner.line_no")

    def _refilter(self, change: DataFrame, step: dict) -> str:
        """Applies (shard, line, sign) to the filters; a shard that would be too full is rebuilt from the exact counts with those of `step`, which isn't committed yet."""
        old = self.filters()
        sizes = change.groupBy("shard").agg(F.sum("sign").alias("more"))
        tight = sizes.join(old.select("shard", "capacity", "held"), "shard", "left").where("more > 0 and (capacity is null or held + more > capacity)").select("shard", F.col("capacity").isNull().alias("new"))
        tight = settled(tight)  # at most one row a shard
        full = bounded(tight.where("not new").select("shard"), tight.count(), 24)
        if tight.where("not new").isEmpty():
            changed = change.select("shard", "line", "sign")
        else:
            rebuilt = self._counts([*self._log, step], full, "shard").select("shard", "line", F.lit(1).alias("sign"))
            changed = change.join(full, "shard", "left_anti").select("shard", "line", "sign").unionByName(rebuilt)
            old = old.join(full, "shard", "left_anti")
        made = changed.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_change, _FILTERS)
        return self._write(made, "filters")

    # -- operations ---------------------------------------------------------------------------

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds `docs` as the next batch and returns them, all columns, with the lines that others own taken out of the text.

        A line belongs to the earliest batch that has it and there to the least
        (doc_id, row, line number), nulls last.

        * blank lines (empty or spaces) are never counted and stay where they are;
        * a row all of whose other lines are owned elsewhere is left out;
        * null or empty text, or only blank lines: the row stays as it is;
        * repeated rows: the first keeps its lines, the others are left out;
        * null doc_id: allowed, last in order, and can't be deleted by id;
        * very long lines and texts, and texts of very many lines, count whole; an empty table is a batch without rows;
        * other columns, of any name, are carried along.
        """
        table, rid = numbered(docs)
        batch = len(self._log)
        text = column(table, text_col)
        cut = table.select(column(table, rid).alias("rid"), column(table, id_col).cast("long").alias("doc_id"), F.posexplode(_lines(text)).alias("line_no", "body")).where("trim(body) <> ''")
        digest = F.unhex(F.md5("body"))
        owner = F.struct(F.lit(batch).alias("batch"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "line_no")
        occ = cut.select(F.pmod(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long"), F.lit(self.shards)).alias("shard"), digest.alias("line"), owner.alias("owner"))
        step = {"occurrences": self._write(occ, "occurrences")}
        occ = self.spark.read.schema(f"shard long, line binary, owner {_OWNER}").parquet(f"{self.path}/{step['occurrences']}")
        mine = occ.groupBy("shard", "line").agg(F.count("*").alias("refs"), F.min("owner").alias("owner"))
        step["counts"] = step["owners"] = self._write(mine, "batch")
        mine = self.spark.read.schema(f"shard long, line binary, refs long, owner {_OWNER}").parquet(f"{self.path}/{step['counts']}")
        new = mine
        if any("filters" in x for x in self._log):
            seen = mine.select("shard", "line").groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probe, "line binary, seen boolean")
            maybe = settled(seen.where("seen").select("line"))
            known = settled(self._counts(self._log, bounded(maybe, maybe.count(), 32)).select("line"))
            step["owners"] = self._write(mine.join(bounded(known, known.count(), 32), "line", "left_anti").select("shard", "line", "owner"), "owners")
            new = self.spark.read.schema(f"shard long, line binary, owner {_OWNER}").parquet(f"{self.path}/{step['owners']}")
        step["filters"] = self._refilter(new.select("shard", "line", F.lit(1).alias("sign")), step)
        self._commit(step)
        kept = new.groupBy(F.col("owner.rid").alias(rid)).agg(F.collect_list("owner.line_no").alias("kept"))
        return self._assemble(table, rid, text_col, kept)

    def current(self, docs: DataFrame, batch: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """`docs`, which insert() took as batch number `batch`, as the state has them now.

        Deleted documents are gone; lines that were handed over since are back
        with their new owners. `docs` must be the same DataFrame, or one read
        from the same files in the same way. Cases as in insert().
        """
        table, rid = numbered(docs)
        kept = self.owned().where(F.col("batch") == batch).groupBy(F.col("rid").alias(rid)).agg(F.collect_list("line_no").alias("kept"))
        gone = self._read("deleted", "gone_id long, gone_batch int").where(F.col("gone_batch") >= batch)
        live = table.join(gone, column(table, id_col).cast("long") == gone.gone_id, "left_anti")
        return self._assemble(live, rid, text_col, kept)

    @staticmethod
    def _assemble(table: DataFrame, rid: str, text_col: str, kept: DataFrame) -> DataFrame:
        hold = fresh(table, "kept_line_numbers")
        joined = table.join(kept.withColumnRenamed("kept", hold), rid, "left")
        text, numbers = column(joined, text_col), F.coalesce(F.col(hold), F.array().cast("array<int>"))

        def body(lines):
            blank = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
            return F.array_join(F.transform(F.array_sort(F.concat(numbers, blank)), lambda i: F.get(lines, i)), "\n")

        # the lines are bound by an outer lambda: as an expression they would be split again for each of them
        put = F.transform(F.array(_lines(text)), body)[0]
        all_blank = F.trim(F.translate(text, "\n", "")) == ""
        out = joined.where(text.isNull() | F.col(hold).isNotNull() | all_blank)
        return out.select(*(F.when(text.isNotNull(), put).alias(c) if c == text_col else column(joined, c) for c in table.columns if c != rid))

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> None:
        """Takes the documents with these ids out again; unknown, repeated and null ids are allowed, and so is an empty table.

        Lines that they alone had leave the counts and filters. Lines that they
        owned pass to the next occurrence: see owned() and current().
        """
        gone = settled(ids.select(column(ids, id_col).cast("long").alias("gone_id")).where("gone_id is not null").distinct())
        batch, out = len(self._log), bounded(gone, gone.count(), 24)
        live = self.occurrences()
        lost = live.join(out, live.owner.doc_id == out.gone_id, "left_semi").groupBy("shard", "line").agg((-F.count("*")).alias("refs"))
        step = {"counts": self._write(lost, "counts"), "deleted": self._write(gone.withColumn("gone_batch", F.lit(batch)), "deleted")}
        lost = self.spark.read.schema("shard long, line binary, refs long").parquet(f"{self.path}/{step['counts']}").select("shard", "line")
        stay = live.join(out, live.owner.doc_id == out.gone_id, "left_anti")
        next_ = stay.join(bounded(lost.select("line"), lost.count(), 32), "line", "left_semi").groupBy("line").agg(F.min("owner").alias("owner"))
        step["owners"] = self._write(lost.join(next_, "line", "left").select("shard", "line", "owner"), "owners")
        dead = self.spark.read.schema(f"shard long, line binary, owner {_OWNER}").parquet(f"{self.path}/{step['owners']}").where("owner is null")
        step["filters"] = self._refilter(dead.select("shard", "line", F.lit(-1).alias("sign")), step)
        self._commit(step)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """`docs` as the first batch of a new LineStore in the shared folder; the cases are those of LineStore.insert().

    Without `shards`, their number follows the size of `docs`, so that a filter fits a task.
    """
    spark = docs.sparkSession
    return LineStore(spark, scratch(spark, "lines"), shards or shards_for(docs, text_col)).insert(docs, id_col, text_col)


def shards_for(docs: DataFrame, text_col: str = "text") -> int:
    """A number of shards that follows the size of `docs`, so that a filter fits a task."""
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size >= 1 << 60:  # unknown
        size = docs.agg(F.sum(F.octet_length(column(docs, text_col)))).first()[0] or 0
    return max(SHARDS, size // SHARD_BYTES)


def replay(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` as a store has them that took them in two batches, lost a tenth of the documents and took those once more.

    Batches are the even ids with the null ones, then the odd ids; deleted, and
    inserted as a third batch, are the multiples of ten. Every row is live at the
    end. The cases are those of LineStore.insert().
    """
    spark, key = docs.sparkSession, column(docs, id_col).cast("long")
    store = LineStore(spark, scratch(spark, "lines"), shards_for(docs, text_col))
    even, odd, tenth = docs.where(F.coalesce(key % 2, F.lit(0)) == 0), docs.where(key % 2 != 0), docs.where(key % 10 == 0)
    store.insert(even, id_col, text_col)
    store.insert(odd, id_col, text_col)
    store.delete(tenth.select(key.alias(id_col)), id_col)
    store.insert(tenth, id_col, text_col)
    parts = [store.current(part, batch, id_col, text_col) for part, batch in ((even, 0), (odd, 1), (tenth, 3))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
