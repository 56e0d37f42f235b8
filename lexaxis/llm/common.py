"""What the training-data operators share: row identity, the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is estimated to take at most this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_STABLE = {"LogicalRelation", "DataSourceV2ScanRelation", "Project", "Filter", "LocalRelation", "LogicalRDD", "Range", "SubqueryAlias"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's checkpoint directory.

    It comes from ``spark.checkpoint.dir``. Only a local session that has none
    gets a temporary one; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="lexaxis-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, so that a lost executor costs a read, not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def _repeatable(plan) -> bool:
    if plan.nodeName().split(" ")[0] not in _STABLE or not plan.deterministic():
        return False
    children = plan.children()
    return all(_repeatable(children.apply(i)) for i in range(children.size()))


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """(`df` with a row number that is the same whenever it is computed, that column's name).

    Rows keep apart even where every column repeats or is null. The number is
    that of the row in its file split, so the rows must come straight from files
    (or a checkpoint); any other plan is checkpointed first.
    """
    if not _repeatable(df._jdf.queryExecution().optimizedPlan()):
        df = settled(df)
    name = fresh(df, "row_number_in_files")
    return df.select("*", F.monotonically_increasing_id().alias(name)), name


def column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def id_and_text(df: DataFrame, rid: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (rid, doc_id, text) under names of our own, whatever else the table holds."""
    return df.select(column(df, rid).alias("rid"), column(df, id_col).cast("long").alias("doc_id"), column(df, text_col).cast("string").alias("text"))


def bounded(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """`df` marked for broadcast if its counted rows are small, else left to a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def without_rows(df: DataFrame, rid: str, removed: DataFrame) -> DataFrame:
    """`df` less the rows whose number is in the checkpointed one-column `removed`; the number goes too."""
    gone = removed.select(F.col("rid").alias(rid))
    return df.join(bounded(gone, removed.count(), 24), rid, "left_anti").drop(rid)
