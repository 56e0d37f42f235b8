"""The folder that all executors share, for tables between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint directory, from ``spark.checkpoint.dir``; only a local session may lack the setting."""
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
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder: cut off from its lineage, and safe from a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


_STABLE = {"LogicalRelation", "DataSourceV2ScanRelation", "Project", "Filter", "LocalRelation", "LogicalRDD", "Range", "SubqueryAlias"}


def _repeatable(plan) -> bool:
    if plan.nodeName().split(" ")[0] not in _STABLE or not plan.deterministic():
        return False
    return all(_repeatable(plan.children().apply(i)) for i in range(plan.children().size()))


def row_numbers(df: DataFrame, name: str = "row") -> DataFrame:
    """`df` with the number of each row in its file split: the same whenever it is computed, and of no other row."""
    if not _repeatable(df._jdf.queryExecution().optimizedPlan()):
        df = settled(df)
    return df.withColumn(name, F.monotonically_increasing_id())
