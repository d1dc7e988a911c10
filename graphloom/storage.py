"""The shared folder, and tables written there to cut lineage between the rounds of an iterative operator."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``, the folder that the driver and all executors see.

    Where the setting is missing a local session gets a temporary folder; a cluster session raises, because files in one
    machine's folder would be lost on the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that the driver may hold between two rounds instead of a table.
FEW = 1000


def literal_rows(spark: SparkSession, rows: list[Row], schema: StructType) -> DataFrame:
    """A few rows as a literal of one partition: joins and groups of such tables need no shuffle, and Catalyst knows that they are
    small.  Columns are texts, numbers and arrays of these."""
    said = json.dumps([r.asDict(recursive=True) for r in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(said), ArrayType(schema))))


def kept(df: DataFrame, label: str, few: bool) -> tuple[DataFrame, list | None]:
    """``df`` cut off from its lineage, and its rows if there are few.

    Where the caller expects few, for instance behind a small table, ``df`` is asked for a few rows more than that: if it has
    no more, they are all, and nothing is written.  Otherwise it is a table in the shared folder.
    """
    if few:
        rows = df.limit(FEW + 1).collect()
        if len(rows) <= FEW:
            return literal_rows(df.sparkSession, rows, df.schema), rows
    df = written(df, label)
    rows = df.limit(FEW + 1).collect()
    return df, rows if len(rows) <= FEW else None
