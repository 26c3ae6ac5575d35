"""Cut points of long plans, kept where every executor can read them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a side of a join may have to be sent to every executor.
BROADCAST_ROWS = 500_000
#: The same for tables of a few numbers a row that Spark would send by the size of their compressed files, which is many times less than in memory.
NUMBER_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names, or the context's checkpoint folder.

    Where neither is set a local run gets a new temporary one, as in tests; on a cluster that is an error,
    as every executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        of_context = context._jsc.sc().getCheckpointDir()
        if of_context.isDefined():
            found = of_context.get()
        elif context.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its plan starts anew.

    Unlike a local checkpoint it survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the counted ``rows`` stay within ``most``; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= most else df


def broadcast_or_merge(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Like ``maybe_broadcast``, but beyond ``most`` (``NUMBER_ROWS``) a merge join also where Spark's own estimate would send ``df``."""
    return F.broadcast(df) if rows <= (NUMBER_ROWS if most is None else most) else df.hint("merge")
