"""Session matters that the operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files, compressed, that one task of an exchange takes.
TASK_BYTES = 64 << 20


def partitions(spark: SparkSession, df: DataFrame | None = None) -> int:
    """How many ways data are dealt out: the session's shuffle partitions, and more where the bytes of ``df`` ask for it."""
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is None:
        return least
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    # a source that doesn't know its size claims one beyond any table
    return least if size > 1 << 60 else max(least, -(-size // TASK_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set and one machine does everything (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillstats-"))
            folder = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """The rows written to the shared folder and read again, and where, so that they can be removed once nothing needs them."""
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of one id up to which a table of ids is broadcast, about 32 MB; larger ones are joined by exchange.
MOST_BROADCAST = 1_000_000


def lookup(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast only after its rows have been counted."""
    written = cut(ids)
    return F.broadcast(written) if written.count() <= MOST_BROADCAST else written


def gathered(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a table of bounded size on the driver, by way of Arrow."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}
