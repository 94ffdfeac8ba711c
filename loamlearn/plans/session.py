"""Tables that outlive executors: Parquet in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only on a local master, where it is unset. Anywhere else that is an error,
    since executors would write to disks that the others can't read."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loamlearn-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _saved_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/loamlearn-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """The table written and read again: no lineage, and no partition is computed twice."""
    path = _saved_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They travel as Arrow: a list of rows would start more Python workers, of a
    second daemon, on every executor."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in rows], arrow), struct)


def remove(df: DataFrame) -> None:
    """Deletes the files of a saved table."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


#: Rows of a table that is sent to every task.
SENT_ROWS = 200_000


def sendable(df: DataFrame, name: str) -> DataFrame:
    """A table with a row a feature, to be joined by feature: saved, and sent to every task if it has up to SENT_ROWS rows.

    Without this Spark doesn't know how small it is and gathers all rows of a feature in one task. A larger table is
    joined as Spark likes; then no feature is a large share of the rows, but for those that adaptive execution splits.
    """
    df = saved(df, name)
    return F.broadcast(df) if df.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


class Rolling:
    """The newest of a series of saved tables: each replaces the one that it was made from, which is deleted."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def save(self, df: DataFrame) -> DataFrame:
        path = _saved_path(self.spark, self.name)
        df.write.parquet(path)
        self.close()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self.path:
            delete(self.spark, self.path)
            self.path = None
