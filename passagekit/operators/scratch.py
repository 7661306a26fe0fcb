"""Tables that an operator writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: items of a table of which every executor may get a copy.
FEW = 200_000


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: what follows starts from files, not from all steps before.

    ``by``: a column that divides the table into folders, for readers of one
    value.  The table is deleted when the session ends, or by ``release``.
    Only a session in local mode may go without ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="passagekit-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/step-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def by_size(df: DataFrame, items: Column | None = None) -> DataFrame:
    """``df`` written, and told to joins by what it really holds: copied to every executor while it has few rows (or ``items``), else merged.

    Spark's own guess stems from the files that rows were read from, however
    often they were multiplied since, and would send large tables through the driver.
    """
    table = written(df)
    n = table.agg(F.sum(items if items is not None else F.lit(1))).first()[0] or 0
    return F.broadcast(table) if n <= FEW else table.hint("merge")


def release(df: DataFrame) -> None:
    """Delete the table that ``written`` made for ``df``, once nothing to come reads it."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
