"""What the training-data operators share: scratch tables, row keys, running sums and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Column by which a row is found again whatever its id; ``keyed`` adds it.
ROW = "_row"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session in local mode may go without that setting: it gets a
    temporary folder.  On a cluster a missing setting is an error, since
    executors would write where nobody else reads.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = sc._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="passagekit-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[list[tuple[SparkSession, str]]] = []


def fresh(spark: SparkSession, label: str) -> str:
    """A folder name not used before in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    folder, system = _folder(spark, path)
    system.deleteOnExit(folder)
    return path


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes a query's shuffle files when the query ends: for queries that run once."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def cut(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage, so a lost executor costs a re-read and not a
    re-computation of what came before, and the shuffle files behind it are
    deleted at once instead of whenever the driver's garbage goes.  The table is deleted when the session
    ends, or at the end of a ``scratch`` block around the call unless ``keep``.
    """
    spark = df.sparkSession
    path = fresh(spark, label)
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    if _written and not keep:
        _written[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``cut`` writes inside the block are deleted at its end: for results that are written elsewhere by then."""
    _written.append([])
    try:
        yield
    finally:
        for spark, path in _written.pop():
            _delete(spark, path)


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    folder, system = _folder(spark, path)
    system.delete(folder, True)


def release(df: DataFrame) -> None:
    """Delete the table that ``cut`` wrote for ``df``, once nothing to come reads it."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rsplit("/", 1)[0])


#: 64-bit words of the sketch of ``likely``.
_WORDS = 1 << 18


def likely(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """``rows`` with ``_likely``: false only where ``key`` is not one of those of ``found``.

    A sketch of fixed size, one bit for each key's hash, is sent to all tasks,
    so rows with long texts are shuffled only where a join may find them.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(_WORDS * 64))
    marked = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = found.select(bit.alias("_bit")).groupBy(F.expr("shiftright(_bit, 6)").alias("_word")).agg(F.bit_or(marked).alias("_bits"))
    met = rows.withColumn("_bit", bit).join(F.broadcast(words), F.expr("shiftright(_bit, 6)") == F.col("_word"), "left")
    return met.withColumn("_likely", F.coalesce(F.col("_bits").bitwiseAND(marked) != 0, F.lit(False))).drop("_bit", "_word", "_bits")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs``, written once with a number for every row, so that a decision about a row finds it again."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


#: 2**63: row numbers are below it.
_WIDE = "cast('9223372036854775808' as decimal(19,0))"


def place(id_: Column, null: int) -> Column:
    """One number that orders rows of ``keyed`` by their id, ``null`` for none, and then by their number."""
    return (F.coalesce(id_.cast("long"), F.lit(null)).cast("decimal(19,0)") * F.expr(_WIDE) + F.col(ROW)).cast("decimal(38,0)")


def row_of(place_: Column) -> Column:
    """The row number in a ``place``."""
    return F.pmod(place_, F.expr(_WIDE)).cast("long")


def running_before(rows: DataFrame, group: list[str], levels: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` over the rows of the same group that come before.

    Rows are in order of ``levels`` (none of them null), then of ``order``.
    Windows go over the rows of one smallest part, and then over the parts'
    own sums level by level, so none holds a whole group.
    """
    inside = W.partitionBy(*group, *levels).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    sums = rows.groupBy(*group, *levels).agg(F.sum(amount).alias("_sum"))
    parts, offsets = [sums], None
    for depth in range(len(levels) - 1, 0, -1):
        parts.insert(0, parts[0].groupBy(*group, *levels[:depth]).agg(F.sum("_sum").alias("_sum")))
    for depth, part in enumerate(parts, 1):
        before = W.partitionBy(*group, *levels[: depth - 1]).orderBy(levels[depth - 1]).rowsBetween(W.unboundedPreceding, -1)
        part = part.select(*group, *levels[:depth], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
        if offsets is not None:
            part = part.join(offsets, [*group, *levels[: depth - 1]]).withColumn("_before", F.col("_before") + F.col("_above")).drop("_above")
        offsets = part.withColumnRenamed("_before", "_above")
    return rows.join(offsets, [*group, *levels]).withColumn(out, (F.col("_own") + F.col("_above")).cast("long")).drop("_own", "_above")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
