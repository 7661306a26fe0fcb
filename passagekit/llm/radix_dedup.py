"""Exact deduplication by distributed most-significant-digit radix partitioning.

A group starts as all texts.  Each level splits every open group by its next
bytes: the digit.  A group of one row is finished, and so is a group whose
texts end inside the digit: its rows have gone through the same bytes from
first to last, so they are equal without any digest.  Only the open groups'
remaining bytes go on, and digits grow by a factor, so the number of levels
is the logarithm of the longest shared prefix.  Digits of a fixed width would
take one job for every width of the longest repeated text (thousands for a
text of a megabyte); a grown digit is long only for texts that agree with
another one in all bytes before it, and those bytes must be compared anyway.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, ascii_lower, cut, documents, keyed, place, row_of

#: Bytes of the first digit, and how many times longer each next one is.
FIRST_DIGIT, GROWTH = 128, 16


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict[str, Callable[[Column], Column]] | None = None,
    first_digit: int = FIRST_DIGIT,
    growth: int = GROWTH,
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept) of every row of ``docs``, and what ``carry`` makes of each compared text.

    Texts are compared with A-Z lower-cased; a null text counts as empty.  Of
    equal texts the largest id stays.  Rows that repeat an id and its text
    count singly in group_size and share one fate; a null id stays only if
    its whole group has null ids.  An empty table gives no rows.
    """
    carry = carry or {}
    raw = F.coalesce(F.col(text_col), F.lit(""))
    text, start = ascii_lower(raw), ascii_lower(F.substring(raw, 1, first_digit))
    level = docs.select(
        F.col(id_col).alias("doc_id"),
        *[make(text).alias(name) for name, make in carry.items()],
        F.lit(0).cast("long").alias("node"),
        F.substring(start.cast("binary"), 1, first_digit).alias("digit"),
        text.cast("binary").alias("rest"),
    )
    width, done = first_digit, []
    while True:
        shared = (
            level.groupBy("node", "digit")
            .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
            .filter("n > 1")
            .withColumn("next", F.monotonically_increasing_id())
            .withColumn("open", F.length("digit") == width)
        )
        shared = cut(shared, "radix-nodes")
        # nodes grow with the documents: both sides are shuffled at every size
        split = level.drop("rest").join(shared.hint("merge"), ["node", "digit"], "left").filter("open is null or not open")
        done.append(
            split.select(
                "doc_id",
                F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                *carry,
            )
        )
        if not shared.agg(F.count_if("open")).first()[0]:
            break
        open_ = level.join(shared.filter("open").select("node", "digit", "next").hint("merge"), ["node", "digit"])
        rest = F.expr(f"substring(rest, {width + 1})")
        width *= growth
        level = cut(open_.select("doc_id", *carry, F.col("next").alias("node"), rest.alias("rest")), "radix-open")
        level = level.withColumn("digit", F.substring("rest", 1, width))
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *carry)


#: Below every id: where null ids come in the order of rows.
_LEAST = -(1 << 63)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts one row, that with the largest id.

    Rows are told apart by a number of their own, so ids may repeat, under
    equal texts and under others, and may be null; of rows that repeat an id
    and its text one stays.  A null id stays where no other has its text.
    """
    rows = keyed(docs)
    placed = rows.select(place(F.col(id_col), _LEAST).alias("place"), F.col(text_col).alias("text"))
    gone = exact_groups(placed, "place", "text").filter(~F.col("kept")).select(row_of(F.col("doc_id")).alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), carry={"text_sha256": lambda text: F.sha2(text, 256)})


OP3_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
