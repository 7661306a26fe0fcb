"""Resharding by minimum-cost flow.

The old shards' sizes and the new shards' capacities make a transport
problem over shards only, of bounded size: bytes that stay cost nothing,
bytes that move cost their edge.  The solved flow says how many bytes each
shard sends to each other one; documents are then taken in blocks by running
sizes, and only files of shards that gain or lose rows need rewriting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, cut, documents, keyed, running_before

#: Documents of one block, about, in which running sizes are summed.
BLOCK_ROWS = 256


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Flows (i, j) that bring ``supply`` to ``demand`` at least cost; the sums must agree.

    Successive shortest paths with Bellman-Ford: shards are few, so the graph
    is small whatever the data.
    """
    n, m = len(supply), len(demand)
    left, need, flow = list(supply), list(demand), {}
    while any(left):
        dist = [0 if left[i] else None for i in range(n)] + [None] * m
        back = [-1] * (n + m)
        for _ in range(n + m):
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] is not None and (dist[n + j] is None or dist[i] + cost[i][j] < dist[n + j]):
                        dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow.get((i, j)) and dist[n + j] is not None and (dist[i] is None or dist[n + j] - cost[i][j] < dist[i]):
                        dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
            if not changed:
                break
        sink = min((j for j in range(m) if need[j] and dist[n + j] is not None), key=lambda j: dist[n + j])
        path, at = [], n + sink
        while back[at] >= 0:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at], need[sink], *(flow[b, a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a, b - n] = flow.get((a, b - n), 0) + amount
            else:
                flow[b, a - n] -= amount
        left[at] -= amount
        need[sink] -= amount
    return {k: v for k, v in flow.items() if v}


def _running(rows: DataFrame, major: Column, blocks: int, amount: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``amount`` before each row of its shard, in order of (major, block, key).

    ``blocks`` are those of the whole table, so a shard that holds a third of
    it has a third of their rows; blocks are summed in groups of about the
    root of their number.
    """
    block = F.pmod("key", F.lit(blocks)).cast("long")
    rows = rows.withColumn("_major", major).withColumn("_block", block).withColumn("_amount", amount)
    rows = rows.withColumn("_high", F.floor(F.col("_block") / max(1, math.isqrt(blocks))).cast("long"))
    ties = [c for c in (ROW,) if c in rows.columns]
    return running_before(rows, ["shard"], ["_major", "_high", "_block"], ["key", "doc_id", "size", "crc", *ties], "_amount", out).drop("_major", "_high", "_block", "_amount")


def _flows(rows: DataFrame, shards: int, capacity: list[int], cost: list[list[int]] | None) -> dict[tuple[int, int], int]:
    sizes = [0] * shards
    for s, n in rows.groupBy("shard").agg(F.sum("size")).collect():  # one row a shard
        sizes[s] = n
    cost = cost or [[int(i != j) for j in range(shards)] for i in range(shards)]
    flows = min_cost_flow(sizes, capacity, cost)
    return {k: v for k, v in flows.items() if k[0] != k[1]}


def _moved(rows: DataFrame, flows: dict[tuple[int, int], int], at: str, whole: bool = True) -> DataFrame:
    """Rows whose size (``whole``) or start lies inside one transfer's part of their shard's running sizes change shard."""
    to = F.col("shard")
    for i in {i for i, _ in flows}:
        low = 0
        for j in sorted(j for a, j in flows if a == i):
            high = low + flows[i, j]
            end = F.col(at) + (F.col("size") if whole else F.lit(1))
            to = F.when((F.col("shard") == i) & (F.col(at) >= low) & (end <= high), j).otherwise(to)
            low = high
    return rows.withColumn("shard", to.cast("int")).drop(at)


def reshard(
    docs: DataFrame,
    old_shard: Column,
    shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: list[int] | None = None,
    cost: list[list[int]] | None = None,
) -> DataFrame:
    """(doc_id, size, crc, old_shard, shard, slot) of every row of ``docs``.

    size: UTF-8 bytes of the text (null: none) plus 1.  Capacities share the
    bytes by ``weights`` (default: evenly).  Rows that no flow names stay in
    their old shard.  The first pass moves whole documents in hash order and
    leaves what straddles a boundary; the second fills the remainders with the
    smallest documents, so sizes end near their capacities; a shard without
    weight ends empty.  The law is of bytes alone: equal texts may lie in
    different shards.  Slots count from
    0 in each shard without gaps.  Null ids and repeated rows are placed like
    others; a null old shard counts as 0; an empty table gives no rows.  The
    row numbers of ``keyed`` are passed on.
    """
    row = [c for c in (ROW,) if c in docs.columns]
    text = F.coalesce(F.col(text_col), F.lit(""))
    old = F.coalesce(old_shard, F.lit(0)).cast("int")
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("crc"),
            old.alias("old_shard"),
            old.alias("shard"),
            F.xxhash64(F.col(id_col)).alias("key"),
            *row,
        ),
        "sizes",
    )
    total, count, olds = rows.agg(F.sum("size"), F.count("*"), F.max("old_shard")).first()
    if not count:
        return rows.select("doc_id", "size", "crc", "old_shard", "shard", F.lit(0).cast("long").alias("slot"), *row)
    weights, n = weights or [1] * shards, max(shards, olds + 1)
    weights = weights + [0] * (n - shards)  # old shards beyond the new ones are emptied
    ends = [total * sum(weights[: i + 1]) // sum(weights) for i in range(n)]
    capacity = [b - a for a, b in zip([0, *ends], ends)]
    blocks = max(1, count // BLOCK_ROWS)
    for major, label in ((F.lit(0), "moved"), (F.floor(F.log2("size")).cast("int"), "filled")):
        flows = _flows(rows, n, capacity, cost)
        if flows:
            rows = cut(_moved(_running(rows, major, blocks, F.col("size"), "at"), flows, "at"), label)
    if 0 in weights:  # what straddles a boundary must leave a shard that is given up, too
        flows = {k: v for k, v in _flows(rows, n, capacity, cost).items() if not weights[k[0]]}
        if flows:
            rows = cut(_moved(_running(rows, F.lit(0), blocks, F.col("size"), "at"), flows, "at", whole=False), "emptied")
    slots = _running(rows, F.lit(0), blocks, F.lit(1).cast("long"), "slot")
    return slots.select("doc_id", "size", "crc", "old_shard", "shard", F.col("slot").cast("long").alias("slot"), *row)


def rewrite(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Write the files of the shards that gain or lose rows under ``path``/shard=N; gives the plan's affected shards.

    Shards that nothing enters or leaves are not read and keep their files;
    the folder of a shard that ends empty is deleted.  Rows are found by the
    number of ``keyed``; without it ids must be there and unique.
    """
    if (ROW in docs.columns) != (ROW in plan.columns):
        raise ValueError("the plan and the documents must both come from keyed()")
    moves = plan.filter(F.col("shard") != F.col("old_shard"))
    affected = moves.select("shard").unionByName(moves.select(F.col("old_shard").alias("shard"))).distinct()
    placed = plan.join(affected, "shard", "left_semi")
    if ROW in plan.columns:
        key, placed = ROW, placed.select(ROW, "shard", "slot")
    else:
        if not plan.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
            raise ValueError("null or repeated ids: plan and rewrite the documents of keyed()")
        key, placed = id_col, placed.select(F.col("doc_id").alias(id_col), "shard", "slot")
    out = docs.join(placed, key).drop(ROW).repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path))
    emptied = affected.join(plan.select("shard").distinct(), "shard", "left_anti")
    for r in emptied.collect():  # at most one row a shard
        folder = docs.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={r.shard}")
        folder.getFileSystem(docs.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return affected


#: The old layout of the query: so many shards, by source.
OLD_SHARDS, NEW_SHARDS = 6, 8


def op10_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``bytes``: sizes near equal.  Six shards by source become eight."""
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    plan = reshard(documents(spark, sf_dir), old, NEW_SHARDS)
    return plan.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )
