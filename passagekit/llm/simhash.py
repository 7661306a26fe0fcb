"""SimHash near-deduplication by bit-sliced comparison.

Fingerprints are cut into parts; two that differ in at most ``radius`` bits
agree on all but ``radius`` parts, so each is filed under every choice of the
other parts.  Buckets of any size lie one after another in vertical bit
planes: one query is compared with 64 fingerprints of its bucket per machine
word, distances are carry-save counters held in bitwise planes, and a block
of 64 is abandoned once all its counters have overflowed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents
from .components import components

RADIUS, PARTS, SHINGLE, SEED = 2, 4, 3, 42
#: Rows of one block; a larger bucket is compared block against block.
BLOCK = 2048
#: Blocks of 64 fingerprints that one pass of the comparison holds counters for.
PASS = 1 << 15


def majority(hashes: np.ndarray) -> np.ndarray:
    """In how many of ``hashes`` (unsigned 64-bit) each bit is set, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def signed(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes, as a signed integer: bits set in over half of them."""
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text as a signed integer; no words: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    digest, counts, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 16384):  # a very long text in pieces: memory stays bounded
        s, e = starts[at : min(at + 16384, n)].tolist(), ends[k - 1 + at : k - 1 + min(at + 16384, n)].tolist()
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(s, e, strict=True)])
        counts += majority(np.frombuffer(raw, ">u8"))
    return signed(counts, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [fingerprint(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "print"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print) of every row; null and wordless texts have print 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, print long")


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 to a word, padded with zeros."""
    words = -(-len(prints) // 64)
    bits = np.zeros((64, words * 64), np.uint8)
    bits[:, : len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _lanes(n: np.ndarray) -> np.ndarray:
    """Words whose lowest ``n`` bits (0 to 64) are set."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))


def near(queries: np.ndarray, prints: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, print) of all pairs at most ``radius`` bits apart, the print at ``first`` or later and before ``last`` of its query.

    The counters start at 2**bits - (radius + 1), so the carry out of the top
    plane marks a distance beyond the radius, for good.
    """
    store, bits = planes(prints), (radius + 1).bit_length()
    if radius + 1 == 1 << (bits - 1):
        bits -= 1
    start, full, found = (1 << bits) - (radius + 1), ~np.uint64(0), []
    words = np.where(last > first, (last + 63) // 64 - first // 64, 0)
    ends = np.cumsum(words)
    for at in range(0, int(ends[-1]) if len(ends) else 0, PASS):
        block = np.arange(at, min(at + PASS, int(ends[-1])))
        query = np.searchsorted(ends, block, side="right")
        word = block - (ends[query] - words[query]) + first[query] // 64
        over = ~(_lanes(last[query] - 64 * word) & ~_lanes(first[query] - 64 * word))
        counters = [np.full(len(block), full if start >> i & 1 else 0, np.uint64) for i in range(bits)]
        value = queries[query]
        for b in range(64):
            carry = store[b][word] ^ (np.uint64(0) - (value >> np.uint64(b) & np.uint64(1)))
            for i in range(bits):
                counters[i], carry = counters[i] ^ carry, counters[i] & carry
            over |= carry
            if b % 8 == 7:
                alive = over != full
                if not alive.all():
                    query, word, value, over, counters = query[alive], word[alive], value[alive], over[alive], [c[alive] for c in counters]
                if not len(query):
                    break
        if len(query):
            q, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), bitorder="little").reshape(-1, 64))
            found.append((query[q], word[q] * 64 + lane))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that join two trees: the same components from fewer rows."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _compare(radius: int):
    """Links inside groups of rows sorted by (band, key, i, j, second)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            change = np.flatnonzero(np.any([np.diff(c) != 0 for c in held[:4]], axis=0))
            if len(change):
                end = change[-1] + 1
                yield out([c[:end] for c in held])
                held = [c[end:] for c in held]
        if held is not None and len(held[0]):
            yield out(held)

    def out(cols: list[np.ndarray]) -> pa.RecordBatch:
        _, _, i, j, second, prints, ids = cols
        prints = prints.astype(np.int64).view(np.uint64)
        starts = np.flatnonzero(np.r_[True, np.any([np.diff(c) != 0 for c in cols[:4]], axis=0)])
        sizes = np.diff(np.r_[starts, len(ids)])
        end = np.repeat(starts + sizes, sizes)
        middle = np.repeat(starts + np.add.reduceat(1 - second, starts), sizes)  # where a group's second block begins
        at = np.arange(len(ids))
        # inside one block every later row; of two blocks the second one's rows
        first = np.where(i == j, at + 1, np.where(second == 0, middle, end))
        q, p = near(prints, prints, first, end, radius)
        a, b = ids[q], ids[p]
        kept = _forest(a, b)
        return pa.RecordBatch.from_arrays([pa.array(a[kept], pa.int64()), pa.array(b[kept], pa.int64())], ["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints (print, id) within ``radius`` bits; ids are not null.

    Buckets give a spanning forest of their links, not all pairs.  The
    largest group a task holds is two blocks; a larger bucket's blocks meet
    pairwise in different tasks.
    """
    width = 64 // parts
    keys = []
    for band, kept in enumerate(combinations(range(parts), parts - radius)):
        mask = sum(((1 << (64 if p == parts - 1 else (p + 1) * width)) - (1 << (p * width))) for p in kept)
        keys.append((band, mask - (1 << 64) if mask >> 63 else mask))
    filed = prints.select(
        "print",
        "id",
        F.explode(
            F.array(*[F.struct(F.lit(b).alias("band"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key")) for b, m in keys])
        ).alias("at"),
    ).select("print", "id", "at.band", "at.key")
    sizes = filed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    full = filed.join(sizes, ["band", "key"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    full = full.withColumn("own", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    dealt = full.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "band",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("second"),
        "print",
        "id",
    )
    grouped = dealt.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "second")
    return grouped.mapInArrow(_compare(radius), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """(doc_id, print, component_id) of every row of ``docs``.

    component_id is the smallest id reachable by links of at most ``radius``
    bits, itself included.  Equal fingerprints are one vertex, named by the
    fingerprint itself, so copies cost one row and ids of any size stay exact.
    Null and wordless texts have print 0 and link like others; rows that
    repeat an id are compared singly.  Rows with a null id link and connect
    like others, but a null id is never the smallest: a group of such rows
    alone has a null component_id.  An empty table gives no rows.
    """
    own = cut(fingerprints(docs, id_col, text_col), "prints")
    classes = own.groupBy("print").agg(F.min("doc_id").alias("least"))
    groups = components(near_links(classes.select("print", F.col("print").alias("id")), radius, parts))
    placed = classes.join(groups, classes["print"] == groups["vertex"], "left").select("print", "least", F.coalesce("component", "print").alias("group"))
    named = placed.select("print", "group").join(placed.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    return own.join(named, "print").select("doc_id", "print", "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
