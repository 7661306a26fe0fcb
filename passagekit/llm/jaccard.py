"""Near-deduplication by SimHash links, checked and completed by the Jaccard similarity of word shingles.

SimHash links of few bits are candidates that a Jaccard test confirms.  No
radius that can be searched holds all pairs of a similarity of 0.8 (their
fingerprints differ in ten bits on average), so the rest is found by prefixes:
two sets that are similar enough share a shingle among the first few of each
in any fixed order, so documents meet by those alone.  The order puts rare
shingles first, by a counting sketch of fixed size, which changes the work and
not the result.  Shingles of the same documents are one group.  In a group a
few pivots a round meet all members of other components and retire, until the
rest is one component: a large group of near copies costs about a row a member.

Unlike pairs end inside the join where they meet, before they are rows: every
set has a bit map of about its own size in which each shingle flips one bit,
and bits that differ are shingles that differ.  A pair is tested only in the
first group that both are in.  Then both sets' shingles counted in a few cells
of the hash range bound what they can have in common, and whole sets are
compared for the rest alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, cut, keyed, likely, place, release
from .components import components
from .simhash import majority, near_links, signed

SHINGLE, TENTHS = 5, 8
#: Counters of the sketch.
COUNTERS = 1 << 18
#: Shingles that a cell of a set's counts holds on average, at most, and the fewest cells.
CELL, LEAST_CELLS = 8, 32
#: Components of a group that meet all others in the first round, and how many times as many in each next one.
PIVOTS, GROWTH = 4, 16
#: 64-bit words of a set's bit map, at most: longer maps would only spare longer sets their cell counts.
MOST_WORDS = 64


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words than a shingle: of all of them; no words: none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + own[j : len(own) - k + 1 + j]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


def _digest(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def cell_counts(hashes: np.ndarray) -> bytes | None:
    """How many hashes lie in each of the equal cells of the hash range; null if a count does not fit a byte."""
    bits = max(LEAST_CELLS.bit_length() - 1, (max(len(hashes), 1) // CELL).bit_length())
    counts = np.bincount((hashes.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def map_words(n: int) -> int:
    """Words of the bit map of ``n`` shingles: a power of two, with one to two bits a shingle up to ``MOST_WORDS``."""
    return min(1 << max(0, (n - 1) >> 6).bit_length(), MOST_WORDS)


def bit_map(hashes: np.ndarray, words: int) -> np.ndarray:
    """Bits that an odd number of the hashes fall on: where two maps differ, one set has a hash that the other lacks."""
    odd = np.bincount(hashes & (64 * words - 1), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _counts(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for text in batch.column(1):
                np.add.at(total, shingles(text.as_py(), shingle) & (COUNTERS - 1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["counter", "n"])

    return run


def _prepared(shingle: int, tenths: int, level: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, prints, sizes, cells, firsts, maps, wides = [], [], [], [], [], [], []
            for text in batch.column(1):
                hashes = shingles(text.as_py(), shingle)
                n = len(hashes)
                order = np.lexsort((hashes, level[hashes & (COUNTERS - 1)]))
                digests.append(_digest(hashes))
                prints.append(signed(majority(hashes.view(np.uint64)), n))
                sizes.append(n)
                cells.append(cell_counts(hashes))
                firsts.append(hashes[order[: n + (-n * tenths // 10) + 1 if n else 0]])
                words, wider = map_words(n), map_words(10 * n // tenths)
                maps.append(bit_map(hashes, words))
                wides.append(bit_map(hashes, wider) if wider > words else None)  # for the larger sets that it can be alike
            columns = [pa.array(digests, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(cells, pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in (firsts, maps, wides))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "digest", "print", "size", "cells", "prefix", "map", "wide"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = [shingles(t.as_py(), shingle) for t in batch.column(1).slice(start, 256)]
                yield pa.RecordBatch.from_arrays([pa.array(map(_digest, found), pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["digest", "hashes"])

    return run


def overlaps(left: list[bytes | None], right: list[bytes | None]) -> np.ndarray:
    """The most that each two sets can have in common, by their cell counts."""
    out, shapes = np.full(len(left), np.iinfo(np.int32).max, np.int64), {}
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if x is not None and y is not None:
            shapes.setdefault((len(x), len(y)), []).append(k)
    for (x, y), at in shapes.items():
        both = []
        for side, size in ((left, x), (right, y)):
            counts = np.frombuffer(b"".join(side[k] for k in at), np.uint8).reshape(len(at), size).astype(np.int32)
            both.append(counts.reshape(len(at), min(x, y), -1).sum(2))
        out[at] = np.minimum(*both).sum(1)
    return out


def _possible(tenths: int):
    """Pairs (a, b, n, m, x, y) that their sizes n, m and cell counts x, y do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy().astype(np.int64) for k in (2, 3))
            most = overlaps(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            fits = pa.array((10 + tenths) * most >= tenths * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fits), batch.column(1).filter(fits)], ["a", "b"])

    return run


class _Test:
    """Tests of pairs of digests (a, b): by cell counts, then by whole sets."""

    def __init__(self, rows: DataFrame, own: DataFrame, shingle: int, tenths: int):
        self.rows, self.shingle, self.tenths, self.links = rows, shingle, tenths, []
        self.own = own.select("doc_id", "digest")
        self.about = own.select("digest", "size", "cells").dropDuplicates(["digest"])

    def __call__(self, pairs: DataFrame) -> bool:
        """Test new ``pairs``; whether there are new links among them."""
        side = lambda c, n, x: self.about.select(F.col("digest").alias(c), F.col("size").alias(n), F.col("cells").alias(x))
        met = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")
        met = met.mapInArrow(_possible(self.tenths), "a long, b long")
        met = cut(met, "possible")
        wanted = cut(met.select(F.col("a").alias("digest")).unionByName(met.select(F.col("b").alias("digest"))).distinct(), "wanted")
        if wanted.isEmpty():
            return False
        one = self.own.join(wanted, "digest").groupBy("digest").agg(F.min("doc_id").alias("id"))
        ids = cut(one, "wanted-ids")
        texts = likely(self.rows, "doc_id", ids.select(F.col("id").alias("doc_id"))).filter("_likely").drop("_likely").join(ids, F.col("doc_id") == F.col("id"), "left_semi")
        stored = cut(texts.mapInArrow(_sets(self.shingle), "digest long, hashes array<long>"), "sets")
        sets = stored.dropDuplicates(["digest"])
        left, right = (sets.select(F.col("digest").alias(c), F.col("hashes").alias(x)) for c, x in (("a", "x"), ("b", "y")))
        both = met.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("common"))
        links = cut(both.filter((10 + self.tenths) * F.col("common") >= self.tenths * (F.col("n") + F.col("m"))).select("a", "b"), "similar")
        for table in (met, wanted, ids, stored):
            release(table)
        if links.isEmpty():
            return False
        self.links.append(links)
        return True

    def components(self) -> DataFrame:
        """(digest, component) of digests with links."""
        return cut(components(reduce(DataFrame.unionByName, self.links)).withColumnRenamed("vertex", "digest"), "components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tenths: int = TENTHS) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``.

    component_id is the smallest id reachable by pairs of texts whose shingle
    sets have a Jaccard similarity of ``tenths`` / 10 or more, itself included.
    Equal sets are one vertex, and so are texts without words; ids must not
    repeat under different texts (``dedup`` numbers the rows); an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = rows.mapInArrow(_counts(shingle), "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(COUNTERS, np.int8)  # COUNTERS numbers at most, whatever the data
    level[counted["counter"].to_numpy()] = np.log2(counted["n"].to_numpy()).astype(np.int8)
    shape = "doc_id long, digest long, print long, size int, cells binary, prefix array<long>, map array<long>, wide array<long>"
    own = cut(rows.mapInArrow(_prepared(shingle, tenths, level), shape), "prepared")
    test = _Test(rows, own, shingle, tenths)
    groups = None

    # SimHash links: vertices are fingerprints, and each stands for the least digest that has it
    prints = own.filter("size > 0").groupBy("print").agg(F.min("digest").alias("id"))
    alike = own.filter("size > 0").select("print", "digest").distinct().join(prints, "print").filter(F.col("digest") != F.col("id"))
    near = near_links(prints).unionByName(alike.select(F.col("id").alias("a"), F.col("digest").alias("b")))
    if test(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()):
        groups = test.components()

    # a group is named by its documents: shingles of the same documents are one
    tokens = own.select("digest", F.explode("prefix").alias("token"))
    group = W.partitionBy("token")
    named = tokens.select("digest", *[f("digest").over(group).alias(c) for c, f in (("low", F.min), ("high", F.max))], F.bit_xor(F.xxhash64("digest")).over(group).alias("token"))
    members = cut(named.filter("low <> high").select("token", "digest").distinct(), "members")
    # and its maps have one width: a set that may be alike larger ones is in their groups too
    widths = own.select("digest", "size", F.explode(F.array("map", "wide")).alias("map")).filter("map is not null").dropDuplicates(["digest", "map"])
    members_of = members.join(widths.withColumn("width", F.size("map")), "digest").withColumn("token", F.xxhash64("token", "width"))
    before = F.lag("token").over(W.partitionBy("digest", "width").orderBy("token"))
    active = cut(members_of.withColumn("before", before).drop("width"), "active")
    release(members)
    held = [active]

    def with_components(active: DataFrame) -> DataFrame:
        if groups is None:
            return active.withColumn("comp", F.col("digest"))
        return active.join(groups, "digest", "left").withColumn("comp", F.coalesce("component", "digest")).drop("component")

    pivots = PIVOTS
    while True:
        placed = with_components(active)
        mixed = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token")
        placed = cut(placed.join(mixed, "token", "left_semi"), "placed")
        for table in held:
            release(table)
        if placed.isEmpty():
            break
        # the members with the least hashes of so many parts of a group, by component: no order over a whole group
        part = F.pmod(F.xxhash64("comp", F.lit(pivots)), F.lit(pivots))
        about = ["digest", "size", "map", "before", "comp"]
        chosen = placed.groupBy("token", part.alias("part")).agg(F.min_by(F.struct(*about), F.xxhash64("digest", F.lit(pivots))).alias("p"))
        chosen = cut(chosen.select("token", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in about]), "pivots")
        held = [placed, chosen]
        both = F.col("size") + F.col("pivot_size")
        differ = F.aggregate(F.zip_with("map", "pivot_map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        fits = (10 * F.least("size", "pivot_size") >= tenths * F.greatest("size", "pivot_size")) & ((10 + tenths) * (both - differ) >= 2 * tenths * both)
        first = F.coalesce(F.col("before") != F.col("pivot_before"), F.lit(True))
        pairs = placed.join(chosen, "token").filter((F.col("comp") != F.col("pivot_comp")) & first & fits)
        if test(pairs.select(F.least("digest", "pivot_digest").alias("a"), F.greatest("digest", "pivot_digest").alias("b")).distinct()):
            groups = test.components()
        active = placed.join(chosen.select("token", F.col("pivot_digest").alias("digest")), ["token", "digest"], "left_anti").drop("comp")
        pivots *= GROWTH

    named = own.select("doc_id", "digest", F.col("digest").alias("comp"))
    if groups is not None:
        named = own.select("doc_id", "digest").join(groups, "digest", "left").select("doc_id", F.coalesce("component", "digest").alias("comp"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "comp").select("doc_id", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, tenths: int = TENTHS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group of near copies one row, that with the smallest id.

    Rows are told apart by a number of their own: repeated ids are rows like
    others, and a null id comes after all others of its group.  Texts without
    words are one group.
    """
    rows = keyed(docs)
    groups = near_groups(rows, ROW, text_col, shingle, tenths).select(F.col("doc_id").alias(ROW), "component_id")
    placed = rows.select(place(F.col(id_col), (1 << 63) - 1).alias("place"), ROW).join(groups, ROW)
    first = placed.groupBy("component_id").agg(F.min("place").alias("first"))
    gone = cut(placed.join(first, "component_id").filter("place <> first").select(ROW), "gone")
    flagged = likely(rows, ROW, gone)
    stay = flagged.filter("not _likely").unionByName(flagged.filter("_likely").join(gone, ROW, "left_anti"))
    return stay.select(docs.columns)
