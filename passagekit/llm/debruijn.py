"""Substring deduplication by De Bruijn compaction.

Windows of consecutive words are the edges of a graph whose nodes are the
words that a window shares with the next one.  Only repeated edges enter it:
windows are sieved by their minimizer, the least hash of the shorter k-mers
inside, so an unrepeated minimizer rules out all of its windows before any of
them is shuffled.  Every repeated edge knows its first occurrence.  Nodes with
one edge in and one out do not branch; edges that follow one another through
such nodes are compacted to paths, first along the documents of their first
occurrences, then by joins at the nodes with doubling pointers.  A document's
later occurrences become runs along paths, and the words at both ends of a
run's source coordinates are compared by digest before any word is removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents, release

#: Words of a window, and of the k-mers that minimizers are chosen from.
WINDOW, KMER = 20, 6
#: Bytes of text taken together by one step of a task.
CHUNK = 2 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, _U), np.ones(1, _U)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.concatenate([np.ones(1, _U), np.cumprod(np.full(n, b, _U))]) for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.up, self.down


_BYTES, _WORDS, _OTHER = Powers(0x9E3779B97F4A7C15), Powers(0xD1342543DE82EF95), Powers(0xC2B2AE3D27D4EB4F)


def _sums(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hashes of x[start:end] from one running sum."""
    up, down = powers(len(x) + 1)
    run = np.concatenate([np.zeros(1, _U), np.cumsum(x * up[: len(x)], dtype=_U)])
    return (run[ends] - run[starts]) * down[starts]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word of documents that lie in ``data`` between ``offsets``."""
    hashes, owners, at, n = [], [], 0, len(data)
    while at < n:
        end = min(at + CHUNK, n)
        while end < n and not _SPACE[data[end - 1]]:  # a piece ends after a space
            end += 1
        part = data[at:end]
        space = _SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[offsets[(offsets >= at) & (offsets <= end)] - at] = True
        edge[0] = edge[-1] = True
        before, after = np.r_[True, space[:-1]] | edge[:-1], np.r_[space[1:], True] | edge[1:]
        starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
        found = _sums(_BYTE[part], starts, ends, _BYTES)
        hashes.append(_mix(found + (ends - starts).astype(_U)))
        owners.append(np.searchsorted(offsets, starts + at, side="right") - 1)
        at = end
    if not hashes:
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def grams(words: np.ndarray, owner: np.ndarray, k: int, powers: Powers = _WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the k words from each word on; not valid where a document ends before."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, bool)
    at = np.arange(n)
    return _mix(_sums(words, at, at + k, powers)), owner[:n] == owner[k - 1 :]


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """least.reduce over x[i : i + width] for every i, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(x) - width + 1], out[width - have : len(x) - have + 1]) if width > have else out


def minimizers(words: np.ndarray, owner: np.ndarray, window: int = WINDOW, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window its minimizer and whether it is valid; of every k-mer whether it is a window's minimizer."""
    kmers, whole = grams(words, owner, k)
    n, width = len(words) - window + 1, window - k + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, bool), np.zeros(len(kmers), bool)
    least = _sliding(np.where(whole, kmers, ~_U(0)), width, np.minimum)[:n]
    valid = owner[:n] == owner[window - 1 :]
    pad = np.zeros(width - 1, _U)
    top = _sliding(np.concatenate([pad, np.where(valid, least, _U(0)), pad]), width, np.maximum)
    return least, valid, whole & (kmers == top[: len(kmers)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of about CHUNK bytes of text: the rows, their bytes and the offsets of each row in these."""
    for batch in batches:
        text = batch.column(1)
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64))
        at, ends = 0, np.cumsum(sizes)
        while at < len(text):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
            part = batch.slice(at, to - at)
            texts = part.column(1)
            offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
            yield part, data, offsets - offsets[0]
            at = to


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one: they are shuffled and kept several times."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [packer.compress(t.as_buffer()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc", "packed"])


def _unpacked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same slices from packed texts in the second column."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        texts, size, at = [], 0, 0
        for i, packed in enumerate(batch.column(1)):
            texts.append(unpack(packed.as_buffer()))
            size += len(texts[-1])
            if size >= CHUNK or i == batch.num_rows - 1:
                offsets = np.cumsum([0, *map(len, texts)])
                yield batch.slice(at, len(texts)), np.frombuffer(b"".join(texts), np.uint8), offsets
                texts, size, at = [], 0, i + 1


def _words(packed: pa.Scalar) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(packed.as_buffer()).split()


def _lists(rows: int, owner: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list for each of ``rows`` rows of the values whose owner it is; owners ascend."""
    offsets = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _surveyed(window: int, k: int):
    """Per document its words, digest and minimizers, those that repeat in the chunk apart from those still to ask about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _chunks(batches):
            rows, raw = part.num_rows, data.tobytes()
            split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            digest = [hashlib.sha256(b" ".join(w)).digest() for w in split]
            sign = np.frombuffer(b"".join(d[:8] for d in digest), np.int64)
            words, owner = word_hashes(data, offsets)
            _, _, chosen = minimizers(words, owner, window, k)
            at = np.flatnonzero(chosen)
            value, doc = grams(words, owner, k)[0][at].view(np.int64), owner[at]
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.empty(0, bool)
            twice = np.r_[False, (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])] if len(value) else new
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            if len(first):
                signs = sign[doc]
                again = (np.minimum.reduceat(signs, first) != np.maximum.reduceat(signs, first)) | np.logical_or.reduceat(twice, first)
            else:
                again = np.empty(0, bool)
            known, once = again[group], ~twice
            lists = []
            for mine in (known & once, ~known & once):
                by = np.lexsort((value[mine], doc[mine]))
                lists.append(_lists(rows, doc[mine][by], value[mine][by], pa.int64()))
            nothing = pa.nulls(rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array(digest, pa.binary()), pa.array(sign), *lists, nothing],
                ["doc", "n_words", "digest", "sign", "known", "asked", "told"],
            )
            told = value[first[again]]
            if len(told):  # one row tells the other chunks that these repeat
                one = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*one, pa.array([told], pa.list_(pa.int64()))], ["doc", "n_words", "digest", "sign", "known", "asked", "told"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, h) of askers whose minimizer another text has too: columns h, doc, sign, told, sorted by h.

    A minimizer's rows are at most one for each chunk of the corpus that has
    it, and go by in a stream: what is held are askers of one sign alone.
    """
    open_, known, mark, pending = None, False, None, []
    for batch in batches:
        h, doc, sign, told = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(h):
            continue
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes, asks = np.diff(np.r_[first, len(h)]), told == 0
        low = np.minimum.reduceat(np.where(asks, sign, np.iinfo(np.int64).max), first)
        high = np.maximum.reduceat(np.where(asks, sign, np.iinfo(np.int64).min), first)
        again = (low < high) | np.logical_or.reduceat(~asks, first)
        docs, hs = [], []
        if h[0] != open_:
            known, mark, pending = False, None, []
        elif known or again[0] or (mark is not None and low[0] != mark):
            again[0] = True
            docs.append(np.array(pending, np.int64))
            hs.append(np.full(len(pending), open_, np.int64))
            pending = []
        told_now = np.repeat(again, sizes) & asks
        docs.append(doc[told_now])
        hs.append(h[told_now])
        if len(first) > 1:
            known, mark, pending = False, None, []
        open_, known = h[-1], bool(again[-1])
        if not known:
            last = slice(first[-1], len(h))
            pending.extend(doc[last][asks[last]].tolist())
            mark = low[-1] if asks[last].any() else mark
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(docs), pa.int64()), pa.array(np.concatenate(hs), pa.int64())], ["doc", "h"])


EDGES = (
    "doc long, packed binary, start array<int>, ref_doc array<long>, ref_start array<int>, length array<int>, "
    "w1 array<long>, w2 array<int>, at array<int>, n array<int>"
)


def _edges(window: int, k: int):
    """Windows with a repeated minimizer.

    Those that the chunk has earlier are runs beside their place there; the
    others are edges to ask about, each with its number in the chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _unpacked_chunks(batches):
            rows = part.num_rows
            ids = part.column(0).to_numpy()
            words, owner = word_hashes(data, offsets)
            least, valid, _ = minimizers(words, owner, window, k)
            hs = part.column(2)
            flat = hs.flatten().to_numpy().view(_U)
            lengths = np.diff(np.r_[0, np.cumsum([len(x) for x in hs])])
            salt = _mix(np.arange(rows).astype(_U) + _U(1))
            wanted = flat ^ salt[np.repeat(np.arange(rows), lengths)]
            at = np.flatnonzero(valid)
            at = at[np.isin(least[at] ^ salt[owner[at]], wanted)]
            w1 = grams(words, owner, window)[0][at].view(np.int64)
            w2 = (grams(words, owner, window, _OTHER)[0][at] >> _U(32)).astype(np.uint32).view(np.int32)
            doc = owner[at]
            start = (at - np.searchsorted(owner, doc)).astype(np.int32)
            order = np.lexsort((start, ids[doc], w2, w1))
            a1, a2 = w1[order], w2[order]
            new = np.r_[True, (a1[1:] != a1[:-1]) | (a2[1:] != a2[:-1])] if len(a1) else np.empty(0, bool)
            head = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(a1) else order
            # repeated rows of one id: the same place is not an earlier one
            later = (ids[doc[order]] != ids[doc[head]]) | (start[order] != start[head])
            sure, refs = order[later], head[later]
            by = np.lexsort((start[sure], doc[sure]))
            sure, refs = sure[by], refs[by]
            step = lambda x, d: np.r_[True, x[1:] != x[:-1] + d] if len(x) else np.empty(0, bool)
            begin = np.flatnonzero(step(doc[sure], 0) | step(start[sure], 1) | step(doc[refs], 0) | step(start[refs], 1))
            length = (np.diff(np.r_[begin, len(sure)]) + window - 1).astype(np.int32)
            sure, refs = sure[begin], refs[begin]
            heads = np.flatnonzero(new)
            count = np.diff(np.r_[heads, len(order)]).astype(np.int32)
            asked = order[heads]
            by = np.argsort(asked)
            ask, count = asked[by], count[by]
            lists = [(sure, start[sure], pa.int32()), (sure, ids[doc[refs]], pa.int64()), (sure, start[refs], pa.int32()), (sure, length, pa.int32())]
            lists += [(ask, w1[ask], pa.int64()), (ask, w2[ask], pa.int32()), (ask, start[ask], pa.int32()), (ask, count, pa.int32())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[_lists(rows, doc[i], v, t) for i, v, t in lists]], [x.split()[0] for x in EDGES.split(", ")])

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w1, w2, doc, at, first) of windows that occur twice, and whether this is the first place: columns w1, w2, doc, at, n, sorted.

    Of a window that goes on from batch to batch only its first row is held.
    """
    held, told = None, False
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        goes_on = held is not None and held[0] == cols[0][0] and held[1] == cols[1][0]
        if goes_on:
            cols = [np.concatenate([[h], c]) for h, c in zip(held, cols, strict=True)]
        w1, w2, doc, at, n = cols
        first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        sizes = np.diff(np.r_[first, len(w1)])
        twice = np.add.reduceat(n, first) > 1
        out = np.repeat(twice, sizes)
        if goes_on and told:
            out[0] = False
        head = np.repeat(first, sizes)
        columns = (w1, w2, doc, at, (doc == doc[head]) & (at == at[head]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c[out], t) for c, t in zip(columns, types, strict=True)], ["w1", "w2", "doc", "at", "first"])
        held, told = [c[first[-1]] for c in cols], bool(twice[-1])
        held[4] = max(int(held[4]), 1 + told)


def _nodes(window: int):
    """(w1, w2, ref_doc, ref_start, node, next) of edges: columns doc, packed, edges (at, w1, w2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _unpacked_chunks(batches):
            words, owner = word_hashes(data, offsets)
            nodes = grams(words, owner, window - 1)[0].view(np.int64)
            begin = np.searchsorted(owner, np.arange(part.num_rows))
            edges = part.column(2)
            rows = np.repeat(np.arange(part.num_rows), [len(x) for x in edges])
            at, w1, w2 = (edges.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            place = begin[rows] + at
            columns = (w1, w2, part.column(0).to_numpy()[rows], at, nodes[place], nodes[place + 1])
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["w1", "w2", "ref_doc", "ref_start", "node", "next"])

    return run


#: A place is one number: the document times this, plus the word.
_PLACE = 1 << 31


def graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(w1, w2, path, offset) of repeated edges (w1, w2, ref_doc, ref_start, node, next), and the paths' sources (path, base, length, ref_doc, ref_start).

    ref_doc and ref_start: where an edge occurs first; node and next: the
    nodes it leaves and enters.  Edges of one path have offsets in order;
    paths end at nodes that branch.  A source is a stretch of a path, from
    offset base on, that occurs first in one piece.
    """
    place = (F.col("ref_doc").cast("decimal(29,0)") * _PLACE + F.col("ref_start")).cast("decimal(29,0)")
    edges = cut(edges.withColumn("first", place), "graph-repeated")

    sides = edges.select("node", F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("next").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    plain = sides.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).filter("out = 1 and into = 1").select("node", F.lit(True).alias("plain"))
    plain = cut(plain, "graph-plain-nodes")
    along = W.partitionBy("ref_doc").orderBy("ref_start")
    goes_on = F.coalesce((F.lag("ref_start").over(along) + 1 == F.col("ref_start")) & F.col("plain"), F.lit(False))
    steps = edges.join(plain, "node", "left").withColumn("begins", F.when(~goes_on, F.col("first")))
    steps = steps.withColumn("piece", F.last("begins", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)))
    steps = cut(steps.select("w1", "w2", "ref_start", "piece", "node", "next"), "graph-steps")
    release(edges)

    # pieces whose end and beginning meet in a node that does not branch
    pieces = steps.groupBy("piece").agg(F.min_by("node", "ref_start").alias("node"), F.max_by("next", "ref_start").alias("next"), F.count("*").alias("length"))
    pieces = cut(pieces, "graph-pieces")
    ends = pieces.select(F.col("next").alias("node"), F.col("piece").alias("up"), F.col("length").alias("offset")).join(plain, "node").drop("plain")
    linked = cut(pieces.select("piece", "node").join(ends, "node").filter(F.col("piece") != F.col("up")).select("piece", "up", "offset"), "graph-links")
    reach, most, paths = 1, linked.count(), None
    while reach <= most:
        above = linked.select(F.col("piece").alias("up"), F.col("up").alias("upper"), F.col("offset").alias("more"))
        doubled = linked.join(above, "up", "left").select("piece", F.coalesce("upper", "up").alias("up"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"))
        linked, reach = cut(doubled, "graph-links"), reach * 2
    # a ring has no first piece: its pieces stay paths of their own
    paths = linked.join(linked.select(F.col("piece").alias("up")), "up", "left_anti").select("piece", F.col("up").alias("path"), F.col("offset").alias("base"))
    begin = F.pmod(F.col("piece"), F.lit(_PLACE)).cast("int")
    offset = (F.coalesce("base", F.lit(0)) + F.col("ref_start") - begin).cast("int")
    path = F.coalesce("path", "piece").alias("path")
    sources = pieces.join(paths, "piece", "left").select(
        path, F.coalesce("base", F.lit(0)).cast("int").alias("base"), F.col("length").cast("int").alias("length"),
        ((F.col("piece") - F.pmod(F.col("piece"), F.lit(_PLACE))) / _PLACE).cast("long").alias("ref_doc"), begin.alias("ref_start"),
    )
    return steps.join(paths, "piece", "left").select("w1", "w2", path, offset.alias("offset")), sources


#: Windows of one cell, under which stretches that may overlap meet.
CELL = 512


def _cells(low: str, high: str):
    return F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL)))


def overlaps(one: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Pairs of stretches (key, low, high) and (key, low_, high_) that have places in common, with these: (from, to); each pair once."""
    met = one.withColumn("_cell", _cells("low", "high")).join(other.withColumn("_cell", _cells("low_", "high_")), [key, "_cell"])
    met = met.withColumn("from", F.greatest("low", "low_")).withColumn("to", F.least("high", "high_"))
    return met.filter((F.col("from") <= F.col("to")) & (F.floor(F.col("from") / CELL) == F.col("_cell"))).drop("_cell")


def _span_digest(words: list[bytes], at: int, length: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[at : at + length]), digest_size=16).digest()


def _source_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ref_doc, ref_start, length, digest) of the spans asked of each source: columns ref_doc, packed, spans."""
    for batch in batches:
        for i in range(batch.num_rows):
            doc, words = batch.column(0)[i].as_py(), _words(batch.column(1)[i])
            spans = batch.column(2)[i].as_py()
            out = [(doc, s["ref_start"], s["length"], _span_digest(words, s["ref_start"], s["length"])) for s in spans]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["ref_doc", "ref_start", "length", "digest"]
            )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, n_removed, kept) of documents with verified paths: columns doc, packed, paths."""
    for batch in batches:
        docs, counts, kepts = [], [], []
        for i in range(batch.num_rows):
            words = _words(batch.column(1)[i])
            gone = np.zeros(len(words), bool)
            for p in batch.column(2)[i].as_py():
                if _span_digest(words, p["start"], p["length"]) == p["digest"]:
                    gone[p["start"] : p["start"] + p["length"]] = True
            docs.append(batch.column(0)[i].as_py())
            counts.append(int(gone.sum()))
            kepts.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode())
            if sum(map(len, kepts[-64:])) > CHUNK or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(counts, pa.int64()), pa.array(kepts, pa.string())], ["doc", "n_removed", "kept"])
                docs, counts, kepts = [], [], []


NEVER = (1 << 63) - 1


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it starts earlier
    too: in a smaller id, or in the same text before.  kept is the remaining
    words joined by spaces, null where nothing is removed; kept_sha256 is the
    SHA-256 of the remaining words in any case.  Texts of the same words as
    one of a smaller id go whole without being looked at again.  Null texts
    have no words; null ids come after all others; rows that repeat an id are
    the same document, none of them earlier; no rows give no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NEVER)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    shape = "doc long, n_words long, digest binary, sign long, known array<long>, asked array<long>, told array<long>"
    survey = cut(rows.mapInArrow(_surveyed(window, k), shape), "graph-survey")
    texts = survey.filter("told is null").select("doc", "n_words", "digest")
    # a table of the repeated digests alone: a hot one's rows can then be split in the join
    firsts = cut(texts.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "graph-firsts")
    later = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    texts = texts.join(firsts, "digest", "left").withColumn("copy", later & (F.col("n_words") >= window))
    texts = cut(texts.select("doc", "n_words", "digest", "copy"), "graph-texts")
    copies = texts.filter("copy").select("doc").distinct()

    own = survey.filter("told is null").select("doc", "sign", "known", "asked").join(copies, "doc", "left_anti")
    asked = own.select(F.explode("asked").alias("h"), "doc", "sign", F.lit(0).alias("told"))
    told = survey.filter("told is not null").select(F.explode("told").alias("h"), F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("sign"), F.lit(1).alias("told"))
    marked = asked.unionByName(told).repartition("h").sortWithinPartitions("h").mapInArrow(_repeated, "doc long, h long")
    known = own.select("doc", F.explode("known").alias("h"))
    wanted = marked.unionByName(known).groupBy("doc").agg(F.collect_list("h").alias("hs"))
    edges = cut(rows.mapInArrow(_packed, "doc long, packed binary").join(wanted, "doc").select("doc", "packed", "hs").mapInArrow(_edges(window, k), EDGES), "graph-edges")
    release(survey)

    sure = edges.select("doc", F.inline(F.arrays_zip("start", "ref_doc", "ref_start", "length")))
    open_ = edges.select("doc", F.inline(F.arrays_zip("w1", "w2", "at", "n"))).select("w1", "w2", "doc", "at", "n")
    order = ["w1", "w2", "doc", "at"]
    shape = "w1 long, w2 int, doc long, at int, first boolean"
    found = cut(open_.repartition("w1", "w2").sortWithinPartitions(*order).mapInArrow(_occurrences, shape), "graph-occurrences")
    heads = found.filter("first").groupBy("doc").agg(F.collect_set(F.struct("at", "w1", "w2")).alias("edges"))
    known_edges, sources = graph(edges.select("doc", "packed").join(heads, "doc").select("doc", "packed", "edges").mapInArrow(_nodes(window), "w1 long, w2 int, ref_doc long, ref_start int, node long, next long"))
    sources = cut(sources, "graph-sources")
    # a run: consecutive words of a document at the same distance from a path's offsets
    along = W.partitionBy("doc", "path", "shift").orderBy("at")
    runs = (
        found.join(known_edges, ["w1", "w2"])
        .select("doc", "at", "path", (F.col("at") - F.col("offset")).alias("shift"))
        .withColumn("run", F.col("at") - F.dense_rank().over(along))
        .groupBy("doc", "path", "shift", "run")
        .agg(F.min("at").alias("start"), F.max("at").alias("end"))
        .drop("run")
    )
    runs = cut(runs, "graph-runs")
    release(found)
    # windows that their chunk has before lie on the paths of those
    held = runs.select(F.col("doc").alias("ref_doc"), "path", "shift", F.col("start").alias("low_"), F.col("end").alias("high_"))
    asking = sure.select("doc", "start", "ref_doc", F.col("ref_start").alias("low"), (F.col("ref_start") + F.col("length") - window).alias("high"))
    moved = (F.col("start") - F.col("low")).alias("by")
    copied = overlaps(asking, held, "ref_doc").select("doc", "path", F.col("shift"), "from", "to", moved)
    copied = copied.select("doc", "path", (F.col("shift") + F.col("by")).alias("shift"), (F.col("from") + F.col("by")).alias("start"), (F.col("to") + F.col("by")).alias("end"))
    # offsets of paths have sources; a stretch that is its own source stays
    at = runs.unionByName(copied).select("doc", "path", "shift", (F.col("start") - F.col("shift")).alias("low"), (F.col("end") - F.col("shift")).alias("high"))
    first = sources.select("path", "base", "ref_doc", F.col("ref_start").alias("begin"), F.col("base").alias("low_"), (F.col("base") + F.col("length") - 1).alias("high_"))
    paths = overlaps(at, first, "path").select(
        "doc", (F.col("from") + F.col("shift")).cast("int").alias("start"), "ref_doc", (F.col("from") - F.col("base") + F.col("begin")).cast("int").alias("ref_start"), (F.col("to") - F.col("from") + window).cast("int").alias("length")
    )
    paths = cut(paths.filter((F.col("doc") != F.col("ref_doc")) | (F.col("start") != F.col("ref_start"))), "graph-paths")
    release(runs)
    spans = paths.select("ref_doc", "ref_start", "length").distinct().groupBy("ref_doc").agg(F.collect_list(F.struct("ref_start", "length")).alias("spans"))
    texts_of = edges.select(F.col("doc").alias("ref_doc"), "packed").dropDuplicates(["ref_doc"]).join(spans, "ref_doc")
    digests = texts_of.select("ref_doc", "packed", "spans").mapInArrow(_source_digests, "ref_doc long, ref_start int, length int, digest binary")
    verified = paths.join(digests, ["ref_doc", "ref_start", "length"]).groupBy("doc").agg(F.collect_list(F.struct("start", "length", "digest")).alias("paths"))
    removed = edges.select("doc", "packed").join(verified, "doc").select("doc", "packed", "paths").mapInArrow(_removed, "doc long, n_removed long, kept string")

    gone = removed.dropDuplicates(["doc"])
    out = texts.join(gone, "doc", "left")
    empty = F.lit("")
    return out.select(
        F.when(F.col("doc") != NEVER, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.sha2(empty, 256)).when(F.col("kept").isNotNull(), F.sha2("kept", 256)).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        F.when(F.col("copy"), empty).otherwise(F.col("kept")).alias("kept"),
    )


def op8_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
