"""SentencePiece encoding with byte offsets, and decoding.

The text is normalised by the model's compiled character map: at each place
the longest prefix that the map knows is replaced, and every byte written
records the source byte it came from.  Pieces are runs of normalised bytes,
so that alignment projects each of them to its span of original bytes.

No piece of a usual model joins a word to a later word marker, so merges
never cross one: the normalised text falls apart into units that are encoded
once and remembered, with the same ids as the whole text would get.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MARK = "▁"
#: Units remembered by one worker at most, about 80 MB; then it starts anew.
MEMORY = 300_000
#: Characters of text in one batch of results.
BATCH_CHARS = 2_000_000


def _fields(buf: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of one protocol-buffer message."""
    at, end = 0, len(buf)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, buf[at : at + size]
            at += size


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 bytes and its replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = (), b""
        #: Bytes with which a known prefix can begin.
        self.begins = np.zeros(256, bool)
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
            self.texts = blob[4 + size :]
            root = self._child(self.units[0])
            self.begins[[c for c in range(256) if root ^ c < len(self.units) and self.units[root ^ c] & 0x800000FF == c]] = True

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes taken at ``at`` by the longest known prefix and what replaces them; null where none is known."""
        best, units = None, self.units
        node = self._child(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or units[node] & 0x800000FF != data[i]:
                break
            unit = units[node]
            node ^= self._child(unit)
            if unit >> 8 & 1:
                best = i + 1 - at, units[node] & 0x7FFFFFFF
        if best:
            start = best[1]
            return best[0], self.texts[start : self.texts.index(b"\0", start)]
        return None

    def walk(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mapped bytes, the source byte of each, and where the replacement or character it belongs to begins.

        Only places where a known prefix can begin are looked up; all bytes
        between two replacements are copied as they are.
        """
        raw = np.frombuffer(data, np.uint8)
        outs, origins, begins, done, size = [], [], [], 0, 0

        def copy(to: int) -> None:
            nonlocal size
            if to > done:
                outs.append(raw[done:to])
                origins.append(np.arange(done, to))
                begins.append(np.arange(size, size + to - done))
                size += to - done

        for at in np.flatnonzero(self.begins[raw]).tolist():
            if at >= done and (got := self.longest(data, at)):
                copy(at)
                new = np.frombuffer(got[1], np.uint8)
                outs.append(new)
                origins.append(np.full(len(new), at))
                begins.append(np.full(len(new), size))
                size += len(new)
                done = at + got[0]
        copy(len(raw))
        if not outs:
            return raw, np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(outs), np.concatenate(origins), np.concatenate(begins)

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << (8 if unit & 512 else 0)


class Codec:
    """Encodes and decodes with the model in ``proto``."""

    def __init__(self, proto: bytes):
        pieces, spec, kind = [], {}, 1
        for field, value in _fields(proto):
            if field == 1:
                pieces.append({k: v for k, v in _fields(value)})
            elif field == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                spec |= dict(_fields(value))
        types = [p.get(3, 1) for p in pieces]
        self.texts = [p[1].decode() for p in pieces]
        if 4 in types:
            raise ValueError("models with user-defined symbols are not supported")
        if kind != 2 or 6 not in types:
            raise ValueError("only BPE models with byte fallback are supported")
        self.map = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        # bytes of normalised text that a piece stands for
        self.size = np.array([1 if t == 6 else 0 if t == 3 else len(p[1]) for p, t in zip(pieces, types, strict=True)], np.int64)
        normal = [t for t, kind_ in zip(self.texts, types, strict=True) if kind_ == 1]
        self.splits = self.escape and not any(re.search(f"[^{MARK}]{MARK}", t) for t in normal)
        self.lines = not any("\n" in t for t in normal)
        self.unit = re.compile((f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if self.lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.splits else "(?s).+")
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto)
        # the same model without its normaliser: messages that follow override fields
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        self.begin, self.end = self.whole.bos_id(), self.whole.eos_id()
        self.memory: dict[str, bytes] = {}

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the source byte it came from."""
        data = text.encode()
        out, origin, begin = self.map.walk(data)
        space, mark, start = out == 32, np.frombuffer(MARK.encode() if self.escape else b" ", np.uint8), 0
        if self.squeeze:
            # spaces at the head of a replacement go after a space and at the start
            inner = np.flatnonzero(~space & (begin < np.arange(len(out))))
            head = space.copy()
            if len(inner):
                past = np.zeros(len(out), bool)
                past[inner] = True
                ahead = np.maximum.accumulate(np.where(past, np.arange(len(out)), -1))
                head &= ahead < begin
            before = np.r_[True, space[:-1]][begin] if len(out) else space
            kept = ~(head & before)
            start = int(origin[kept][0]) if kept.any() else len(data)
            out, origin, space = out[kept], origin[kept], space[kept]
            if not len(out):
                return "", np.array([len(data)], np.int64)
        elif not data:
            return "", np.zeros(1, np.int64)
        end = len(data)
        if self.squeeze:
            last = len(out)
            while last and space[last - 1]:
                last -= 1
                end = int(origin[last])
            out, origin, space = out[:last], origin[:last], space[:last]
        wide = np.where(space, len(mark), 1)
        written, source = np.repeat(out, wide), np.repeat(origin, wide)
        if len(mark) > 1:
            places = np.flatnonzero(space)
            at = (np.cumsum(wide) - wide)[places]
            for k in range(len(mark)):
                written[at + k] = mark[k]
        else:
            written = written.copy()
        if self.prefix:
            written, source = np.concatenate([mark, written]), np.concatenate([np.full(len(mark), start), source])
        return written.tobytes().decode(errors="replace"), np.append(source, end).astype(np.int64)

    def ids(self, normal: str) -> np.ndarray:
        """Ids of a normalised text, with begin and end."""
        memory, units = self.memory, self.unit.findall(normal)
        try:
            body = b"".join([memory[u] for u in units])
        except KeyError:
            if len(memory) > MEMORY:
                memory.clear()
            encode, parts = self.bare.encode, []
            for u in units:
                got = memory.get(u)
                if got is None:
                    found = encode(u)
                    got = struct.pack(f"<{len(found)}I", *found)
                    if len(u) < 64:
                        memory[u] = got
                parts.append(got)
            body = b"".join(parts)
        return np.frombuffer(struct.pack("<I", self.begin) + body + struct.pack("<I", self.end), "<u4")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids with begin and end, and each one's span of original UTF-8 bytes; begin and end span nothing."""
        normal, source = self.normalise(text)
        ids = self.ids(normal)
        last = np.cumsum(self.size[ids])
        return ids, source[last - self.size[ids]], source[last]

    def decode(self, ids: np.ndarray) -> str:
        return self.whole.decode(ids.tolist())


@lru_cache(maxsize=2)
def _codec(proto: bytes) -> Codec:
    return Codec(proto)


SCHEMA = "doc_id long, n_tokens long, ids binary, begins binary, ends binary, decoded string"


def _coded(proto: bytes):
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, rows, chars = _codec(proto), [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids, begins, ends = codec.encode(text)
                packed = (x.astype("<u4").tobytes() for x in (ids, begins, ends))
                rows.append((doc_id.as_py(), len(ids), *packed, codec.decode(ids)))
                chars += len(text)
                if chars > BATCH_CHARS:
                    yield flush(rows)
                    rows, chars = [], 0
        if rows:
            yield flush(rows)

    return run


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, begins, ends, decoded) of every row, coded with the file ``model``.

    ids, begins and ends are packed as little-endian unsigned 32-bit integers,
    one for each token with begin and end; begins and ends are offsets into
    the text's UTF-8 bytes.  decoded is what the ids decode to.  Models must be
    BPE with byte fallback and without user-defined symbols; others raise an
    error.  Null and
    empty texts have the begin and end ids alone; a text of any length is one
    row; an empty table gives no rows.  The model's bytes travel with the
    tasks, so executors need no copy of the file.
    """
    with open(model, "rb") as file:
        proto = file.read()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_coded(proto), SCHEMA)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(documents(spark, sf_dir), default_model())
    return coded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"),
    )
