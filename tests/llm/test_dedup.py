import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from passagekit.llm import components, debruijn, radix_dedup, simhash

from .conftest import SCHEMA

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(pairs, nodes):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


@pytest.mark.parametrize("first_digit,growth", [(1, 2), (3, 4), (128, 16)])
def test_exact_groups(docs, rows, first_digit, growth):
    got = {r.doc_id: r for r in radix_dedup.exact_groups(docs, carry={"sha": lambda t: F.sha2(t, 256)}, first_digit=first_digit, growth=growth).collect()}
    norm = {i: (t or "").translate(LOWER) for i, t, *_ in rows}
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].sha == hashlib.sha256(t.encode()).hexdigest()


def test_exact_groups_edges(spark, empty):
    assert radix_dedup.exact_groups(empty).count() == 0
    rows = [(None, "a"), (None, "b"), (7, "A"), (7, "A"), (7, "c")]
    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in radix_dedup.exact_groups(docs).collect())
    assert got == [("7", "7", 1, True), ("7", "7", 3, True), ("7", "7", 3, True), ("None", "7", 3, False), ("None", "None", 1, True)]
    assert radix_dedup.dedup(docs).columns == docs.columns


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5)]
    got = {r.vertex: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert got == joined([p for p in pairs if p[0] != p[1]], nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_by_hand():
    import re

    for text in ("", "one", "One two", "a b c d", "É a\tb\x0bc  d", "w " * 40):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        assert simhash.fingerprint(text) % (1 << 64) == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for _ in range(300)], np.uint64)
    prints = np.concatenate([base, base ^ flips])
    first, last = rng.integers(0, 300, 90), rng.integers(200, 601, 90)
    q, p = simhash.near(prints[:90], prints, first, last, radius)
    within = np.bitwise_count(prints[:90, None] ^ prints[None, :]) <= radius
    at = np.arange(600)[None, :]
    want = np.argwhere(within & (at >= first[:, None]) & (at < last[:, None]))
    assert sorted(zip(q.tolist(), p.tolist())) == [tuple(x) for x in want.tolist()]


def test_small_buckets_share_planes(monkeypatch):
    monkeypatch.setattr(simhash, "PASS", 7)
    test_bit_sliced_comparison(2)


@pytest.mark.parametrize("block", [4, 2048])
def test_near_links_lose_no_component(spark, block):
    rng = np.random.default_rng(4)
    prints = set()
    for _ in range(40):
        x = int(rng.integers(0, 1 << 63))
        for _ in range(int(rng.integers(1, 60))):
            prints.add(x)
            for b in rng.choice(64, int(rng.integers(0, 3)), replace=False):
                x ^= 1 << int(b)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    frame = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "print long, id long")
    links = [(r.a, r.b) for r in simhash.near_links(frame, block=block).collect()]
    arr = np.array(sorted(prints), np.uint64)
    want = np.argwhere(np.triu(np.bitwise_count(arr[:, None] ^ arr[None, :]) <= 2, 1))
    assert all(np.bitwise_count(arr[a] ^ arr[b]) <= 2 for a, b in links)
    nodes = range(len(arr))
    assert joined(links, nodes) == joined(map(tuple, want.tolist()), nodes)


def test_near_groups(docs, rows, empty):
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    prints = {i: simhash.fingerprint(t) % (1 << 64) for i, t, *_ in rows}
    ids = sorted(prints)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    want = joined(pairs, ids)
    assert {i: (r.print % (1 << 64), r.component_id) for i, r in got.items()} == {i: (prints[i], want[i]) for i in ids}
    assert simhash.near_groups(empty).count() == 0


def test_rows_without_an_id_link_and_ids_stay_exact(spark):
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in rng.integers(0, 5000, 3000)]
    text = lambda at: " ".join([*words[:at], "changed", *words[at + 1 :]])
    base = simhash.fingerprint(" ".join(words))
    within = lambda t: 0 < ((simhash.fingerprint(t) ^ base) % (1 << 64)).bit_count() <= 2
    near_one, near_two = [t for t in map(text, range(0, 3000, 7)) if within(t)][:2]
    big = (1 << 53) + 1
    rows = [(None, near_one), (None, near_one), (big, " ".join(words)), (big + 2, near_two), (None, "alone " * 40), (7, "another text here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_groups(frame).collect()), key=str)
    assert got == sorted([("None", big), ("None", big), (str(big), big), (str(big + 2), big), ("None", None), ("7", 7)], key=str)


def repeats(rows, window=20):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            key = tuple(words[at : at + window])
            if key in seen:
                gone[at : at + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("chunk", [1 << 21, 900])
def test_remove_repeats(docs, rows, empty, chunk, monkeypatch):
    monkeypatch.setattr(debruijn, "CHUNK", chunk)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.remove_repeats(docs).collect()}
    assert got == repeats(rows)
    assert debruijn.remove_repeats(empty).count() == 0


def test_nothing_is_removed_without_the_graph(docs, rows, monkeypatch):
    whole = debruijn.graph
    monkeypatch.setattr(debruijn, "graph", lambda edges: tuple(x.filter("false") for x in whole(edges)))
    copied = {i for i, t, *_ in rows if t and any(j < i and u and u.split() == t.split() for j, u, *_ in rows)}
    assert not [r for r in debruijn.remove_repeats(docs).collect() if r.n_removed and r.doc_id not in copied]


def plain_paths(edges):
    """Maximal paths of edges (node, next) through nodes with one edge in and one out; rings as they are."""
    out, into = {}, {}
    for e, (a, b) in edges.items():
        out.setdefault(a, []).append(e)
        into.setdefault(b, []).append(e)
    plain = {v for v in out if len(out[v]) == 1 and len(into.get(v, [])) == 1}
    paths, seen = [], set()
    for e, (a, _) in edges.items():
        if a not in plain:
            path = [e]
            while (v := edges[path[-1]][1]) in plain:
                path.append(out[v][0])
            paths.append(path)
            seen.update(path)
    return paths, edges.keys() - seen


def test_graph_is_compacted(spark):
    rng = random.Random(8)
    words = [chr(97 + i) for i in range(26)]
    passages = ["".join(rng.sample(words, 12)) for _ in range(8)]
    texts = ["".join(rng.choice(passages)[rng.randint(0, 5) : rng.randint(6, 12)] for _ in range(6)) for _ in range(40)] + ["0123456789"[i : i + 6] for i in range(5)]
    texts += ["uvw" * 4]  # a ring, once more below
    number = {}
    of = lambda x: number.setdefault(x, len(number))
    ends, places = {}, {}
    for doc, t in enumerate(texts):
        for at in range(len(t) - 2):
            w = t[at : at + 3]
            ends[of(w)] = of(w[:2]), of(w[1:])
            places.setdefault(of(w), []).append((doc, at))
    repeated = {e: ends[e] for e, p in places.items() if len(p) > 1}
    rows = [(e, 0, *min(places[e]), *ends[e]) for e in repeated]
    known, sources = debruijn.graph(spark.createDataFrame(rows, "w1 long, w2 int, ref_doc long, ref_start int, node long, next long").repartition(3))
    got = known.collect()
    assert sorted(r.w1 for r in got) == sorted(repeated)
    where = {(s.path, s.base + k): (s.ref_doc, s.ref_start + k) for s in sources.collect() for k in range(s.length)}
    assert len(where) == len(got) and all(where[r.path, r.offset] == min(places[r.w1]) for r in got)
    paths, rings = plain_paths(repeated)
    found = {}
    for r in got:
        found.setdefault(r.path, []).append((r.offset, r.w1))
    found = [[e for _, e in sorted(p)] for p in found.values() if all(o == i for i, (o, _) in enumerate(sorted(p)))]
    assert sorted(p for p in found if not set(p) & rings) == sorted(paths) and max(map(len, paths)) > 5 and rings
    assert sum(map(len, found)) == len(repeated)


def test_minimizers_in_a_stream():
    """Groups that go on from batch to batch; the answer does not depend on where batches end."""
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 30), rng.random() < 0.1, doc, rng.randint(0, 3) if h % 2 else 7) for doc, h in enumerate([rng.randint(0, 9) for _ in range(300)]))
    table = pa.table({"h": [r[0] for r in rows], "doc": [r[2] for r in rows], "sign": [r[3] for r in rows], "told": pa.array([int(r[1]) for r in rows], pa.int32())})
    groups = {}
    for h, told, _, sign in rows:
        groups.setdefault(h, set()).update({None, 0} if told else {sign + 1})
    want = sorted((doc, h) for h, told, doc, _ in rows if not told and len(groups[h]) > 1)
    for size in (1, 2, 7, 300):
        out = [b for b in debruijn._repeated(iter(table.to_batches(max_chunksize=size)))]
        assert sorted((r["doc"], r["h"]) for b in out for r in b.to_pylist()) == want


def test_occurrences_in_a_stream():
    rng = random.Random(5)
    rows = sorted((rng.randint(0, 9), rng.randint(0, 3), doc, rng.randint(0, 50), 1 + (rng.random() < 0.1)) for doc in range(120))
    table = pa.table({"w1": [r[0] for r in rows], "w2": pa.array([r[1] for r in rows], pa.int32()), "doc": [r[2] for r in rows], "at": pa.array([r[3] for r in rows], pa.int32()), "n": pa.array([r[4] for r in rows], pa.int32())})
    groups = {}
    for w1, w2, doc, at, n in rows:
        groups.setdefault((w1, w2), []).append((doc, at, n))
    want = sorted((*w, doc, at, (doc, at) == g[0][:2]) for w, g in groups.items() if sum(n for *_, n in g) > 1 for doc, at, _ in g)
    for size in (1, 2, 5, 200):
        out = debruijn._occurrences(iter(table.to_batches(max_chunksize=size)))
        assert sorted(tuple(r.values()) for b in out for r in b.to_pylist()) == want


def test_word_hashes_in_pieces(monkeypatch):
    texts = [b"one two  three", b"", b"\tfour", b"five\nsix ", b"seven" * 50, b"one"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole, owner = debruijn.word_hashes(data, offsets)
    assert owner.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    words = [w for t in texts for w in t.split()]
    assert all((whole[i] == whole[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))
    monkeypatch.setattr(debruijn, "CHUNK", 7)
    again, owner2 = debruijn.word_hashes(data, offsets)
    assert (again == whole).all() and (owner2 == owner).all()


def test_repeats_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " end"), (None, text)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in debruijn.remove_repeats(docs).collect())
    assert got == [("1", 0), ("1", 0), ("2", 30), ("None", 30)]


def test_steps_leave_no_shuffle_files(spark, docs):
    """What the steps of op8 have shuffled is deleted with each step, not when the driver's garbage goes."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f.rsplit("/shuffle_", 1)[1].split("_")[0] for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    docs.count()
    before = shuffles()
    found = debruijn.remove_repeats(docs)
    for _ in range(50):
        if len(shuffles() - before) <= 2:
            break
        time.sleep(0.1)
    assert len(shuffles() - before) <= 2 and found.columns[0] == "doc_id"  # a count of links is no table
