import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.llm import common, mixing, multi_index, resharding


def test_min_cost_flow_is_least():
    flows = resharding.min_cost_flow([10, 0, 5], [4, 8, 3], [[0, 1, 4], [1, 0, 1], [4, 2, 0]])
    assert sum(flows.values()) == 15
    assert flows[0, 0] == 4 and flows[2, 2] == 3 and flows[0, 1] == 6 and flows[2, 1] == 2


def test_reshard(docs, rows, empty):
    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(6))
    got = resharding.reshard(docs, old, 8).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    sizes, slots = [0] * 8, [[] for _ in range(8)]
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    longest = max(r["size"] for r in got)
    assert max(sizes) - min(sizes) <= 2 * longest
    assert resharding.reshard(empty, F.lit(0), 8).count() == 0


def test_reshard_moves_little(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 17)) for i in range(4000)], "doc_id long, text string")
    old = (F.col("doc_id") % 4).cast("int")
    got = resharding.reshard(docs, old, 8).groupBy("old_shard", "shard").agg(F.sum("size").alias("n")).collect()
    total = sum(r.n for r in got)
    moved = sum(r.n for r in got if r.old_shard != r.shard)
    assert abs(moved - total / 2) < 100 and max(abs(sum(r.n for r in got if r.shard == s) - total / 8) for s in range(8)) < 60


def test_reshard_of_documents_moves_no_more_than_the_flow(spark):
    """The query on whole tables: placement, slots and sizes by hand, and bytes moved against the flow's optimum."""
    got = resharding.op10_flow_reshard(spark, "/root/testdata/sf0.01").collect()
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r["size"] == len(rows[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(rows[r.doc_id].encode()) for r in got)
    old, new, slots = [0] * 8, [0] * 8, {}
    for r in got:
        old[r.old_shard] += r["size"]
        new[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, longest = sum(old), max(r["size"] for r in got)
    assert max(new) - min(new) <= longest
    capacity = [total * (i + 1) // 8 - total * i // 8 for i in range(8)]
    best = sum(n for (i, j), n in resharding.min_cost_flow(old, capacity, [[int(i != j) for j in range(8)] for i in range(8)]).items() if i != j)
    moved = sum(r["size"] for r in got if r.shard != r.old_shard)
    assert abs(moved - best) <= 8 * longest


def test_reshard_odd_rows(spark):
    rows = [(None, "a")] * 3 + [(1, "same"), (1, "same"), (2, None), (3, "é" * 50)]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, shard int, slot string")
    got = resharding.reshard(docs, F.lit(None).cast("int"), 3).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").encode()) + 1) for i, t in rows)
    assert {r.old_shard for r in got} == {0} and all(0 <= r.shard < 3 for r in got)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_running_before(spark):
    rng = np.random.default_rng(12)
    rows = [(int(g), int(a), int(b), int(k), int(n)) for k, (g, a, b, n) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 4, 500), rng.integers(0, 5, 500), rng.integers(0, 50, 500)))]
    frame = spark.createDataFrame(rows, "g int, a int, b int, k int, n long").repartition(5)
    got = {r.k: r.before for r in common.running_before(frame, ["g"], ["a", "b"], ["k"], "n", "before").collect()}
    assert got == {k: sum(r[4] for r in rows if r[0] == g and r[1:4] < (a, b, k)) for g, a, b, k, _ in rows}


def test_mix_odd_rows(spark):
    """Repeated rows and ids, ties, a leaf without words, and columns of inner names."""
    rows = [(1, "a b c", "en", "src1")] * 3 + [(None, "d e", "en", "src1"), (2, None, "en", "src2"), (3, "f  g\th i", None, None), (3, "j", None, None)]
    docs = spark.createDataFrame([(*r, 9, "k", "b") for r in rows], "doc_id long, text string, lang string, source string, budget int, key string, block string")
    got = mixing.source_mix(docs).collect()
    assert len(got) == len(rows) and sum(r.taken for r in got) == sum(r.budget for r in {(r.domain, r.lang, r.source): r for r in got}.values())
    texts = mixing.mixed(docs)
    assert texts.columns == docs.columns and sum(len((r.text or "").split()) for r in texts.collect()) == sum(r.taken for r in got)
    cut_ = spark.createDataFrame([("  a b\tc  d ", n) for n in range(6)], "t string, n int").select(mixing.token_prefix(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in cut_] == ["", "  a", "  a b", "  a b\tc", "  a b\tc  d", "  a b\tc  d "]


def test_rewrite_touches_affected_shards_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, "abc") for i in range(60)], "doc_id long, text string")
    plan = resharding.reshard(docs, (F.col("doc_id") % 3).cast("int"), 3)
    plan = plan.withColumn("shard", F.when(F.col("doc_id") == 0, 1).otherwise(F.col("old_shard")))
    path = str(tmp_path / "out")
    assert sorted(r.shard for r in resharding.rewrite(docs, plan, path).collect()) == [0, 1]
    back = spark.read.parquet(path)
    assert sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1] and back.count() == 40


def fill(children, budget):
    """Water-filling in rounds: give by weight, cap, and share the rest again."""
    got, open_ = {k: 0.0 for k in children}, set(children)
    while budget > 1e-9 and open_:
        total = sum(children[k][0] for k in open_)
        over = [k for k in open_ if got[k] + budget * children[k][0] / total >= children[k][1] - 1e-9]
        if not over:
            for k in open_:
                got[k] += budget * children[k][0] / total
            return got
        k = min(over, key=lambda k: (children[k][1] - got[k]) / children[k][0])
        part = (children[k][1] - got[k]) / children[k][0]
        for j in open_:
            got[j] += part * children[j][0]
        budget -= part * total
        open_.discard(k)
    return got


def test_share(spark):
    cases = {"p": {"a": (5, 100), "b": (3, 10_000), "c": (2, 50)}, "q": {"a": (1, 7), "b": (1, 9)}, "r": {"a": (4, 1000)}}
    budgets = {"p": 1000, "q": 100, "r": 123}
    rows = [(p, n, w, cap, budgets[p]) for p, kids in cases.items() for n, (w, cap) in kids.items()]
    out = mixing.share(spark.createDataFrame(rows, "parent string, name string, weight long, cap long, budget long"), ["parent"])
    for r in out.collect():
        assert abs(r.got - fill(cases[r.parent], budgets[r.parent])[r.name]) <= 1


def test_mix(docs, rows, empty):
    got = mixing.source_mix(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    words = {i: len((t or "").split()) for i, t, *_ in rows}
    leaves = {}
    for r in got:
        assert r.n_tokens == words[r.doc_id] and 0 <= r.copies <= mixing.EPOCHS
        leaf = leaves.setdefault((r.domain, r.lang, r.source), [0, 0, r.budget, 0])
        leaf[0] += r.taken
        leaf[1] += r.n_tokens
        leaf[3] = max(leaf[3], r.copies) - 0
    for taken, tokens, budget, _ in leaves.values():
        assert taken == budget <= tokens * mixing.EPOCHS
    total = sum(words.values())
    assert math.floor(total * mixing.TOTAL) - len(leaves) * 3 <= sum(x[0] for x in leaves.values()) <= total * mixing.TOTAL
    assert mixing.source_mix(empty).count() == 0


def near(rows):
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 16]
    x = np.array([v for _, v in fine], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.9
    np.fill_diagonal(hit, False)
    return [i for i, _ in fine], hit


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(300, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 300] + rng.normal(size=16) * 0.05]) for i in range(900)]
    rows += [(900 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (2004, [None] * 16), (2005, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = {r.vec_id: r for r in multi_index.near_vectors(frame).collect()}
    assert len(got) == len(rows)
    ids, hit = near(rows)
    degree = dict(zip(ids, hit.sum(1).tolist()))
    assert all(got[i].n_links <= degree[i] for i in ids)
    assert sum(got[i].n_links for i in ids) >= 0.95 * sum(degree.values())
    measured = multi_index.recall(frame, multi_index.near_vectors(frame)).first()
    asked = [i for i in ids if i % 20 == 0]
    assert (measured.queries, measured.links) == (len(asked), sum(degree[i] for i in asked)) and measured.recall >= 0.9
    for i in range(2000, 2006):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(got[i].kept == (got[i].component_id == i) for i in ids)
    assert multi_index.near_vectors(frame.limit(0)).count() == 0


def test_vectors_of_other_lengths_and_doubles(spark):
    """Every length has links of its own; doubles are not rounded; null and repeated ids, one number, huge numbers."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(50)]
    rows += [(100, [1.0, 2.0, 3.0]), (101, [2.0, 4.0, 6.0]), (102, [-1.0, 5.0, 0.0]), (110, [3.0]), (111, [4.0]), (112, [-1.0])]
    rows += [(120, [1e300, 1e300]), (121, [1e-300, 1.1e-300]), (None, [1.0, 1.0]), (130, [0.5, 0.1, 0.2, 0.3]), (130, [0.5, 0.1, 0.2, 0.3])]
    t = math.acos(0.9)
    rows += [(140, [1.0, 0.0, 0.0, 0.0, 0.0]), (141, [math.cos(t - 1e-12), math.sin(t - 1e-12), 0.0, 0.0, 0.0]), (142, [math.cos(t + 1e-12), 0.0, math.sin(t + 1e-12), 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in multi_index.near_vectors(frame).collect()}
    assert (got[100], got[101], got[102]) == ((1, 100), (1, 100), (0, 102))
    assert (got[110], got[111], got[112]) == ((1, 110), (1, 110), (0, 112))
    assert (got[120], got[121], got[None], got[130]) == ((1, 120), (1, 120), (0, None), (1, 130))
    assert (got[140], got[141], got[142]) == ((1, 140), (1, 140), (0, 142))


def test_traversal_is_multi_sequence():
    rng = np.random.default_rng(8)
    grid = multi_index.Grid(rng.normal(size=(9, 4)), rng.normal(size=(7, 4)))
    x = rng.normal(size=(20, 8))
    seen = grid.visits(x, 63)
    one, two = multi_index.distances(x[:, :4], grid.first), multi_index.distances(x[:, 4:], grid.second)
    total = (one[:, :, None] + two[:, None, :]).reshape(20, -1)
    for k in range(20):
        assert np.allclose(total[k][seen[k]], np.sort(total[k])) and (grid.visits(x, 5)[k] == seen[k][:5]).all()


@pytest.mark.parametrize("old, new", [(3, 4), (8, 6)])
def test_rewrite_keeps_every_row_once(spark, tmp_path, old, new):
    rows = [(None if i % 7 == 0 else i % 40, f"{i:04d} " + "x" * (i * 37 % 300), i * 31 % old) for i in range(400)] + [(5, "same", i % old) for i in range(20)]
    docs = resharding.keyed(spark.createDataFrame(rows, "doc_id long, text string, old int").repartition(4))
    path = str(tmp_path / "shards")
    docs.drop(resharding.ROW).withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(path)
    plan = resharding.reshard(docs, F.col("old"), new)
    resharding.rewrite(docs, plan, path)
    back = spark.read.parquet(path)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.text, r.old) for r in back.collect()), key=key) == sorted(rows, key=key)
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == {r.shard: r["count"] for r in plan.groupBy("shard").count().collect()}
    assert {r.shard for r in back.select("shard").distinct().collect()} == set(range(new))


def test_rewrite_refuses_ids_that_name_no_row(spark, tmp_path):
    for ids in ([1, None, 3], [1, 1, 3]):
        docs = spark.createDataFrame([(i, "x" * 9, 0) for i in ids], "doc_id long, text string, old int")
        with pytest.raises(ValueError):
            resharding.rewrite(docs, resharding.reshard(docs, F.col("old"), 2), str(tmp_path / "refused"))
