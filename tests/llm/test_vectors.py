import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from passagekit.llm import centroids, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, v string, n string, cluster string"
ODD = [None, [], [None] * 6, [1.0, None, 0, 0, 0, 0], [math.nan] * 6, [math.inf] + [0.0] * 5, [1.0, 2.0]]


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, "x", "v", "n", "c") for i, v in rows], SCHEMA).repartition(3)


def plain_clusters(rows, k, rounds, width, scale=256, seed=2):
    kept = [(i, [math.floor(scale * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == width and all(e is not None and math.isfinite(e) for e in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'none' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        taken = [[] for _ in at]
        for _, x in kept:
            taken[near(x)[1]].append(x)
        at = [[sum(c) // len(t) for c in zip(*t)] if t else at[n] for n, t in enumerate(taken)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = lambda n: sum(d for _, m, d in found if n in (None, m))
    return sorted(((i, n, d, total(n), total(None), hashlib.sha256(",".join(map(str, at[n])).encode()).hexdigest()) for i, n, d in found), key=str)


@pytest.mark.parametrize("k,rounds", [(5, 4), (40, 5), (3, 0)])
def test_clusters_against_plain_rounds(spark, k, rounds):
    rng = np.random.default_rng(k)
    rows = [(n, v) for n, v in enumerate((rng.normal(size=(120, 6)) + rng.integers(-3, 3, (120, 1))).tolist())]
    rows += [(1000 + n, v) for n, v in enumerate(ODD)] + [(3, rows[3][1]), (3, rows[9][1]), (None, rows[0][1]), (None, rows[1][1])] + [(2000 + n, [0.5] * 6) for n in range(60)]
    got = centroids.cluster(table(spark, rows), k=k, rounds=rounds, components=6).drop("x")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, rounds, 6)


def test_few_vectors_ties_and_none(spark):
    rows = [(1, [0.0] * 6), (2, [0.0] * 6), (3, [1.0] * 6)]
    got = centroids.cluster(table(spark, rows), components=6).drop("x")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, 40, 5, 6)
    assert centroids.cluster(table(spark, [(n, v) for n, v in enumerate(ODD)]), components=6).count() == 0
    with pytest.raises(Exception, match="would not fit"):
        centroids.cluster(table(spark, [(1, [1e9] * 6)]), components=6)


def test_products_follow_changed_components_alone():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-99, 99, (50, 8)), rng.integers(-99, 99, (5, 8))
    change = rng.integers(-3, 3, (5, 8)) * (rng.random((5, 8)) < 0.2)
    assert (centroids.updated(x, x @ c.T, change) == x @ (c + change).T).all()


@pytest.mark.parametrize("width,wanted,rows,seed", [(64, 32, 800, 0), (150, 20, 900, 1), (6, 32, 50, 2), (90, 32, 40, 3)])
def test_eigenpairs_against_a_dense_solver(width, wanted, rows, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width)) * np.linspace(1, 4, width)
    x -= x.mean(axis=0)
    cov, widest = x.T @ x / rows, []

    def multiply(columns):
        widest.append(columns.shape[1])
        return cov @ columns

    values, basis = whitening.eigenpairs(multiply, width, wanted)
    want = np.linalg.eigvalsh(cov)[::-1][:wanted]
    assert np.abs(values - want).max() < 1e-13 * want[0] and (np.diff(values) <= 1e-13 * want[0]).all()
    assert np.linalg.norm(cov @ basis - basis * values, axis=0).max() < 2 * width * 2.3e-16 * want[0]
    assert np.abs(basis.T @ basis - np.eye(len(values))).max() < 1e-13 and max(widest) <= wanted + whitening.SPARE


def plain_white(rows, width, wanted):
    kept = [(i, [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]) for i, v in rows if v is not None and len(v) == width and all(e is not None and math.isfinite(e) for e in v)]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept))]
    y = [[n * a - s for a, s in zip(x, sums)] for _, x in kept]
    c = np.array([[float(Fraction(a, n)) for a in r] for r in y])
    values, basis = np.linalg.eigh(c.T @ c / n)
    return [i for i, _ in kept], [sum(a * a for a in r) for r in y], c, values[::-1][:wanted], basis[:, ::-1][:, :wanted], np.trace(c.T @ c / n)


def test_whitening_against_a_dense_solver(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(12, 12))
    rows = [(n, v) for n, v in enumerate((rng.normal(size=(300, 12)) @ mix * 3).tolist())]
    rows += [(1000 + n, v) for n, v in enumerate(ODD)] + [(3, rows[5][1]), (None, rows[0][1])] + [(2000 + n, rows[1][1]) for n in range(100)]
    got = whitening.whiten(table(spark, rows), components=8).collect()
    ids, deviations, c, values, basis, trace = plain_white(rows, 12, 8)
    assert len(got) == 8 * len(ids) and {r.n for r in got} == {len(ids)}
    white = c @ basis / np.sqrt(values)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for k in range(8):
        mine = sorted((str(r.vec_id), int(r.deviation), round(abs(r.whitened), 8)) for r in by[k + 1])
        assert mine == sorted((str(i), d, round(abs(w), 8)) for i, d, w in zip(ids, deviations, white[:, k]))
        assert {round(r.explained, 12) for r in by[k + 1]} == {round(values[k] / trace, 12)}
    error = {r.identity_error for r in got}
    assert len(error) == 1 and error.pop() < 1e-10


def test_whitening_without_variance(spark):
    got = whitening.whiten(table(spark, [(n, [1.0, 2.0, 3.0]) for n in range(4)])).collect()
    assert {(r.whitened, r.explained, int(r.deviation), r.identity_error) for r in got} == {(None, 0.0, 0, 0.0)} and len(got) == 12
    flat = whitening.whiten(table(spark, [(n, [float(n), 2.0 * n, 1.0]) for n in range(5)])).collect()
    assert {r.component: r.whitened is None for r in flat} == {1: False, 2: True, 3: True}
    assert whitening.whiten(table(spark, [(n, v) for n, v in enumerate(ODD[:1] + ODD[2:6])])).count() == 0


def test_exact_numbers_beyond_a_long():
    x = np.array([[1 << 40, -5], [3, 1 << 40]])
    n, sums = 1 << 30, np.array([7, 9])
    assert whitening.centred(x, n, sums).tolist() == [[(1 << 70) - 7, -5 * n - 9], [3 * n - 7, (1 << 70) - 9]]
    assert whitening._deviations(np.array([[1 << 40, 3]])) == [(1 << 80) + 9]
