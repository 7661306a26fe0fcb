import math
import random

from passagekit.operators import requests


def test_nearest_rank_holds_no_group_in_a_row(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *map(float, range(90))])) for _ in range(3000)] + [("c", None), ("d", 4.0)]
    frame = requests.nearest_rank(spark.createDataFrame(rows, "kind string, x double").repartition(3), "kind", "x")
    assert "collect_list" not in frame._jdf.queryExecution().toString()
    got = {r.kind: r for r in frame.collect()}
    assert set(got) == {k for k, _ in rows}
    for kind, r in got.items():
        xs = sorted(x for k, x in rows if k == kind and x is not None)
        if not xs:
            assert (r.mean, r.p50, r.p95, r.least, r.most) == (None,) * 5
            continue
        rank = lambda p: xs[max(0, math.ceil(len(xs) * p) - 1)]
        assert (r.p50, r.p95, r.least, r.most) == (rank(0.5), rank(0.95), xs[0], xs[-1]) and abs(r.mean - sum(xs) / len(xs)) < 1e-9
