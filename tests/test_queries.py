"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from passagekit.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "events"):
        con.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return (value is None, str(value))
    return (False, f"{round(float(value), 4) + 0.0:.4f}")


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    assert sorted(frame.columns) == columns
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    theirs = sorted(tuple(plain(dict(zip(want.columns, r))[c]) for c in columns) for r in want.fetchall())
    assert len(ours) == len(theirs) > 0
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            if x != y:  # sums in another order may round apart
                assert abs(float(x[1]) - float(y[1])) < 2e-4


#: Whole searches: test_isochrone_route runs one, test_search_constraints the limits and the alternatives.
SEARCHES = {"isochrone_route", "searched_quality"}


def test_unchecked_queries_run(spark):
    for name in sorted(set(registry.queries()) - set(SQL) - SEARCHES):
        assert registry.queries()[name](spark, SF).count() > 0


def test_isochrone_route(spark):
    """Routes begin and end where they should, hours ascend, and who does not arrive has a reason."""
    from passagekit.plans import queries
    from passagekit.plans.bindings import view

    rows = {}
    for r in registry.queries()["isochrone_route"](spark, SF).collect():
        rows.setdefault(r.request_id, []).append(r)
    voyages = {r.request_id: r for r in queries._voyages(lambda name: view(spark, SF, name)).collect()}
    assert rows.keys() == voyages.keys()
    for k, way in rows.items():
        way.sort(key=lambda r: r.seq)
        asked, near = voyages[k], lambda r, lat, lon: abs(r.lat - lat) < 1e-5 and abs(r.lon - lon) < 1e-5
        assert [r.seq for r in way] == list(range(len(way))) and near(way[0], asked.start_lat, asked.start_lon)
        assert all(a.hours < b.hours and a.t_ms < b.t_ms for a, b in zip(way, way[1:])) and way[0].t_ms == asked.departure_ms
        assert {r.reason for r in way} in ({None}, {"land"}, {"grib_exhausted"}, {"steps"}, {"wind"}, {"safety"})
        if way[0].reason is None:
            assert near(way[-1], asked.end_lat, asked.end_lon) and all(r.wave is None or r.wave >= 0 for r in way)
    assert sum(way[0].reason is None for way in rows.values()) >= len(rows) / 2
