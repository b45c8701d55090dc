"""Operators on small tables, and the plain queries against DuckDB."""

import random
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foldline.operators import joins, windows
from foldline.plans import catalog, housekeeping, metrics, rule_queries, transcript_queries  # noqa: F401  the last two register queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_unbounded_intervals(spark):
    df = spark.createDataFrame([("f", 1, 5, None), ("f", 2, 1, 9), ("f", 3, 1, None), ("g", 4, 1, None)], "p string, pos int, lo int, hi int")
    assert sorted(r.pos for r in joins.superseded(df, ["p"], ["pos"], "lo", "hi").collect()) == [1, 2]


def test_intervals_equal_a_plain_search(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randint(0, 30), rng.choice([None, *range(12)]), rng.choice([None, *range(12)])) for _ in range(400)]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, p string, pos int, lo int, hi int")
    want = [n for n, (p, at, x, y) in enumerate(rows) if x is not None and any(q == p and t > at and u is not None and u <= x and (v is None or y is not None and v >= y) for q, t, u, v in rows)]
    assert sorted(r.n for r in joins.superseded(df, ["p"], ["pos"], "lo", "hi").collect()) == want


def test_ranks_equal_a_sort(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([rng.random(), 0.5, -1.0])) for g in "ab" for _ in range(997)] + [("c", 2.0), ("a", None)]
    got = {r.g: r for r in metrics.rank_percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p90": 0.9, "p0": 0.0}).collect()}
    for g in "abc":
        v = sorted(x for k, x in rows if k == g and x is not None)
        assert (got[g].p90, got[g].p0, got[g].median, got[g].max) == (v[min(len(v) - 1, int(len(v) * 0.9))], v[0], statistics.median(v), v[-1])


def test_surviving_ancestor_with_cycle_and_unknown(spark):
    rows = [("a", None, False), ("b", "a", True), ("c", "b", True), ("d", "c", False), ("x", "y", True), ("y", "x", True), ("z", "x", False), ("q", "nowhere", False), ("s", "s", True), ("t", "s", False)]
    df = spark.createDataFrame(rows, "node string, parent string, gone boolean")
    got = {r.node: r.ancestor for r in joins.surviving_ancestor(df, "gone").collect()}
    assert (got["d"], got["b"], got["z"], got["q"], got["t"]) == ("a", "a", None, "nowhere", None)


def test_middle_equals_a_sort(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9, 3, 2, 3, 8, 4, 100, 0]
    kept = windows.middle(spark.createDataFrame([(v,) for v in values], "v int"), "v", 10)
    got = sorted(v for r in kept.collect() for v in [r.v] * r.kept)
    assert got == sorted(values)[2:-2]


def test_append_missing_keeps_later_copies(spark):
    new = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4)], "k string, n int")
    have = spark.createDataFrame([("a", 0), ("a", 9)], "k string, n int")
    assert sorted((r.k, r.n) for r in joins.append_missing(new, have, ["k"], ["n"]).collect()) == [("a", 3), ("b", 4)]


def test_housekeeping(spark):
    mirror = spark.createDataFrame([("s", 0, "u:a", "a", "x"), ("p", 0, "u:a", "a", "x"), ("p", 1, "u:b", "b", "y")], "file_id string, seq long, identity string, uuid string, line string")
    recs = spark.createDataFrame([("s", "b", True), ("gone", "c", True), ("s", None, False)], "file_id string, uuid string, marked boolean")
    assert [r.file_id for r in housekeeping.mirror_lost(recs, mirror).collect()] == ["gone"]
    assert [tuple(r) for r in housekeeping.fork_parents(recs, mirror).collect()] == [("s", "p")]
    assert [(r.seq, r.uuid) for r in housekeeping.adopt_parent(mirror, "s", "p").collect()] == [(1, "b")]
    lines = spark.createDataFrame([("s", 0, '{"uuid":"a"}'), ("s", 1, '{"uuid":"a","z":1}'), ("s", 2, "torn")], "file_id string, pos int, line string")
    assert [tuple(r) for r in housekeeping.load_stamp(lines).collect()] == [("s", "a", 18)]


def test_metrics(spark):
    files = spark.createDataFrame([("a", 10, 5), ("b", 20, 30), ("c", 7, 7)], "f string, ours long, theirs long")
    r = metrics.compare(files, "ours", "theirs").first()
    assert tuple(r) == (1, 1, 1, 0.0)
    assert [x.f for x in metrics.worst(files, "ours", "theirs").collect()] == ["a"]
    assert sorted(x.f for x in metrics.size_tiers(files, "ours", 3).collect()) == ["a", "b", "c"]
    assert spark.range(1).select(metrics.tokens(F.lit("abcde"))).first()[0] == 2


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    expected = sorted(str([fix(r[i]) for i in order]) for r in want.fetchall())
    assert sorted(str([fix(r[c]) for c in cols]) for r in df.collect()) == expected
