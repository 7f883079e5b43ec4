"""Centroid clustering against plain integers, its screening bounds, and its defined cases."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from sulcus.llm import centroids, queries


def brute(rows, clusters, rounds, dimensions):
    """Rows (vec_id, components) by Python integers alone."""
    kept = [(i, [int((1024.0 * x) // 1) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and abs(x) < float("inf") for x in v)]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [v for _, v in sorted(kept, key=rank)[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    place = lambda v: min(range(len(cents)), key=lambda c: (far(v, cents[c]), c))
    for _ in range(rounds):
        found = [place(v) for _, v in kept]
        for c in range(len(cents)):
            mine = [v for (_, v), p in zip(kept, found) if p == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [place(v) for _, v in kept]
    spent = [far(v, cents[p]) for (_, v), p in zip(kept, found)]
    of = [sum(s for s, p in zip(spent, found) if p == c) for c in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    fits = lambda v: v if v < 2**63 else None
    return [(i, p, fits(s), fits(of[p]), fits(sum(spent)), sha[p]) for (i, _), p, s in zip(kept, found, spent)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_rows(dimensions=4):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(i % 3, 0.2) for _ in range(dimensions)]) for i in range(60)]
    rows += [(100 + i, [float(i % 2)] * dimensions) for i in range(10)]  # ties and repeated vectors
    rows += [(5, rows[5][1]), (5, [9.0] * dimensions), (None, [1.0] * dimensions), (None, [-1.5] * dimensions)]
    bad = [None, [], [1.0] * (dimensions - 1), [1.0] * (dimensions + 1), [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 1.0, 2.0, 3.0], [float("-inf"), 1.0, 2.0, 3.0]]
    return rows + [(200 + i, v) for i, v in enumerate(bad)]


@pytest.mark.parametrize("scale", [1.0, 1e-3, 3e4, 1e9])
def test_against_plain_integers(spark, scale):
    rows = [(i, v if v is None else [x if x is None else x * scale for x in v]) for i, v in odd_rows()]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)
    assert rows_of(centroids.cluster(d, 8, 4, 4)) == sorted(brute(rows, 8, 4, 4), key=str)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(50, [0.5, 0.0]), (51, [0.5, 7.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(centroids.cluster(d, 5, 3, 2)) == sorted(brute(rows, 5, 3, 2), key=str)


def test_few_and_no_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert rows_of(centroids.cluster(d, 8, 3, 2)) == sorted(brute([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 8, 3, 2), key=str)
    none = centroids.cluster(d.where("vec_id > 9"), 8, 3, 2)
    assert none.count() == 0 and none.columns == centroids.cluster(d, 8, 3, 2).columns
    with pytest.raises(Exception, match="exactly"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 2.0])], "vec_id long, embedding array<double>"), 8, 3, 2).count()


def test_intervals_hold_what_they_bound():
    rng = np.random.default_rng(1)
    for size in (3, 1000, 2**20, 2**40):
        x, c = rng.integers(-size, size, (200, 64)), rng.integers(-size, size, (8, 64))
        c[1] = c[0]
        c[1, 0] += 1
        low, high = centroids.intervals(x, c)
        exact = [[sum(int(b) ** 2 - 2 * int(a) * int(b) for a, b in zip(row, cent)) for cent in c] for row in x]
        assert all(low[i, k] <= exact[i][k] <= high[i, k] for i in range(len(x)) for k in range(8))
        assert (centroids.nearest(x, c) == [min(range(8), key=lambda k: (exact[i][k], k)) for i in range(len(x))]).all()


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op11_centroids"])
    got = queries.op11_centroids(spark, sf)
    assert got.columns == want.columns and rows_of(got) == sorted(want.fetchall(), key=str)
