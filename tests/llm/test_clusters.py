"""Centroid clustering against a brute-force version in Python's integers."""

import hashlib
import math
from collections import Counter

import numpy as np

from recfuse.llm import clusters, queries
from tests.oracle import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, count=clusters.CLUSTERS):
    whole = lambda e: int(e) * 256 if abs(e) >= 2**52 else math.floor(256 * e)
    usable = [(i, [whole(e) for e in x]) for i, x in rows if x is not None and len(x) == 64 and all(e is not None and math.isfinite(e) for e in x)]
    usable.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in usable[:count]]
    points = np.array([x for _, x in usable], dtype=object)

    def assigned():
        distances = np.array([((points - np.array(c, dtype=object)) ** 2).sum(axis=1) for c in centroids]).T.tolist()
        return [min(zip(d, range(len(d)), strict=True)) for d in distances]

    for _ in range(5):
        best = assigned()
        for k in range(len(centroids)):
            own = [i for i, (_, c) in enumerate(best) if c == k]
            if own:
                centroids[k] = [s // len(own) for s in points[own].sum(axis=0)]
    best = assigned() if usable else []
    long = lambda v: v if v < 2**63 else None
    per = Counter()
    for d, k in best:
        per[k] += d
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return Counter((i, k, long(d), long(per[k]), long(sum(per.values())), digest(k)) for (i, _), (d, k) in zip(usable, best, strict=True))


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "k") for r in rows], f"vec_id long, embedding array<{kind}>, cluster string").repartition(3)
    return Counter(map(tuple, clusters.clustered(df).collect()))


def test_against_sql(spark):
    df = queries.QUERIES["op11_pivot_clusters"](spark, SF_DIR)
    cursor = connect(SF_DIR).execute(queries.SQL["op11_pivot_clusters"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    vector = lambda scale=1.0: [float(np.float32(e)) for e in rng.normal(0, scale, 64)]
    copy = vector()
    rows = [(i, vector()) for i in range(90)] + [(200 + i, copy) for i in range(30)] + [(7, copy), (7, vector()), (None, vector()), (None, copy)]
    odd = [None, [], vector()[:63], [*vector(), 1.0], [None, *vector()[1:]], [math.nan, *vector()[1:]], [math.inf, *vector()[1:]]]
    rows += [(300 + i, x) for i, x in enumerate(odd)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:5]) == brute(rows[:5])
    assert run(spark, []) == run(spark, [(1, None)]) == Counter()


def test_equal_vectors_and_ties(spark):
    """Equal first centroids and points halfway between two: the smaller number wins, empty clusters stay."""
    corner = lambda *places: [1.0 if k in places else 0.0 for k in range(64)]
    rows = [(i, corner(i % 4)) for i in range(60)] + [(100 + i, corner(i % 4, (i + 1) % 4)) for i in range(20)]
    assert run(spark, rows) == brute(rows)


def test_huge_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(e)) for e in rng.normal(0, 10.0 ** rng.choice([0, 5, 12, 30, 37]), 64)]) for i in range(60)]
    assert run(spark, rows) == brute(rows)
    rows = [(i, [float(e) for e in rng.normal(0, 1e300, 64)]) for i in range(45)]
    assert run(spark, rows, "double") == brute(rows)


def test_bounds_are_below_distances():
    rng = np.random.default_rng(6)
    x = rng.integers(-150, 150, (400, 64)).astype(float)
    centroids = [[int(e) for e in row] for row in x[:40]]
    pivots, last = clusters.choose_pivots(centroids, 10, 45), x[:40]
    bounds, exact = pivots.bounds(pivots.distances(x), pivots.distances(last)), np.sqrt(clusters.squares(x, last))
    assert (bounds <= exact).all() and bounds.max() > 0 and len(pivots.pairs) == 45
    # Two far groups: most centroids are left out without being measured.
    x[200:] += 5000
    last = np.concatenate([x[:20], x[-20:]])
    pivots = clusters.choose_pivots([[int(e) for e in row] for row in last])
    best, least, measured = clusters.nearest(x, pivots.distances(x), last, pivots)
    exact = clusters.squares(x, last)
    assert (best == exact.argmin(axis=1)).all() and (least == exact.min(axis=1)).all() and measured < 0.8 * exact.size
