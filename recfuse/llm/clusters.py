"""Centroid clustering in whole numbers, with Ptolemaic lower bounds from cached pivot distances.

For a vector x, a centroid c and pivots p, q, Ptolemy's inequality gives
d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q). Pivots are some of the first centroids, far
from one another, and stay fixed, so a vector's distances to them are computed once and written with
it. In each round a task takes, for each vector, the centroid with the least bound, measures it, and
measures exactly every other one whose bound isn't above it. Bounds are rounded down by more than the
error of their few floating-point operations, so no centroid that could win or tie is left out.

All distances are exact: in floating point while every whole number involved stays below 2**53,
otherwise in Python's integers. Centroids and sums of a round are a table of fixed size (clusters
times components), summed in each task before they are shuffled; only it reaches the driver.

``kept`` leaves out vectors that are null, of another length, or that hold null, NaN or infinite
components (a component whose multiple leaves the range of doubles counts as infinite). Repeated rows
are vectors of their own; among vectors with equal ids (a null id is hashed as an empty text) the
starting order follows the components. With fewer vectors than clusters there are as many clusters
as vectors; an empty table gives no rows. A distance or sum that no 64-bit integer holds is null.
Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recfuse.llm.common import batched, stored

SIZE = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
#: Pivots, and how many pairs of them give bounds (those farthest apart).
PIVOTS = 6
PAIRS = 8
#: Components below this in size have squared distances that doubles hold exactly, for up to 64 components.
EXACT = 2.0**22
#: Share by which a bound is rounded down: many times the error of the products, roots and quotient in it.
SLACK = 1e-12
_LIMB = 60


def kept(embeddings: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, x: whole-numbered components (as doubles, which hold them exactly) of the usable vectors."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.lit(float(scale)) * e)
    # Doubles from 2**52 on are whole numbers already.
    floor = lambda e: F.when(F.abs(e) < 2.0**52, F.floor(e).cast("double")).otherwise(e)
    usable = (F.size("x") == size) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return embeddings.select("vec_id", whole.alias("x")).where(usable).select("vec_id", F.transform("x", floor).alias("x"))


def start_order(seed: str = SEED) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: str = SEED) -> list[list[int]]:
    """Components of the vectors with the least hashes, in their order."""
    found = vectors.select("x", start_order(seed).alias("_order")).orderBy("_order", "x").limit(clusters).collect()
    return [[int(e) for e in r["x"]] for r in found]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows, exactly: doubles if small enough, Python integers if not."""
    if not _small(x) or not _small(c):
        x, c = _whole(x), _whole(c)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def _small(x: np.ndarray) -> bool:
    return x.dtype != object and (x.size == 0 or float(np.abs(x).max()) < EXACT)


def _floats(x: np.ndarray) -> np.ndarray:
    """The nearest doubles; infinite for integers beyond them."""
    if x.dtype != object:
        return x
    return np.array([float(e) if e < 2**1023 else np.inf for e in x.ravel().tolist()]).reshape(x.shape)


def _whole(x: np.ndarray) -> np.ndarray:
    return np.array([[int(e) for e in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Whole numbers as doubles if these are small, else as Python integers."""
    if all(abs(e) < EXACT for row in rows for e in row):
        return np.array(rows, float).reshape(len(rows), -1)
    return np.array(rows, dtype=object).reshape(len(rows), -1)


@dataclass(frozen=True)
class Pivots:
    """Fixed points and the pairs of them that give bounds."""

    points: np.ndarray
    pairs: tuple[tuple[int, int, float], ...]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Of each row to each point, to the nearest double."""
        return np.sqrt(_floats(squares(x, self.points)))

    def bounds(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Least possible distance of each vector to each centroid, from their distances to the points."""
        out = np.zeros((len(x), len(c)))
        with np.errstate(invalid="ignore", over="ignore"):
            for p, q, apart in self.pairs:
                one, other = np.multiply.outer(x[:, p], c[:, q]), np.multiply.outer(x[:, q], c[:, p])
                low = (np.abs(one - other) - SLACK * (one + other)) * ((1 - SLACK) / apart)
                np.fmax(out, low, out=out)
        return np.where(np.isfinite(out), out, 0)


def choose_pivots(centroids: list[list[int]], count: int = PIVOTS, pairs: int = PAIRS) -> Pivots:
    """Points far from those before them, and the pairs with the largest distances."""
    points = _matrix(centroids)
    apart = np.sqrt(_floats(squares(points, points)))
    chosen = [0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(apart[chosen].min(axis=0).argmax()))
    found = sorted(((apart[a, b], i, j) for j, b in enumerate(chosen) for i, a in enumerate(chosen[:j]) if np.isfinite(apart[a, b]) and apart[a, b] > 0), reverse=True)
    return Pivots(points[chosen], tuple((i, j, float(d)) for d, i, j in found[:pairs]))


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and squared distance of each vector's nearest centroid (the smaller number of equal ones), and how many distances were measured."""
    bounds = pivots.bounds(to_pivots, pivots.distances(centroids))
    best = bounds.argmin(axis=1)
    if not _small(x) or not _small(centroids):
        x, centroids = _whole(x), _whole(centroids)
    least = np.empty(len(x), x.dtype)
    for c in np.unique(best):
        own = np.flatnonzero(best == c)
        least[own] = squares(x[own], centroids[c : c + 1])[:, 0]
    first = best.copy()
    # A centroid can win or tie only if the square of its bound isn't above the least distance so far.
    with np.errstate(over="ignore"):
        possible = np.square(bounds) * (1 - SLACK) <= _floats(least)[:, None] * (1 + SLACK)
    measured = len(x)
    for c in range(len(centroids)):
        own = np.flatnonzero(possible[:, c] & (first != c))
        if len(own):
            measured += len(own)
            found = squares(x[own], centroids[c : c + 1])[:, 0]
            closer = (found < least[own]) | ((found == least[own]) & (c < best[own]))
            best[own[closer]], least[own[closer]] = c, found[closer]
    return best, least, measured


def _arrays(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and their distances to the pivots."""
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    return flat("x").reshape(n, size), flat("to_pivots").reshape(n, -1)


def _with_pivots(vectors: DataFrame, pivots: Pivots, size: int) -> DataFrame:
    kind = vectors.schema["vec_id"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
                found = pivots.distances(x)
                offsets = pa.array(np.arange(batch.num_rows + 1) * found.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], ["vec_id", "x", "to_pivots"])

    return batched(vectors).mapInArrow(run, f"vec_id {kind}, x array<double>, to_pivots array<double>")


def _sums(points: DataFrame, centroids: np.ndarray, pivots: Pivots, size: int) -> list:
    """cluster, place, total of every cluster: its components, its rows (place -1) and its squared distances (place -2)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, to_pivots = _arrays(batch, size)
            best, least, _ = nearest(x, to_pivots, centroids, pivots)
            if not _small(x):
                x = _whole(x)
            for c in np.unique(best).tolist():
                own = best == c
                for place, total in enumerate([least[own].sum(), own.sum(), *x[own].sum(axis=0)], -2):
                    totals[c, place] = totals.get((c, place), 0) + int(total)
        cut = [(c, place, k, part) for (c, place), total in totals.items() for k, part in enumerate(_limbs(total))]
        if cut:
            columns = [pa.array(own, kind) for own, kind in zip(zip(*cut, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "limb", "part"])

    partial = points.mapInArrow(run, "cluster int, place int, limb int, part decimal(38,0)")
    out: dict[tuple[int, int], int] = {}
    for r in partial.groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part")).collect():
        key = r["cluster"], r["place"]
        out[key] = out.get(key, 0) + (int(r["part"]) << _LIMB * r["limb"])
    return [(*key, total) for key, total in out.items()]


def _limbs(value: int) -> Iterator[int]:
    """Parts of ``_LIMB`` bits, the least first; the last one has the sign. Their sums stay exact in a decimal column."""
    while not -(1 << _LIMB) <= value < 1 << _LIMB:
        yield value & ((1 << _LIMB) - 1)
        value >>= _LIMB
    yield value


def _long(value: int) -> int | None:
    return value if -(2**63) <= value < 2**63 else None


def clustered(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector.

    Each round assigns every vector and replaces each centroid that has vectors by the floor of their
    mean; then vectors are assigned once more. Runs a job for each round.
    """
    vectors = kept(embeddings, size, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, clusters, seed)
    if not centroids:
        return embeddings.sparkSession.createDataFrame([], rows)
    pivots = choose_pivots(centroids)
    points = batched(stored(_with_pivots(vectors, pivots, size), "vectors"))
    for _ in range(rounds):
        totals = {(c, place): total for c, place, total in _sums(points, _matrix(centroids), pivots, size)}
        centroids = [[totals[c, k] // totals[c, -1] for k in range(size)] if (c, -1) in totals else own for c, own in enumerate(centroids)]
    last = _matrix(centroids)
    spread = {c: total for c, place, total in _sums(points, last, pivots, size) if place == -2}
    inertia = [_long(spread.get(c, 0)) for c in range(len(centroids))]
    whole = _long(sum(spread.values()))
    digests = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in centroids]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best, least, _ = nearest(*_arrays(batch, size), last, pivots)
                own = best.tolist()
                columns = [
                    batch.column("vec_id"),
                    pa.array(own, pa.int32()),
                    pa.array([_long(int(d)) for d in least], pa.int64()),
                    pa.array([inertia[c] for c in own], pa.int64()),
                    pa.array([whole] * len(own), pa.int64()),
                    pa.array([digests[c] for c in own], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return points.mapInArrow(run, rows)
