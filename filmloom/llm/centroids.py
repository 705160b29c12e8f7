"""Clustering around centroids by exponion search.

Every vector keeps an upper bound of its distance to its own centroid and a
lower bound of that to all others. Where the lower bound, or half the way from
its centroid to the nearest other one, is beyond the upper bound, no other
centroid can be as near. Else only the centroids inside a ball around its own
one are looked at: those not farther from it than twice the upper bound and the
way to the nearest other, taken from a list sorted by distance, in stretches
that double. The ball holds its border, so centroids at equal distance are all
seen and the smaller number wins.

Components are whole numbers. Bounds are roots with a margin, decisions are
made on exact squared distances. A round is one pass over the vectors without a
shuffle: each task writes its vectors with their bounds and, beside them, one
row for each centroid with what joined it less what left it. What comes to the
driver are the sums of ``k`` centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids over ``size`` components, ``rounds`` of assigning and moving, components times ``scale``."""

    k: int = 40
    size: int = 64
    rounds: int = 5
    scale: int = 256
    salt: str = "2:"


#: Components beyond this have squared distances that no long holds.
MOST = 1 << 28
#: Components up to this have squared distances that doubles hold exactly.
EXACT = 1 << 22
MARGIN = 1e-9
SCHEMA = "vec_id long, v binary, cluster int, above double, below double, distance long, joined long, sums array<long>"


def whole_vectors(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """(vec_id, v array of long): floor(scale * x) of the vectors with ``size`` components, none null or not finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where((F.size("embedding") == how.size) & ~bad)
    over = F.exists("embedding", lambda e: F.abs(e * how.scale) > MOST)
    told = F.when(over, F.raise_error(F.lit(f"a component times {how.scale} is beyond {MOST}: its distances are no longs")))
    v = F.transform("embedding", lambda e: F.floor(e * how.scale).cast("long"))
    return kept.select("vec_id", F.when(told.isNull(), v).alias("v"))


def start(vectors: DataFrame, how: Clustering) -> np.ndarray:
    """The ``k`` vectors of the smallest hashes; equal ids by their components, those without an id last."""
    digest = F.sha2(F.concat(F.lit(how.salt), F.col("vec_id").cast("string")), 256)
    first = vectors.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(how.k)
    return np.array([r.v for r in first.collect()], np.int64).reshape(-1, how.size)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all of ``b``."""
    most = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if most <= EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], axis=1)


class Centroids:
    """Centroids with their lists of others by distance, and how far each has moved."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points, k = points, len(points)
        apart = np.sqrt(squared(points, points).astype(np.float64)) * (1 - MARGIN)
        np.fill_diagonal(apart, -1)  # each list starts with its own centroid
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, axis=1)
        self.near = self.apart[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((points - before).astype(np.float64) ** 2).sum(1)) * (1 + MARGIN)
        self.moved = moved
        far = np.sort(moved)[::-1]
        self.others = np.where(np.arange(k) == moved.argmax(), far[1] if k > 1 else 0, far[0]) if k else moved

    def nearest(self, v: np.ndarray, rows: np.ndarray, candidates: np.ndarray):
        """For ``rows`` of ``v``: the nearest of ``candidates``, its squared distance, the second's root."""
        d = squared(v[rows], self.points[candidates])
        least = d.min(axis=1)
        label = np.where(d == least[:, None], candidates, len(self.points)).min(axis=1)
        d[candidates == label[:, None]] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64)) if len(candidates) > 1 else np.full(len(rows), np.inf)
        return label, least, second

    def assign(self, v: np.ndarray, cluster: np.ndarray, above: np.ndarray, below: np.ndarray) -> int:
        """Move ``cluster`` and both bounds on to these centroids, in place; the number of distances looked at."""
        k, looked = len(self.points), 0
        above += self.moved[cluster]
        below -= self.others[cluster]
        open_ = np.flatnonzero(above >= np.maximum(below, self.near[cluster] / 2))
        if not len(open_):
            return 0
        own = self.own(v[open_], cluster[open_])
        looked += len(open_)
        above[open_] = np.sqrt(own.astype(np.float64)) * (1 + MARGIN)
        open_ = open_[above[open_] >= np.maximum(below[open_], self.near[cluster[open_]] / 2)]
        by = np.argsort(cluster[open_], kind="stable")
        open_ = open_[by]
        for rows in np.split(open_, np.flatnonzero(np.diff(cluster[open_])) + 1) if len(open_) else []:
            a = cluster[rows[0]]
            inside = np.searchsorted(self.apart[a], 2 * above[rows] + self.near[a], side="right") if k > 1 else np.ones(len(rows), int)
            stretch = np.minimum(1 << np.ceil(np.log2(np.maximum(inside, 1))).astype(int), k)
            for n in np.unique(stretch):
                some = rows[stretch == n]
                cluster[some], least, second = self.nearest(v, some, self.order[a, :n])
                above[some] = np.sqrt(least.astype(np.float64)) * (1 + MARGIN)
                # beyond the ball nothing is nearer than the second inside it
                below[some] = second * (1 - MARGIN)
                looked += int(n) * len(some)
        return looked

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        return ((v - self.points[cluster]) ** 2).sum(axis=1)


def _changes(v: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int):
    """(joined, sums) of each centroid: rows and components that came, less those that went."""
    joined, sums = np.zeros(k, np.int64), np.zeros((k, v.shape[1]), np.int64)
    moved = np.arange(len(v)) if before is None else np.flatnonzero(before != after)
    for labels, sign in ((after, 1), (before, -1)):
        if labels is not None and len(moved):
            np.add.at(joined, labels[moved], sign)
            np.add.at(sums, labels[moved], sign * v[moved])
    return joined, sums


def _pass(rows: DataFrame, points: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """``rows`` on the centroids ``points``, and the tasks' changes; in the ``last`` pass with exact distances."""
    centroids, k = Centroids(points, before), len(points)

    def part(cluster=None, vec_id=None, v=None, above=None, below=None, distance=None, joined=None, sums=None):
        n = len(cluster)
        return pa.RecordBatch.from_arrays(
            [x if x is not None else pa.nulls(n, t) for x, t in zip((vec_id, v, cluster, above, below, distance, joined, sums), TYPES)], NAMES
        )

    def run(batches: Iterator[pa.RecordBatch]):
        joined, sums, inertia = np.zeros(k, np.int64), np.zeros((k, points.shape[1]), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            width = points.shape[1]
            if before is None:
                v = batch.column(1).flatten().to_numpy().reshape(n, width)
                old = None
                cluster, least, second = centroids.nearest(v, np.arange(n), np.arange(k))
                above, below = np.sqrt(least.astype(np.float64)) * (1 + MARGIN), second * (1 - MARGIN)
            else:
                v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).astype(np.int64).reshape(n, width)
                old = batch.column(2).to_numpy().copy()
                cluster, above, below = old.copy(), batch.column(3).to_numpy().copy(), batch.column(4).to_numpy().copy()
                centroids.assign(v, cluster, above, below)
            distance = centroids.own(v, cluster)
            packed = None if last else pa.array([x.tobytes() for x in v.astype(np.int32)], pa.binary())
            cluster = cluster.astype(np.int32)
            if last:
                np.add.at(inertia, cluster, distance)
            else:
                more = _changes(v, old, cluster, k)
                joined, sums = joined + more[0], sums + more[1]
            kept = {"distance": pa.array(distance)} if last else {"v": packed, "above": pa.array(above), "below": pa.array(below)}
            yield part(pa.array(cluster), batch.column(0), **kept, joined=pa.nulls(n, pa.int64()))
        told = np.flatnonzero(inertia if last else (joined != 0) | sums.any(axis=1)).astype(np.int32)
        if len(told):
            what = {"joined": pa.array(inertia[told])} if last else {"joined": pa.array(joined[told]), "sums": pa.array(sums[told].tolist(), pa.list_(pa.int64()))}
            yield part(pa.array(told), **what)

    return rows.mapInArrow(run, SCHEMA)


TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
NAMES = ["vec_id", "v", "cluster", "above", "below", "distance", "joined", "sums"]


def _totals(written: DataFrame, size: int) -> dict[int, list[int]]:
    """What the tasks told of each centroid, added up: joined and sums. At most ``k`` rows."""
    told = written.where("joined is not null").groupBy("cluster")
    parts = [F.sum(F.get(F.col("sums"), F.lit(i))).alias(f"s{i}") for i in range(size)]
    return {r[0]: list(r)[1:] for r in told.agg(F.sum("joined"), *parts).collect()}


def clusters(vectors: DataFrame, how: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Null vectors and those of another size or with a null, infinite or NaN
    component are left out; of equal distances the smaller number is taken.
    Repeated rows are vectors of their own; null ids are kept and start a
    centroid only if there are too few others. With fewer vectors than ``k``
    there are as many centroids as vectors; an empty table gives an empty
    result. Components beyond 2**28 after scaling raise an error, for no long
    holds their distances. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, how)
    points, before = start(rows, how), None
    counts = np.zeros(len(points), np.int64)
    sums = [[0] * how.size for _ in range(len(points))]
    if not len(points):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for r in range(how.rounds):
        written = common.cut(_pass(rows, points, before, False), "centroids")
        for c, (joined, *more) in _totals(written, how.size).items():
            counts[c] += joined
            sums[c] = [a + b for a, b in zip(sums[c], more)]
        if r:
            common.drop(held)  # noqa: F821  the round before
        held = written
        rows, before = written.where("joined is null").select("vec_id", "v", "cluster", "above", "below"), points
        points = np.array([[s // int(n) for s in total] if n else old for total, n, old in zip(sums, counts, points.tolist())], np.int64)
    done = common.cut(_pass(rows, points, before, True), "centroids-done")
    if how.rounds:
        common.drop(held)
    inertia = {c: t[0] for c, t in _totals(done, 0).items()}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points.tolist()]
    table = [(c, int(inertia.get(c, 0)), sum(inertia.values()), digest[c]) for c in range(len(points))]
    named = spark.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = done.where("distance is not null").select("vec_id", "cluster", "distance")
    return out.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir) -> DataFrame:
    return clusters(common.table(spark, sf_dir, "embeddings"))


def _oracle(how: Clustering = Clustering()) -> str:
    """The same rounds, every vector against every centroid."""
    parts = [
        f"""
WITH x AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({how.scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {how.size} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {how.size}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{how.salt}' || vec_id), v) - 1 AS c, v FROM x ORDER BY c LIMIT {how.k}
)"""
    ]
    for r in range(how.rounds + 1):
        parts.append(f"""
, a{r} AS MATERIALIZED (
  SELECT vec_id, v, unnest(best, max_depth := 2) FROM (
    SELECT x.vec_id, any_value(x.v) AS v, min({{'d': list_sum(list_transform(list_zip(x.v, k.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': k.c}}) AS best
    FROM x, c{r} k GROUP BY x.vec_id, x.v)
)""")
        if r < how.rounds:
            parts.append(f"""
, m{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
    SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {how.size + 1}) t(i) GROUP BY c, i) GROUP BY c
), c{r + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{r} k LEFT JOIN m{r} m USING (c))""")
    n = how.rounds
    parts.append(f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM a{n} a JOIN c{n} k USING (c)""")
    return "".join(parts)


ORACLE = _oracle()
