"""Centroid clustering with equal-average equal-variance nearest neighbour search, in exact integers.

A vector of ``dim`` numbers is ``floor(scale * x)`` per component. Its mean and its deviation from that mean bound the distance to
a centroid from below: ``d(x, c)^2 >= dim * (mean x - mean c)^2 + (dev x - dev c)^2`` with ``dev`` the length of what is left
after the mean. Centroids are sorted by their mean; a search starts beside the vector's mean and goes outward. It ends where the
means alone are further apart than the best distance so far, skips centroids whose deviation rules them out, and takes the exact
distance of the rest. A bound only rejects what it proves to be further away, so ties still go to the smaller number.

A round is one pass over the table: tasks hand on one row of sums per centroid, the driver holds ``k x dim`` integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procspark.llm.common import arrow_map, only
from procspark.session import cut

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
_NARROW = 1 << 24  # up to this size, squares of sums over 64 components stay within 64 bits; wider numbers take Python's integers
_SLACK = 1e-9


def whole_rows(column: pa.Array, dim: int = DIM, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold exactly ``dim`` finite numbers, and these rows as integers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    x = pc.cast(column.filter(pa.array(good)).flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    finite = np.isfinite(x).all(axis=1)
    x = np.floor(scale * x[finite])
    good[good] = finite
    if len(x) and np.abs(x).max() >= 2 ** 62:
        return good, np.array([[int(v) for v in row] for row in x], dtype=object)
    return good, x.astype(np.int64)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of every row; of equal distances the smaller number."""
    n, dim = rows.shape
    if n and max(np.abs(rows).max(), np.abs(centroids).max()) > _NARROW:
        rows, centroids = rows.astype(object), centroids.astype(object)
    total, c_total = rows.sum(axis=1), centroids.sum(axis=1)
    dev = np.sqrt(((rows * rows).sum(axis=1) * dim - total * total).astype(float) / dim)
    c_dev = np.sqrt(((centroids * centroids).sum(axis=1) * dim - c_total * c_total).astype(float) / dim)
    order = np.argsort(c_total, kind="stable")
    sums, k = c_total[order], len(order)
    high = np.searchsorted(sums, total)
    low = high - 1
    best = np.full(n, -1, dtype=rows.dtype)
    which = np.full(n, k, dtype=np.int64)
    live = np.arange(n)
    for _ in range(k):
        lo, hi, t = low[live], high[live], total[live]
        down = np.where(lo >= 0, t - sums[np.maximum(lo, 0)], -1)
        up = np.where(hi < k, sums[np.minimum(hi, k - 1)] - t, -1)
        take_low = (lo >= 0) & ((hi >= k) | (down <= up))
        place = np.where(take_low, lo, hi)
        gap = np.where(take_low, down, up)
        low[live] -= take_low
        high[live] += ~take_low
        reach = best[live]
        open_ = (reach < 0) | (gap * gap <= reach * dim)  # means further apart than that end the search on both sides
        live, place, gap, reach = live[open_], place[open_], gap[open_], reach[open_]
        number = order[place]
        bound = (gap * gap).astype(float) / dim + (dev[live] - c_dev[number]) ** 2
        try_ = ((reach < 0) | (bound * (1 - _SLACK) - _SLACK <= reach.astype(float) * (1 + _SLACK))).astype(bool)
        at, number = live[try_], number[try_]
        off = rows[at] - centroids[number]
        d = (off * off).sum(axis=1)
        better = ((best[at] < 0) | (d < best[at]) | ((d == best[at]) & (number < which[at]))).astype(bool)
        best[at[better]], which[at[better]] = d[better], number[better]
        if not len(live):
            break
    return which, best


def _vectors(batch: pa.RecordBatch, dim: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    good, x = whole_rows(batch.column(1), dim, scale)
    return batch.column(0).filter(pa.array(good)), x


def first_centroids(table: DataFrame, k: int = CENTROIDS, seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """The ``k`` vectors with the smallest digest of ``seed:id``, in that order; rows of one id by their components. A null id is an empty one."""
    id_col = table.columns[0]
    id_type = table.schema[0].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, x = _vectors(batch, dim, scale)
        return pa.RecordBatch.from_arrays([ids, pa.array(x.tolist(), pa.list_(pa.int64()))], names=[id_col, "v"])

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    picked = arrow_map(table, run, f"`{id_col}` {id_type}, v array<bigint>").select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k)
    found = [r.v for r in picked.collect()]
    return np.array(found, dtype=np.int64).reshape(len(found), dim)


def moved(table: DataFrame, centroids: np.ndarray, dim: int = DIM, scale: int = SCALE) -> np.ndarray:
    """Every centroid with rows becomes the componentwise floor of their mean; one pass, ``k`` rows of sums from each task."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            _, x = _vectors(batch, dim, scale)
            which, _ = nearest(x, centroids)
            count += np.bincount(which, minlength=k)
            for c in range(k):
                sums[c] += x[which == c].sum(axis=0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(count), pa.array(sums.tolist(), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])

    parts = table.mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>").filter("n > 0")
    each = parts.select("cluster", "n", F.posexplode("sums").alias("place", "s")).groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    new = centroids.copy()
    for r in each:
        new[r.cluster, r.place] = r.s // r.n
    return new


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
            seed: int = SEED, dim: int = DIM, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``id, cluster, distance`` (squared) of every vector, and the centroids.

    Rows without exactly ``dim`` finite numbers are left out; repeated rows count as often as they come; a null id is kept. With fewer
    than ``k`` vectors there are as many centroids as vectors, with none the result is empty. Squared distances and sums of
    components must fit 64 bits, else the run ends with an overflow error. The result is frozen in the shared folder.
    """
    table = only(table, id_col, vector_col)
    id_type = table.schema[0].dataType.simpleString()
    centroids = first_centroids(table, k, seed, dim, scale)
    schema = f"`{id_col}` {id_type}, cluster int, distance bigint"
    if not len(centroids):
        return table.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        new = moved(table, centroids, dim, scale)
        if (new == centroids).all():  # nothing can move any more
            break
        centroids = new

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, x = _vectors(batch, dim, scale)
        which, d = nearest(x, centroids)
        return pa.RecordBatch.from_arrays([ids, pa.array(which.astype(np.int32)), pa.array(d.tolist(), pa.int64())], names=[id_col, "cluster", "distance"])

    return cut(arrow_map(table, run, schema)), centroids


def clusters(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **settings: int) -> DataFrame:
    """``cluster`` with the sums of distances over each cluster and over all, and a digest of each centroid."""
    found, centroids = cluster(table, id_col, vector_col, **settings)
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    told = [(c, s, sum(per.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(per.items())]
    notes = table.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(notes), "cluster").select(f"`{id_col}`", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
