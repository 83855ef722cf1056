"""Centroid clustering in integers with PCA-rotated filtering.

Components are scaled and floored to integers, centroids are integers, and so are all distances that decide anything.
To spare most of them, vectors are stored once with their ``lead`` leading coordinates in the axes of the covariance
matrix of all vectors and the norm of the rest.  For a centroid rotated likewise, the squared distance of the leading
coordinates plus the squared difference of the two rest norms is a lower bound of the squared distance.  Only centroids
whose bound, less an allowance for rounding, does not exceed the best distance so far are verified in integers.

What reaches the driver are component sums: one row a centroid and a matrix of the vector's width, whatever the table.
Rows whose vector is null, of another width, or has a null or non-finite component are left out.  Rows that repeat an id
are clustered each by its own vector; a missing id counts as empty text where seeds are chosen.  Ties go to the smaller
centroid, ties among seeds to the smaller vector.  With fewer vectors than centroids asked for there are as many
centroids as vectors; an empty table gives an empty result.  A scaled component of 2 ** 27 or more is an error, as
squared distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import ship
from quantgap.session import cut_lineage, result_table

LEAD = 16
LIMIT = 1 << 27
ALLOWANCE = 1e-9  # of the squared norms; the bound's own rounding stays below 1e-12

ship(__name__)


def scaled(vectors: DataFrame, vec_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """``(vec_id, q)``: the complete finite vectors as integers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where((F.size("v") == width) & F.forall("v", fine))
    inside = F.forall("v", lambda x: F.abs(x) * scale < LIMIT - 1)
    checked = F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<double>"))
    return rows.select("vec_id", F.transform(checked, lambda x: F.floor(x * scale).cast("int")).alias("q"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(-1, width)


def _sums(per_task: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays added up place by place: ``(*keys, place, total)``."""
    return per_task.select(*keys, F.posexplode("amounts").alias("place", "amount")).groupBy(*keys, "place").agg(F.sum("amount").alias("total"))


def principal_axes(table: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and axes (columns, by falling variance) of all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = _matrix(batch.column(0), width, np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["amounts"])

    found = _sums(table.select("q").mapInArrow(moments, "amounts array<double>"), []).collect()  # 1 + width + width ** 2 numbers
    total = np.zeros(1 + width + width * width)
    for place, amount in found:
        total[place] = amount
    rows = max(total[0], 1.0)
    mean = total[1 : width + 1] / rows
    spread = total[width + 1 :].reshape(width, width) / rows - np.outer(mean, mean)
    return mean, np.linalg.eigh(spread)[1][:, ::-1]


def rotated(x: np.ndarray, mean: np.ndarray, axes: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of the others."""
    turned = (x - mean) @ axes
    return turned[:, :lead], np.sqrt((turned[:, lead:] ** 2).sum(axis=1))


def nearest(q: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid, squared distance to it, and how many distances were verified."""
    bound = ((lead[:, None, :] - c_lead[None]) ** 2).sum(axis=2) + (rest[:, None] - c_rest[None]) ** 2
    norms = ((lead**2).sum(axis=1) + rest**2)[:, None] + ((c_lead**2).sum(axis=1) + c_rest**2)[None]
    bound -= ALLOWANCE * (norms + 1)
    first = bound.argmin(axis=1)
    best, distance, verified = first.copy(), ((q - centroids[first]) ** 2).sum(axis=1), len(q)
    for c in range(len(centroids)):
        open_rows = np.flatnonzero((bound[:, c] <= distance) & (first != c))
        exact = ((q[open_rows] - centroids[c]) ** 2).sum(axis=1)
        verified += len(open_rows)
        closer = (exact < distance[open_rows]) | ((exact == distance[open_rows]) & (c < best[open_rows]))
        best[open_rows[closer]], distance[open_rows[closer]] = c, exact[closer]
    return best, distance, verified


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3", lead: int = LEAD
) -> tuple[DataFrame, DataFrame]:
    """Members ``(vec_id, cluster, distance)`` and centroids ``(cluster, centroid)`` after ``rounds`` of Lloyd's steps.

    The first centroids are the ``k`` vectors whose ``seed:vec_id`` has the smallest SHA-256.  A centroid moves to the
    floored mean of its vectors, one without vectors stays.
    """
    spark = vectors.sparkSession
    table = cut_lineage(scaled(vectors, vec_id, vector, width, scale), "vectors")
    mark = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = [row.q for row in table.select(mark.alias("mark"), "q").orderBy("mark", "q").limit(k).collect()]
    centroids = np.array(seeds, dtype=np.int64).reshape(-1, width)
    mean, axes = principal_axes(table, width)

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            front, rest = rotated(_matrix(batch.column(1), width, np.float64), mean, axes, lead)
            offsets = pa.array(np.arange(0, front.size + 1, lead, dtype=np.int32))
            front = pa.ListArray.from_arrays(offsets, pa.array(front.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, front, pa.array(rest)], names=["vec_id", "q", "lead", "rest"])

    kind = table.schema["vec_id"].dataType.simpleString()
    stored = cut_lineage(table.mapInArrow(rotate, f"vec_id {kind}, q array<int>, lead array<double>, rest double"), "rotated")

    def assign(centroids: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        c_lead, c_rest = rotated(centroids.astype(np.float64), mean, axes, lead)

        def one(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q = _matrix(batch.column("q"), width, np.int64)
            best, distance, _ = nearest(q, _matrix(batch.column("lead"), lead, np.float64), np.asarray(batch.column("rest")), centroids, c_lead, c_rest)
            return q, best, distance

        return one

    for _ in range(rounds if len(centroids) else 0):
        to = assign(centroids)
        count = len(centroids)

        def add(batches: Iterator[pa.RecordBatch], to=to, count=count) -> Iterator[pa.RecordBatch]:
            total = np.zeros((count, 1 + width), np.int64)
            for batch in batches:
                q, best, _ = to(batch)
                for c in range(count):
                    mine = q[best == c]
                    total[c, 0] += len(mine)
                    total[c, 1:] += mine.sum(axis=0)
            amounts = pa.array(total.tolist(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), amounts], names=["cluster", "amounts"])

        summed = _sums(stored.select("q", "lead", "rest").mapInArrow(add, "cluster int, amounts array<bigint>"), ["cluster"])
        sums = {(row.cluster, row.place): int(row.total) for row in summed.collect()}  # count * (1 + width) numbers
        for c in range(count):
            size = sums.get((c, 0), 0)
            if size:
                centroids[c] = [sums[c, 1 + place] // size for place in range(width)]
        centroids = centroids.copy()  # the functions of earlier rounds keep theirs

    places = result_table(spark, "cluster int, centroid array<bigint>", [(c, row.tolist()) for c, row in enumerate(centroids)])
    to = assign(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, best, distance = to(batch)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    members = f"vec_id {kind}, cluster int, distance bigint"
    if not len(centroids):
        return spark.createDataFrame([], members), places
    return cut_lineage(stored.mapInArrow(place, members), "members"), places


def with_inertia(members: DataFrame) -> DataFrame:
    """Members with the distance summed over their cluster and over all: ``cluster_inertia, inertia``."""
    found = members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()  # a row a centroid
    inertia = int(sum(total for _, total in found))
    sums = result_table(members.sparkSession, "cluster int, cluster_inertia bigint, inertia bigint", [(c, int(total), inertia) for c, total in found])
    return members.join(F.broadcast(sums), "cluster")
