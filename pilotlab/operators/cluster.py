"""K-means with several starts, silhouettes and the choice of the number of clusters.

All starts of all candidates advance together: a round is one pass in which every task multiplies its
rows with the stacked centres of the starts that still move and passes on a sum per centre. The rows are
packed once into blocks of bytes, which the rounds read as they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

# First centres are drawn from about so many rows; every round, cost and silhouette covers all rows.
START_ROWS = 20_000
# A start has converged when the squared moves of its centres add up to less than this share of the
# mean variance of the features.
TOLERANCE = 1e-4
ROWS_AT_ONCE = 4096


def _points(df: DataFrame, features: str) -> DataFrame:
    """One column ``x`` of plain arrays."""
    if isinstance(df.schema[features].dataType, ArrayType):
        return df.select(F.col(features).cast("array<double>").alias("x"))
    return df.select(vector_to_array(features).alias("x"))


def _blocks(points: DataFrame) -> DataFrame:
    """The rows as ``block``s, plain bytes of up to ``ROWS_AT_ONCE`` rows, for passes that multiply them all."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), ROWS_AT_ONCE):
                values = batch.column(0).slice(first, ROWS_AT_ONCE).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([values.astype("<f8").tobytes()], pa.binary())], ["block"])

    return points.mapInArrow(pack, "block binary")


def _matrices(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column(0):
            yield np.frombuffer(block.as_buffer(), "<f8").reshape(-1, width)


def _squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1), 0.0)


def _gathered(blocks: DataFrame, stacks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each stack of centres: rows, sums of rows and sums of squared lengths of the rows nearest to each
    centre (the first on ties), and the sum of their squared distances."""
    width, bounds = stacks[0].shape[1], np.cumsum([0, *map(len, stacks)])
    centers = np.concatenate(stacks)

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns: features, rows, squared lengths, squared distances.
        total = np.zeros((len(centers), width + 3))
        for x in _matrices(batches, width):
            distance = _squared_distances(x, centers)
            nearest = np.stack([low + distance[:, low:high].argmin(axis=1) for low, high in zip(bounds, bounds[1:])], axis=1)
            own = np.zeros(distance.shape)
            np.put_along_axis(own, nearest, 1.0, axis=1)
            total[:, :width] += own.T @ x
            total[:, width] += own.sum(axis=0)
            total[:, width + 1] += own.T @ (x * x).sum(axis=1)
            total[:, width + 2] += (own * distance).sum(axis=0)
        c, d = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), pa.array(total[c, d])], ["c", "d", "v"])

    total = np.zeros((len(centers), width + 3))
    for r in blocks.mapInArrow(add_up, "c int, d int, v double").groupBy("c", "d").agg(F.sum("v").alias("v")).collect():
        total[r["c"], r["d"]] = r["v"]
    return [
        (t[:, width], t[:, :width], t[:, width + 1], float(t[:, width + 2].sum()))
        for t in (total[low:high] for low, high in zip(bounds, bounds[1:]))
    ]


def _first_centers(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Rows far from those drawn before (k-means++); fewer where the sample has fewer distinct rows."""
    chosen = [sample[rng.integers(len(sample))]]
    distance = _squared_distances(sample, chosen[0][None])[:, 0]
    while len(chosen) < k:
        distance[distance <= 1e-12 * (1 + distance.max())] = 0.0
        if not distance.any():
            break
        chosen.append(sample[rng.choice(len(sample), p=distance / distance.sum())])
        distance = np.minimum(distance, _squared_distances(sample, chosen[-1][None])[:, 0])
    return np.array(chosen)


def _settled(sample: np.ndarray, centers: np.ndarray, limit: float, rounds: int) -> np.ndarray:
    """Centres after rounds over the sample alone, which save rounds over all rows."""
    for _ in range(rounds):
        nearest = _squared_distances(sample, centers).argmin(axis=1)
        own = np.zeros((len(centers), len(sample)))
        own[nearest, np.arange(len(sample))] = 1.0
        counts = own.sum(axis=1)
        moved = np.where(counts[:, None] > 0, own @ sample / np.maximum(counts, 1)[:, None], centers)
        settled = ((moved - centers) ** 2).sum() <= limit
        centers = moved
        if settled:
            break
    return centers


@dataclass(frozen=True)
class Centers:
    """Cluster centres, by number, and the sum of squared distances of all rows to the nearest."""

    points: np.ndarray
    cost: float

    def assign(self, df: DataFrame, features: str = "features", output: str = "prediction") -> DataFrame:
        x = F.col(features) if isinstance(df.schema[features].dataType, ArrayType) else vector_to_array(features)
        return df.withColumn(output, nearest_centroid(x, list(enumerate(self.points.tolist()))))


def best_kmeans(
    df: DataFrame,
    candidates: tuple[int, ...],
    seed: int = 42,
    starts: int = 10,
    max_iter: int = 300,
    features: str = "features",
) -> dict[int, Centers]:
    """Per k, the centres with the lowest cost out of several starts; ``df`` should be stored or persisted.

    A start draws and settles its first centres on about ``START_ROWS`` rows, taken by a hash of the
    features, and then moves over all rows until it has converged; starts that have, leave. A centre
    without rows stays where it is. Results do not depend on the layout of the rows, but for the last
    bits of sums. With fewer distinct rows than k there are fewer centres; without rows it is an error.
    """
    points = _points(df, features)
    place = F.pmod(F.xxhash64("x"), F.lit(1 << 20))
    n = points.count()
    drawn = points if n <= START_ROWS else points.where(place < F.lit(int((1 << 20) * START_ROWS / n) + 1))
    rows = [r["x"] for r in drawn.orderBy(F.xxhash64("x"), "x").limit(4 * START_ROWS).collect()]
    if not rows:
        raise ValueError("there are no rows to cluster")
    sample = np.array(rows, dtype=float).reshape(len(rows), -1)
    jobs = [(k, start) for k in candidates for start in range(starts)]
    limit = TOLERANCE * float(sample.var(axis=0).mean())
    draws = [np.random.default_rng([seed, k, start]) for k, start in jobs]
    centers = [_settled(sample, _first_centers(sample, k, rng), limit, max_iter) for (k, _), rng in zip(jobs, draws)]
    moving, costs = list(range(len(jobs))), [0.0] * len(jobs)
    blocks = _blocks(points).persist()
    try:
        for _ in range(max_iter):
            still = []
            for i, (counts, sums, _, cost) in zip(moving, _gathered(blocks, [centers[i] for i in moving])):
                moved = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers[i])
                if ((moved - centers[i]) ** 2).sum() > limit:
                    still.append(i)
                centers[i] = moved
            moving = still
            if not moving:
                break
        for i, (*_, cost) in enumerate(_gathered(blocks, centers)):
            costs[i] = cost
    finally:
        blocks.unpersist()
    best: dict[int, Centers] = {}
    for (k, _), points_of, cost in zip(jobs, centers, costs):
        if k not in best or cost < best[k].cost * (1 - 1e-9):
            best[k] = Centers(points_of, cost)
    return best


def silhouette(df: DataFrame, features: str = "features", cluster: str = "prediction") -> tuple[float, str]:
    """Mean silhouette by squared Euclidean distances, the same measure for tables of any size.

    It takes one aggregate per cluster and one pass over the rows.
    """
    evaluator = ClusteringEvaluator(
        featuresCol=features, predictionCol=cluster, distanceMeasure="squaredEuclidean"
    )
    return evaluator.evaluate(df), "squaredEuclidean"


def silhouettes(df: DataFrame, candidates: dict[int, Centers], features: str = "features") -> dict[int, float | None]:
    """The same measure for several sets of centres, each row in the cluster of its nearest centre.

    One pass takes rows, sums and squared lengths of all clusters of all sets; the mean squared
    distance to a cluster's rows follows from them, so a second pass adds up the silhouettes of all
    sets. A set with fewer than two clusters that have rows has none; a row alone in its cluster counts as 0.
    """
    blocks, keys = _blocks(_points(df, features)), list(candidates)
    stacks = [candidates[k].points for k in keys]
    facts = [(counts, sums, squares) for counts, sums, squares, _ in _gathered(blocks, stacks)]
    width = stacks[0].shape[1]

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(stacks))
        for x in _matrices(batches, width):
            length = (x * x).sum(axis=1)[:, None]
            for s, (centers, (counts, sums, squares)) in enumerate(zip(stacks, facts)):
                at = np.arange(len(x)), _squared_distances(x, centers).argmin(axis=1)
                # Sums of squared distances to all rows of each cluster.
                sums_to = np.maximum(length * counts - 2 * x @ sums.T + squares, 0.0)
                inside = sums_to[at] / np.maximum(counts[at[1]] - 1, 1)
                other = np.where(counts > 0, sums_to / np.maximum(counts, 1), np.inf)
                other[at] = np.inf
                outside = other.min(axis=1)
                larger = np.maximum(inside, outside)
                value = np.where(larger > 0, (outside - inside) / np.where(larger > 0, larger, 1.0), 0.0)
                total[s] += value[counts[at[1]] > 1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(stacks)), pa.int32()), pa.array(total)], ["s", "v"])

    several = {s for s, (counts, _, _) in enumerate(facts) if (counts > 0).sum() > 1}
    if not several:
        return dict.fromkeys(keys)
    rows = blocks.mapInArrow(add_up, "s int, v double").groupBy("s").agg(F.sum("v").alias("v")).collect()
    found = {r["s"]: float(r["v"] / facts[r["s"]][0].sum()) for r in rows}
    return {k: found[s] if s in several else None for s, k in enumerate(keys)}


@dataclass(frozen=True)
class KChoice:
    k: int
    model: Centers
    scores: list[tuple[int, float | None, str]]

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(k, s, m, k == self.k) for k, s, m in self.scores]
        return df.sparkSession.createDataFrame(rows, "k int, silhouette double, measure string, chosen boolean")


def choose_k(
    df: DataFrame,
    candidates: tuple[int, ...] = (3, 4, 5, 6),
    seed: int = 42,
    starts: int = 10,
) -> KChoice:
    """The candidate with the highest silhouette, the smallest on ties; ``df`` should be stored or persisted."""
    models = best_kmeans(df, tuple(sorted(candidates)), seed, starts)
    values = silhouettes(df, models)
    best = max(models, key=lambda k: (-np.inf if values[k] is None else values[k], -k))
    return KChoice(best, models[best], [(k, values[k], "squaredEuclidean") for k in models])


def nearest_centroid(vector: Column, centroids: list[tuple[int, list[float]]]) -> Column:
    """Id of the closest centroid by squared distance, the smallest id on ties."""
    distances = []
    for identity, center in centroids:
        point = F.array(*[F.lit(float(v)) for v in center])
        squares = F.zip_with(vector, point, lambda a, b: (a - b) * (a - b))
        distance = F.aggregate(squares, F.lit(0.0), lambda total, s: total + s)
        distances.append(F.struct(distance.alias("distance"), F.lit(identity).alias("id")))
    return F.array_min(F.array(*distances))["id"]


def cluster_profile(df: DataFrame, cluster: str, columns: list[str]) -> DataFrame:
    """Cluster size and mean of each numeric column in its own units."""
    return df.groupBy(cluster).agg(
        F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns]
    )
