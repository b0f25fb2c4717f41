"""From the segmentation table to ranked segments, and the use of the stored model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cluster import KChoice, choose_k, cluster_profile, nearest_centroid
from ..operators.features import FeatureColumns, fit_features, with_features
from ..operators.profile import category_shares, mode_by_group
from ..operators.ranking import (
    UNKNOWN_LABEL, population_stats, priority_labels, rank_clusters, with_priority_score, z_sum,
)
from ..operators.skew import SMALL_DIMS_ROWS
from . import spec

SEGMENT_FEATURES = FeatureColumns(spec.SEGMENT_NUMERIC, spec.CATEGORICAL, spec.SEGMENT_BOOLEAN)


@dataclass(frozen=True)
class SegmentModel:
    """Everything needed to score a client: prepared features, centres, cluster names, population statistics.

    ``clusters`` maps a centre's own number to the published number and label. Without centres every
    client is of an unknown segment.
    """

    pipeline: PipelineModel
    clusters: dict[int, tuple[int, str]]
    means: dict[str, float]
    stds: dict[str, float]
    required: tuple[str, ...] = tuple(SEGMENT_FEATURES.all)
    priority: tuple[str, ...] = spec.PRIORITY_COLUMNS
    centers: tuple[tuple[float, ...], ...] = ()

    def save(self, spark: SparkSession, folder: str) -> None:
        self.pipeline.write().overwrite().save(f"{folder}/pipeline")
        spark.createDataFrame(
            [(raw, published, label) for raw, (published, label) in self.clusters.items()],
            "raw_cluster int, cluster_id int, segment string",
        ).write.mode("overwrite").parquet(f"{folder}/clusters")
        spark.createDataFrame(
            [(i, list(c)) for i, c in enumerate(self.centers)], "raw_cluster int, center array<double>"
        ).write.mode("overwrite").parquet(f"{folder}/centers")
        spark.createDataFrame(
            [(c, self.means[c], self.stds[c]) for c in self.priority],
            "column string, mean double, std double",
        ).write.mode("overwrite").parquet(f"{folder}/population")
        spark.createDataFrame(
            [(i, c) for i, c in enumerate(self.required)], "position int, column string"
        ).write.mode("overwrite").parquet(f"{folder}/required")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> SegmentModel:
        clusters = spark.read.parquet(f"{folder}/clusters").collect()
        population = spark.read.parquet(f"{folder}/population").collect()
        centers = spark.read.parquet(f"{folder}/centers").orderBy("raw_cluster").collect()
        required = spark.read.parquet(f"{folder}/required").orderBy("position").collect()
        return SegmentModel(
            PipelineModel.load(f"{folder}/pipeline"),
            {r["raw_cluster"]: (r["cluster_id"], r["segment"]) for r in clusters},
            {r["column"]: r["mean"] for r in population},
            {r["column"]: r["std"] for r in population},
            tuple(r["column"] for r in required),
            tuple(r["column"] for r in population),
            tuple(tuple(r["center"]) for r in centers),
        )

    def _published(self, field: int, missing: Column) -> Column:
        out = missing
        for raw, names in self.clusters.items():
            out = F.when(F.col("prediction") == raw, F.lit(names[field])).otherwise(out)
        return out

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds ``cluster_id, segment, priority_score`` to feature rows, batch or streaming.

        The statistics are those of the training population. A null in a present column is imputed as
        in training; a missing column is an error.
        """
        absent = [c for c in self.required if c not in rows.columns]
        if absent:
            raise ValueError(f"required columns are missing: {absent}")
        z = z_sum(
            self.priority,
            {c: F.lit(self.means[c]) for c in self.priority},
            {c: F.lit(self.stds[c]) for c in self.priority},
        )
        centers = [(i, list(c)) for i, c in enumerate(self.centers)]
        nearest = nearest_centroid(vector_to_array("features"), centers) if centers else F.lit(None).cast("int")
        return self.pipeline.transform(rows).withColumn("prediction", nearest).select(
            *rows.columns,
            self._published(0, F.col("prediction")).cast("int").alias("cluster_id"),
            self._published(1, F.lit(UNKNOWN_LABEL)).alias("segment"),
            F.round(z, 4).alias("priority_score"),
        )


@dataclass(frozen=True)
class Segmentation:
    model: SegmentModel
    choice: KChoice
    clients: DataFrame
    ranking: DataFrame

    def profile(self) -> DataFrame:
        """Size and mean of each numeric feature per cluster, in the features' own units."""
        return cluster_profile(self.clients, "cluster_id", list(spec.SEGMENT_NUMERIC))

    def modes(self) -> DataFrame:
        """Most frequent city and channel per cluster: ``cluster_id, variable, value, n``."""
        out = None
        for c in spec.CATEGORICAL:
            part = mode_by_group(self.clients, "cluster_id", c).select(
                "cluster_id", F.lit(c).alias("variable"), F.col(c).alias("value"), "n"
            )
            out = part if out is None else out.unionByName(part)
        return out

    def distribution(self) -> DataFrame:
        """Number and share of clients per segment."""
        return category_shares(self.clients, ["segment"])


def segment_clients(
    base: DataFrame,
    candidates: tuple[int, ...] = (3, 4, 5, 6),
    seed: int = 42,
    starts: int = 10,
    columns: FeatureColumns = SEGMENT_FEATURES,
    priority: tuple[str, ...] = spec.PRIORITY_COLUMNS,
) -> Segmentation:
    """Chooses k, clusters, ranks and labels the clients of the segmentation table.

    Published cluster numbers follow the ranking (0 is the highest priority), because the numbers
    k-means assigns mean nothing. ``base`` is read many times; pass a stored table.
    """
    prepared = fit_features(base, columns)
    ready = with_features(base, prepared).persist()
    try:
        choice = choose_k(ready, candidates, seed, starts)
        stats = population_stats(base, priority).first()
        scored = with_priority_score(choice.model.assign(ready), priority)
        ranking = rank_clusters(scored, "prediction", "priority_score").orderBy("rank").collect()
    finally:
        ready.unpersist()
    labels = priority_labels(len(ranking))
    model = SegmentModel(
        prepared,
        {r["prediction"]: (i, labels[i]) for i, r in enumerate(ranking)},
        {c: stats["mean"][c] or 0.0 for c in priority},
        {c: stats["std"][c] or 0.0 for c in priority},
        tuple(columns.all),
        priority,
        tuple(map(tuple, choice.model.points.tolist())),
    )
    clients = model.score(base).drop("priority_score")
    clients = with_priority_score(clients, priority).select(
        "client_id", "cluster_id", "segment", "priority_score", *columns.all
    )
    table = base.sparkSession.createDataFrame(
        [(i, labels[i], r["n"], r["mean_score"]) for i, r in enumerate(ranking)],
        "cluster_id int, segment string, n bigint, mean_score double",
    )
    return Segmentation(model, choice, clients, table)


def lookup_clients(requests: DataFrame, segmented: DataFrame, key: str = "client_id") -> DataFrame:
    """Stored result per requested id, with ``found``; ids compare as text.

    The stored table is first reduced to the requested ids: a short list of ids, counted first, is
    broadcast to the scan, so only matching rows are moved.
    """
    stored = segmented.withColumn("_key", F.col(key).cast("string")).drop(key).withColumn("_found", F.lit(True))
    wanted = requests.withColumn("_key", F.col(key).cast("string"))
    ids = wanted.select("_key").distinct()
    if ids.count() <= SMALL_DIMS_ROWS:
        ids = F.broadcast(ids)
    return (
        wanted.join(stored.join(ids, "_key", "left_semi"), "_key", "left")
        .withColumn("found", F.coalesce("_found", F.lit(False)))
        .drop("_key", "_found")
    )


# Types of the request fields; anything else in a request is ignored.
REQUEST_TYPES = {**dict.fromkeys(spec.SEGMENT_NUMERIC + spec.SEGMENT_BOOLEAN, "double"),
                 **dict.fromkeys(spec.CATEGORICAL, "string")}


def read_requests(
    requests: DataFrame, body: str, required: tuple[str, ...] = tuple(SEGMENT_FEATURES.all)
) -> DataFrame:
    """JSON requests with ``_row``, the features, and the names of ``missing`` and ``unreadable`` fields.

    A field may be null but must be there; text that is no JSON object lacks every field. A value that
    is there and is not of the field's type is unreadable.
    """
    schema = ", ".join(f"`{c}` {REQUEST_TYPES.get(c, 'double')}" for c in required)
    wanted = F.array(*[F.lit(c) for c in required])
    present = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    texts = ", ".join(f"`{c}` string" for c in required)
    read = requests.withColumn("_row", F.from_json(body, schema)).withColumn("_text", F.from_json(body, texts))
    unreadable = F.array_compact(F.array(*[
        F.when(F.col(f"_text.`{c}`").isNotNull() & F.col(f"_row.`{c}`").isNull(), F.lit(c)) for c in required
    ]))
    checked = read.withColumn("missing", F.array_except(wanted, present)).withColumn("unreadable", unreadable)
    return checked.drop("_text")


def split_requests(read: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the good requests, and the rejected ones with what is wrong with them."""
    good = (F.size("missing") == 0) & (F.size("unreadable") == 0)
    return read.where(good).select(*columns, "_row.*"), read.where(~good).select(*columns, "missing", "unreadable")


def parse_requests(
    requests: DataFrame, body: str, required: tuple[str, ...] = tuple(SEGMENT_FEATURES.all)
) -> tuple[DataFrame, DataFrame]:
    """JSON requests as feature rows, and the rejected ones."""
    return split_requests(read_requests(requests, body, required), requests.columns)
