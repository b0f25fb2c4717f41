"""Exact top-k search by inner product as a Voronoi join.

Vectors belong to the cell of their nearest pivot. For a query q and a vector x in the cell of pivot
p, ``q.x <= q.p + |q| * d(x, p)``, so a cell's summary bounds what it can hold for a query. Queries
first meet the blocks of a few cells with the best bounds, which fixes a score that their k-th best reaches.
Then they visit only those blocks of other cells whose bound is not below it. Blocks and query
groups have a bounded size; each meeting is one matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut_lineage
from .memory import releasing, releasing_pair

PIVOTS = 64
PIVOT_SAMPLE = 4096  # rows, by hash of the key, from which pivots are chosen
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
FIRST_CELLS = 2

Rows = Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of vectors as integers; shorter ones are padded with zeros."""
    lists = column.cast(pa.large_list(pa.int64()))
    out = np.zeros((len(lists), width), dtype=np.int64)
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    rows = np.repeat(np.arange(len(lists)), lengths)
    columns = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], lengths)
    out[rows, columns] = lists.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` and ``b``; as floats where these are exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def scaled(vectors: Column, factor: int) -> Column:
    """``floor(factor * x)`` of each component as a double; null unless all are finite."""
    doubles = vectors.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(vectors.isNotNull() & ~bad, F.transform(doubles, lambda x: F.floor(x * factor)))


def _choose_pivots(rows: DataFrame, width: int) -> np.ndarray:
    """Well separated rows of a bounded sample, each the farthest from those before it."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(PIVOT_SAMPLE).select("v").toArrow()
    points = matrix(sample["v"].combine_chunks(), width).astype(np.float64)
    if not len(points):
        return np.zeros((1, width))
    chosen = [0]
    distance = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(PIVOTS, len(points)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def _assign(pivots: np.ndarray) -> Rows:
    width = pivots.shape[1]
    lengths = (pivots**2).sum(axis=1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width).astype(np.float64)
            square = (x**2).sum(axis=1)[:, None] + lengths - 2 * x @ pivots.T
            cell = square.argmin(axis=1)
            # Exactly from the difference: the expansion loses digits for near vectors.
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"]
            )

    return run


def _bounds(pivots: np.ndarray, cells: np.ndarray, reach: np.ndarray) -> Rows:
    """For each query, every filled cell with the bound of what it can score there."""
    centres = pivots[cells]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), QUERY_ROWS):
                part = batch.slice(first, QUERY_ROWS)
                q = matrix(part.column(1), pivots.shape[1]).astype(np.float64)
                at = q @ centres.T
                # A margin for rounding keeps the bound above every true score.
                bound = at + np.linalg.norm(q, axis=1)[:, None] * reach
                bound += 1e-9 * (np.abs(at) + np.abs(bound)) + 1e-3
                order = np.argsort(-bound, axis=1, kind="stable")
                n = len(cells)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)),
                        pa.array(cells[order].ravel().astype(np.int32)),
                        pa.array(np.take_along_axis(bound, order, 1).ravel()),
                        pa.array(np.tile(np.arange(n, dtype=np.int32), len(part))),
                    ],
                    ["query", "cell", "bound", "place"],
                )

    return run


def _meet(width: int, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of a block's rows for each query of a group, ties to the smaller id."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        if len(queries) and len(block):
            ids, rows = block["id"].to_numpy(), block["row"].to_numpy()
            order = np.lexsort((rows, ids))
            ids, rows = ids[order], rows[order]
            x = matrix(block["v"].combine_chunks(), width)[order]
            q, names, own = matrix(queries["v"].combine_chunks(), width), queries["query"].to_numpy(), queries["id"].to_numpy()
            scores = products(q, x)
            for i in range(len(q)):
                s = scores[i]
                allowed = ids != own[i]
                if not allowed.any():
                    continue
                at = np.flatnonzero(allowed)
                if len(at) > k:
                    least = np.partition(s[at], len(at) - k)[len(at) - k]
                    over, same = at[s[at] > least], at[s[at] == least]
                    at = np.concatenate([over, same[: k - len(over)]])
                for column, values in zip(found, (np.full(len(at), names[i]), ids[at], rows[at], s[at])):
                    column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in found]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(["query", "id", "row", "score"], columns)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, factor: int = 1024,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each row that meets ``is_query`` the ``k`` rows
    with the highest inner product of ``floor(factor * x)``, ties to the smaller key.

    A row is no candidate for a query with its own key. Rows with a null key, a null vector or a null or
    non-finite component take no part. Repeated rows are candidates each. Vectors of different lengths
    are padded with zeros. Fewer than ``k`` candidates give as many rows. Scores must fit 64 bits.
    """
    rows = (
        vectors.where(F.col(key).isNotNull())
        .select(F.col(key).cast("long").alias("id"), scaled(F.col(vector), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(F.col("v").isNotNull())
    )
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 0)
    pivots = _choose_pivots(rows.select("id", "v"), width)
    data = cut_lineage(
        rows.select("id", "v", "asks", F.monotonically_increasing_id().alias("row"))
        .mapInArrow(releasing(_assign(pivots)), "id long, v array<long>, asks boolean, row long, cell int, away double")
    )
    summary = data.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("reach"), F.count_if("asks").alias("asking")).orderBy("cell").collect()
    cells = np.array([r["cell"] for r in summary], dtype=np.int64)
    reach = np.array([r["reach"] for r in summary], dtype=np.float64)

    # Blocks of a cell's rows, and groups of queries of neighbouring cells; the summary has one row per pivot.
    blocks, groups, base = {}, {}, 0
    for r in summary:
        blocks[r["cell"]] = max(1, -(-r["n"] // BLOCK_ROWS))
        share = max(1, -(-r["asking"] // QUERY_ROWS))
        groups[r["cell"]] = (base // QUERY_ROWS, share)
        base += r["asking"] if share == 1 else (share + 1) * QUERY_ROWS
    spark = vectors.sparkSession
    layout = F.broadcast(spark.createDataFrame(
        [(int(c), int(blocks[c]), int(groups[c][0]), int(groups[c][1])) for c in blocks], "cell int, blocks int, grp0 int, share int"
    ))
    salt = F.xxhash64("row")
    data = data.join(layout, "cell").withColumn("block", F.pmod(salt, F.col("blocks")).cast("int"))
    asked = data.where("asks").select(
        F.col("row").alias("query"), "id", "v", "cell",
        (F.col("grp0") + F.pmod(salt, F.col("share"))).cast("int").alias("grp"),
    )
    asked = cut_lineage(asked)
    bounds = asked.select("query", "v").mapInArrow(releasing(_bounds(pivots, cells, reach)), "query long, cell int, bound double, place int")
    bounds = cut_lineage(bounds.join(layout.select("cell", "blocks"), "cell"))
    held = data.select("cell", "block", "id", "v", "row")
    pairing = "query long, id long, row long, score long"

    def meet(visits: DataFrame) -> DataFrame:
        """``visits`` (query, cell, blocks): queries go to all blocks of their cells; a block is copied to the groups that ask."""
        each = visits.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("query", "cell", "block")
        guests = each.join(asked.select("query", "id", "v", "grp"), "query")
        wanted = guests.select("grp", "cell", "block").distinct()
        hosts = held.join(wanted, ["cell", "block"])
        hosts = hosts.toDF(*hosts.columns)  # columns of its own, apart from those of the guests
        keys = ["grp", "cell", "block"]
        return guests.groupBy(*keys).cogroup(hosts.groupBy(*keys)).applyInArrow(releasing_pair(_meet(width, k)), pairing)

    first = cut_lineage(_best(meet(bounds.where(F.col("place") < FIRST_CELLS)), k))
    reached = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    open_cells = (
        bounds.where(F.col("place") >= FIRST_CELLS).join(reached, "query", "left")
        .where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query", "cell", "blocks")
    )
    found = _best(first.drop("rank").union(meet(open_cells)), k)
    names = asked.select("query", F.col("id").alias("query_id"))
    return found.join(names, "query").select("query_id", "rank", F.col("id").alias("vec_id"), "score")

