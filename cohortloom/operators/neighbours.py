"""k-nearest-neighbour voting: tiles of train rows meet blocks of queries, each meeting keeps k places per query."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

#: Rows of a tile and of a block of queries, on average: what one task holds at a time.
TILE_ROWS = 8192
BLOCK_ROWS = 1024
_PART = 256
_SPARE = 8


def nearest(points: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest points of each query in `block`, by distance to 12 digits and then by id.

    One matrix product ranks all points; the best k and a few more are measured again exactly. A query
    whose reserve may hide a tie or a rounding error is measured against all points.
    """
    k = min(k, len(points))
    rough = (points * points).sum(axis=1)[None, :] - 2.0 * block @ points.T + (block * block).sum(axis=1)[:, None]
    m = min(k + _SPARE, len(points))
    some = np.argpartition(rough, m - 1, axis=1)[:, :m]
    reach = np.take_along_axis(rough, some, axis=1).max(axis=1)
    exact = np.sqrt(((points[some] - block[:, None, :]) ** 2).sum(axis=2)).round(12)
    order = np.lexsort((ids[some], exact), axis=1)[:, :k]
    best = np.take_along_axis(some, order, axis=1)
    last = np.take_along_axis(exact, order[:, -1:], axis=1)[:, 0]
    scale = 1e-9 * (1.0 + (block * block).sum(axis=1) + (points * points).sum(axis=1).max())
    for q in np.nonzero((last * last + scale >= reach) & (m < len(points)))[0]:
        dist = np.sqrt(((points - block[q]) ** 2).sum(axis=1)).round(12)
        best[q] = np.lexsort((ids, dist))[:k]
    return best


def _dealt(df: DataFrame, columns: Sequence[str], rows: int, tile: str, packed: str) -> tuple[DataFrame, int]:
    """Written groups of about `rows` rows, by a hash of the whole row: (tile, array of the columns), and their number."""
    df = materialise(df.select(*columns), "vectors")
    tiles = -(-df.count() // rows)
    place = F.pmod(F.xxhash64(*columns), F.lit(max(1, tiles))).cast("int").alias(tile)
    return materialise(df.groupBy(place).agg(F.collect_list(F.struct(*columns)).alias(packed)), "tiles"), tiles


def nearest_rows(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(query_id, train_id, label, place) of the k nearest train rows of each query, by distance to 12 digits, then id.

    `queries` has query_id and vec, `train` train_id, vec and label; vec is array<double> of one length. Every block of
    queries meets every tile, as an equi-join on the tile's number; what leaves a meeting is at most k rows per query,
    and a window with a group limit merges them. No vector reaches the driver.
    """
    tiles, count = _dealt(train, ["train_id", "vec", "label"], TILE_ROWS, "tile", "points")
    blocks, _ = _dealt(queries, ["query_id", "vec"], BLOCK_ROWS, "block", "asked")
    query, point = (d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (train, "train_id")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def columns(cell, names):
            fields = [cell.values.field(n) for n in names]
            vec = fields.pop(1)
            return np.array(vec.flatten().to_numpy(zero_copy_only=False)).reshape(len(vec), -1), fields

        for batch in batches:
            for asked, points in zip(batch.column(0), batch.column(1)):
                block, (query_ids,) = columns(asked, ["query_id", "vec"])
                train_rows, (train_ids, labels) = columns(points, ["train_id", "vec", "label"])
                ids = train_ids.to_numpy(zero_copy_only=False)
                for at in range(0, len(block), _PART):
                    part = block[at : at + _PART]
                    best = nearest(train_rows, ids, part, k)
                    far = np.sqrt(((train_rows[best] - part[:, None, :]) ** 2).sum(axis=2)).round(12)
                    took = pa.array(best.ravel())
                    yield pa.RecordBatch.from_arrays(
                        [
                            query_ids.take(pa.array(np.repeat(np.arange(at, at + len(part)), best.shape[1]))), train_ids.take(took),
                            labels.take(took).cast(pa.float64()), pa.array(far.ravel()),
                        ],
                        names=["query_id", "train_id", "label", "far"],
                    )

    pairs = blocks.select("asked", F.explode(F.sequence(F.lit(0), F.lit(max(1, count) - 1))).alias("tile"))
    # A merge join: the optimiser must not broadcast the tiles, whose vectors would pass through the driver.
    met = pairs.join(tiles.hint("merge"), "tile").select("asked", "points")
    found = met.mapInArrow(meet, f"query_id {query}, train_id {point}, label double, far double")
    order = Window.partitionBy("query_id").orderBy("far", "train_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("far")


def knn_votes(queries: DataFrame, train: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(query_id, prob_<k> for each of `ks`): mean label of the k nearest train rows, all from one search."""
    found = nearest_rows(queries, train, max(ks))
    return found.groupBy("query_id").agg(*[F.avg(F.when(F.col("place") <= k, F.col("label"))).alias(f"prob_{k}") for k in ks])


def knn_vote(queries: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """(query_id, prob) with the mean label of the k nearest train rows, ties by train id; no rows without train rows."""
    return knn_votes(queries, train, [k]).withColumnRenamed(f"prob_{k}", "prob")
