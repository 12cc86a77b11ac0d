"""A labelled feature table as written blocks of rows, for fits that pass over the data many times.

A block holds ids, label, fold, weight and the features of at most BLOCK_ROWS rows. A pass is one Spark job: each task
adds up what a step returns for its blocks, partial sums are added in tasks again while there are many, and one array
of fixed size reaches the driver. All folds share the blocks: what holds "without fold k" is the total less fold k, so
medians, moments and F values of every fold's train part come from one set of counts and one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ranking import quantiles_of_counts, running_totals
from cohortloom.operators.scoring import long_form
from cohortloom.session import materialise

BLOCK_ROWS = 4096
#: Partial sums that the driver adds at most; more are added in tasks first.
MAX_PARTS = 64
#: The fold of rows that no fold leaves out, and the number of "without no fold".
WHOLE = -1


@dataclass
class Block:
    ids: pa.Array
    label: np.ndarray
    fold: np.ndarray
    weights: np.ndarray  # a row per weighting
    x: np.ndarray

    @property
    def weight(self) -> np.ndarray:
        return self.weights[0]


class Blocks:
    """Blocks of `df` (id, label 0/1, features, and fold and weight where given); rows without a label are left out.

    `weight` may name several columns, so fits with different weightings share the blocks and their passes.
    """

    def __init__(
        self, df: DataFrame, features: Sequence[str], label: str = "label", fold: str | None = None, weight: str | Sequence[str] | None = None, key: str = "entity_id"
    ):
        self.features, self.key, self.kind = list(features), key, df.schema[key].dataType.simpleString()
        weights = [F.lit(1.0)] if weight is None else [F.col(c) for c in ([weight] if isinstance(weight, str) else weight)]
        self.head = 2 + len(weights)
        width = len(self.features) + self.head
        numbers = [F.col(label), F.col(fold) if fold else F.lit(WHOLE), *weights, *[F.col(c) for c in self.features]]
        rows = df.where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in numbers]).alias("v"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    data = np.ascontiguousarray(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).T)
                    ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([data.tobytes()], pa.binary())], names=["ids", "data"])

        self.table = materialise(rows.mapInArrow(pack, f"ids array<{self.kind}>, data binary"), "blocks")
        sizes = df.where(F.col(label).isNotNull()).groupBy(fold).count().collect() if fold else []
        #: Rows of each fold.
        self.sizes = {int(r[0]): r[1] for r in sorted(sizes)}
        self.folds = list(self.sizes)
        self._medians: dict[int, np.ndarray] | None = None
        self._prepared: dict[int, Prepared] | None = None

    def _each(self) -> Callable[[pa.RecordBatch], Iterator[Block]]:
        width, head = len(self.features) + self.head, self.head

        def each(batch: pa.RecordBatch) -> Iterator[Block]:
            for k in range(batch.num_rows):
                data = np.frombuffer(batch.column(1)[k].as_buffer(), float).reshape(width, -1)
                yield Block(batch.column(0)[k].values, data[0], data[1].astype(int), data[2:head], data[head:].T)

        return each

    def reduce(self, step: Callable[[Block], np.ndarray]) -> np.ndarray:
        """Sum of `step` over all blocks; every step returns an array of one shape."""
        each = self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _partial(step(b).astype(float) for batch in batches for b in each(batch))

        return total(self.table.mapInArrow(run, "part binary, shape array<int>"))

    def map(self, step: Callable[[Block], dict[str, pa.Array]], schema: str) -> DataFrame:
        """Rows that `step` makes of each block."""
        return self.stream(lambda blocks: (pa.RecordBatch.from_pydict(step(b)) for b in blocks), schema)

    def stream(self, step: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Rows that `step` makes of the blocks of a task, which come one after the other."""
        each = self._each()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from step(block for batch in batches for block in each(batch))

        return self.table.mapInArrow(run, schema)

    # ---- statistics of every fold's train part -----------------------------------------------------

    def counts(self) -> DataFrame:
        """(feature_name, without, value, n): rows per distinct value outside each fold, and of all (`without` is WHOLE)."""
        features, wide = self.features, ", ".join(f"f{k} double" for k in range(len(self.features)))
        names = [f"f{k}" for k in range(len(features))]
        rows = self.map(
            lambda b: {"fold": pa.array(b.fold.astype(np.int32))} | {n: pa.array(b.x[:, k], from_pandas=True) for k, n in enumerate(names)}, f"fold int, {wide}"
        )
        seen = long_form(rows, names, ["fold"]).groupBy("feature_name", "value", "fold").agg(F.count("*").alias("n"))
        outs = F.explode(F.filter(F.lit([WHOLE, *self.folds]), lambda k: (k == WHOLE) | (k != F.col("fold"))))
        return seen.select("feature_name", "value", "n", outs.alias("without")).groupBy("feature_name", "without", "value").agg(F.sum("n").alias("n"))

    def medians(self) -> dict[int, np.ndarray]:
        """Exact train medians per left-out fold (and WHOLE); 0 where a feature has no value."""
        if self._medians is None:
            rows = quantiles_of_counts(self.counts(), ["feature_name", "without"], "value", {"m": 0.5}).collect()
            self._medians = {k: np.zeros(len(self.features)) for k in (WHOLE, *self.folds)}
            for r in rows:
                self._medians[r["without"]][int(r["feature_name"][1:])] = r["m"]
        return self._medians

    def prepared(self) -> dict[int, "Prepared"]:
        """Medians, means, deviations and F values without each fold (and of all rows), from one pass."""
        if self._prepared is None:
            self._prepared = self._prepare()
        return self._prepared

    def _prepare(self) -> dict[int, "Prepared"]:
        medians, outs, p = self.medians(), [WHOLE, *self.folds], len(self.features)
        places, shift = {k: i for i, k in enumerate(outs)}, self.medians()[WHOLE]

        def step(b: Block) -> np.ndarray:
            # Per fold and label: rows, rows with a value, sums and squares of what is there, about a common shift.
            out = np.zeros((len(outs), 2, 4, p))
            for k in np.unique(b.fold):
                for y in (0, 1):
                    x = b.x[(b.fold == k) & (b.label == y)] - shift
                    here = ~np.isnan(x)
                    x = np.where(here, x, 0.0)
                    out[places[k], y] = [np.full(p, len(x)), here.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)]
            return out

        cells = self.reduce(step)
        found = {}
        for k in outs:
            part = cells.sum(axis=0) - (cells[places[k]] if k != WHOLE else 0)
            n, fill = part[:, 0], medians[k] - shift
            sums = part[:, 2] + (n - part[:, 1]) * fill
            squares = part[:, 3] + (n - part[:, 1]) * fill * fill
            rows = n.sum(axis=0)
            mean = sums.sum(axis=0) / rows
            spread = np.maximum(squares.sum(axis=0) / rows - mean**2, 0.0)
            with np.errstate(all="ignore"):
                between = (n * (sums / n - mean) ** 2).sum(axis=0)
                f = between / ((squares - sums * sums / n).sum(axis=0) / (rows - 2))
            std = np.sqrt(np.where(spread > 1e-24 * (1 + mean**2), spread, 0.0))
            found[k] = Prepared(medians[k], mean + shift, np.where(std > 0, std, 1.0), np.where(np.isfinite(f), f, np.nan), n[:, 0])
        return found


@dataclass
class Prepared:
    """What a fit learns of the columns: fills, means, deviations, F values; rows per label."""

    fill: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    f: np.ndarray
    rows: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (np.where(np.isnan(x), self.fill, x) - self.mean) / self.std

    def balance(self) -> np.ndarray:
        """Weight of each label that makes both count the same."""
        return self.rows.sum() / (2.0 * np.maximum(self.rows, 1.0))


def _partial(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    added = None
    for part in parts:
        added = part if added is None else added + part
    if added is not None:
        shape = pa.array([list(added.shape)], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([added.tobytes()], pa.binary()), shape], names=["part", "shape"])


def total(parts: DataFrame) -> np.ndarray:
    """Sum of partial arrays (part, shape), added in tasks while they are many."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _partial(np.frombuffer(p.as_buffer(), float).reshape(s.as_py()) for b in batches for p, s in zip(b.column(0), b.column(1)))

    if parts.rdd.getNumPartitions() > MAX_PARTS:
        parts = parts.repartition(MAX_PARTS).mapInArrow(add, "part binary, shape array<int>")
    rows = parts.collect()
    if not rows:
        raise ValueError("no labelled rows to fit on")
    return sum(np.frombuffer(r["part"], float).reshape(r["shape"]) for r in rows)


def cut_points(blocks: Blocks, bins: int) -> list[np.ndarray]:
    """Values between at most `bins` bins of each feature with near even rows, halfway between neighbouring bins."""
    whole = blocks.counts().where(F.col("without") == WHOLE).drop("without")
    ranked = running_totals(whole, ["feature_name"], "value", ["n"])
    distinct = whole.groupBy("feature_name").agg(F.count("*").alias("distinct"))
    placed = ranked.join(F.broadcast(distinct), "feature_name")  # one row per feature
    even = F.floor(F.col("n_below") * bins / F.col("n_total")).cast("double")
    placed = placed.withColumn("bin", F.when(F.col("distinct") <= bins, F.col("value")).otherwise(even))
    ends = placed.groupBy("feature_name", "bin").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    by_name: dict[int, list] = {}
    for r in ends:
        by_name.setdefault(int(r["feature_name"][1:]), []).append((r["low"], r["high"]))
    out = []
    for k in range(len(blocks.features)):
        spans = sorted(by_name.get(k, []))
        out.append(np.array([a[1] + (b[0] - a[1]) / 2 for a, b in zip(spans, spans[1:])]))
    return out
