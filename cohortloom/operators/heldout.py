"""ROC AUC of many models on the rows they did not see, without a row per score.

Each task sorts the scores of a model and fold and cuts them at splitters, equal scores on one side; what it has of a
piece is one row of packed distinct scores with their counts. A piece counts the pairs inside it, and the totals of the
pieces below do the rest, so the figure is exact wherever the splitters lie: a sample only makes pieces even. Counts
that are all one are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.operators.blocks import Block, Blocks
from cohortloom.session import materialise

#: Rows of a fold that a piece should hold, and rows scored at once in a task.
PIECE_ROWS, TOGETHER = 1 << 17, 1 << 17
#: Rows drawn for the splitters.
SAMPLE = 1 << 13


def _splitters(blocks: Blocks, models: dict[tuple[str, int], object]) -> dict[tuple[str, int], np.ndarray]:
    """Scores at which each model's pieces begin, none where a fold fits one piece."""
    pieces = {k: -(-n // PIECE_ROWS) for k, n in blocks.sizes.items()}
    if max(pieces.values()) <= 1:
        return {place: np.zeros(0) for place in models}
    share = SAMPLE / sum(blocks.sizes.values())

    def drawn(b: Block) -> dict[str, pa.Array]:
        rows = np.random.default_rng(zlib.crc32(b.x.tobytes())).random(len(b.x)) < share
        return {"x": pa.array(list(b.x[rows]), pa.list_(pa.float64()))}

    rows = blocks.map(drawn, "x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(blocks.features))
    found = {}
    for (name, k), model in models.items():
        scores = np.sort(model.probability(x))
        places = np.arange(1, pieces[k]) * len(scores) // pieces[k]
        found[name, k] = np.unique(scores[places]) if len(scores) else np.zeros(0)
    return found


def held_out_auc(blocks: Blocks, models: dict[tuple[str, int], object]) -> DataFrame:
    """(setting, fold, auc) by the models that did not see the fold; `models` by (setting, left-out fold), with `probability(x)`.

    The AUC is NULL where a class is missing.
    """
    names, cuts = sorted({n for n, _ in models}), _splitters(blocks, models)

    def packed(x: np.ndarray, label: np.ndarray, fold: int) -> Iterator[pa.RecordBatch]:
        for number, name in enumerate(names):
            if (name, fold) not in models:
                continue
            scores, split = models[name, fold].probability(x), cuts[name, fold]
            sides = [np.unique(scores[label == y], return_counts=True) for y in (0, 1)]
            ends = [np.concatenate([[0], np.searchsorted(v, split, side="left"), [len(v)]]) for v, _ in sides]
            rows = []
            for piece in range(len(split) + 1):
                cut = [(v[e[piece] : e[piece + 1]], n[e[piece] : e[piece + 1]]) for (v, n), e in zip(sides, ends)]
                if any(len(v) for v, _ in cut):
                    rows.append((number, fold, piece, *(part for v, n in cut for part in (v.tobytes(), n.astype(np.int32).tobytes() if (n > 1).any() else b""))))
            kinds = [pa.int32()] * 3 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["setting", "fold", "piece", "v0", "n0", "v1", "n1"])

    def scored(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        held: list[Block] = []

        def done() -> Iterator[pa.RecordBatch]:
            x, label, fold = (np.concatenate([getattr(b, n) for b in held]) for n in ("x", "label", "fold"))
            for k in np.unique(fold).tolist():
                yield from packed(x[fold == k], label[fold == k], k)

        for block in parts:
            held.append(block)
            if sum(len(b.label) for b in held) >= TOGETHER:
                yield from done()
                held = []
        if held:
            yield from done()

    def pairs(piece: pa.Table) -> pa.Table:
        sides = []
        for y in (0, 1):
            parts = [np.frombuffer(v, float) for v in piece.column(f"v{y}").to_pylist()]
            values = np.concatenate(parts)
            counts = np.concatenate([np.frombuffer(n, np.int32) if n else np.ones(len(v), np.int32) for v, n in zip(parts, piece.column(f"n{y}").to_pylist())])
            order = np.argsort(values, kind="stable")
            sides.append((values[order], counts[order].astype(np.int64)))
        (low, n), (high, m) = sides
        below = np.concatenate([[0], np.cumsum(n)])
        twice = (m * (below[np.searchsorted(low, high, "left")] + below[np.searchsorted(low, high, "right")])).sum()
        head = [piece.column(c).slice(0, 1).combine_chunks() for c in ("setting", "fold", "piece")]
        return pa.Table.from_arrays([*head, *(pa.array([int(v)], pa.int64()) for v in (m.sum(), n.sum(), twice))], names=["setting", "fold", "piece", "pos", "neg", "twice"])

    rows = blocks.stream(scored, "setting int, fold int, piece int, v0 binary, n0 binary, v1 binary, n1 binary")
    cells = rows.groupBy("setting", "fold", "piece").applyInArrow(pairs, "setting int, fold int, piece int, pos long, neg long, twice long")
    # Written: a few rows per model and fold, in place of an evaluation by each that reads them.
    cells = materialise(cells, "pieces")
    before = Window.partitionBy("setting", "fold").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("twice") / 2.0 + F.col("pos").cast("double") * F.coalesce(F.sum("neg").over(before), F.lit(0))
    summed = cells.select("setting", "fold", "pos", "neg", wins.alias("wins")).groupBy("setting", "fold").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "wins")])
    all_pairs = F.col("pos").cast("double") * F.col("neg")
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("setting") + 1)
    return summed.select(named.alias("setting"), "fold", F.when(all_pairs > 0, F.col("wins") / all_pairs).alias("auc"))
