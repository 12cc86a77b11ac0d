"""Whitening by a Jacobi-Davidson eigensolver whose only access to the covariance is a product with a block of vectors.

The fit list is each distinct vector once, packed into blocks of BLOCK_ROWS rows and written to the shared folder. A
product V w is one Spark job over the blocks: each task centres its rows, multiplies twice and returns one small
matrix, so the covariance is never formed and nothing of the size of the data reaches the driver. The solver keeps a
search space of at most MAX_SPACE vectors: Rayleigh-Ritz on it, a correction equation for each of the leading pairs
that are not done (projected against that pair and the locked ones, solved by a few MINRES steps, all pairs in the
same product), the corrections appended, finished pairs locked, the space cut to its leading pairs when it is full.
It ends when every wanted residual is at rounding level and otherwise raises.

Whole numbers x = floor(256 * c) are exact, and so are their sums and `deviation` (an overflow of long raises).

Defined cases: NULL vectors, vectors with NULL or non-finite entries and empty ones are dropped; so are those of
another width than most of the fit list (ties: the smaller width). Repeated rows count once in the fit and each get
their rows; a NULL key is kept. Directions without variance are no components, so fewer than `components` rows come
back per vector where the rank is lower, and none for an empty table or a single distinct vector. Other columns are
ignored. Equal eigenvalues have no order of their own: any basis of their space is right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.vectors import matrix, whole_rows
from cohortloom.session import materialise

BLOCK_ROWS = 4096
#: Most tasks of a product: each returns one small matrix to the driver.
MAX_PARTS = 2048
#: Vectors of the search space at most, and how many leading pairs stay when it is cut.
MAX_SPACE, KEPT_SPACE = 32, 12
START_SPACE = 16
MINRES_STEPS = 4
MAX_ROUNDS = 200
_EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


class Fit:
    """Blocks of the distinct vectors with their count, sums and centred products."""

    def __init__(self, rows: DataFrame, width: int):
        self.width = width

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def block(x):
                sums = [int(v) for v in x.sum(axis=0)]
                return pa.RecordBatch.from_arrays(
                    [pa.array([len(x)], pa.int64()), pa.array([sums], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                    names=["n", "sums", "data"],
                )

            held = np.empty((0, width), np.int64)
            for batch in batches:
                held = np.concatenate([held, matrix(batch.column(0), width)])
                while len(held) >= BLOCK_ROWS:
                    yield block(held[:BLOCK_ROWS])
                    held = held[BLOCK_ROWS:]
            if len(held):
                yield block(held)

        packed = rows.select("x").distinct().mapInArrow(pack, "n bigint, sums array<bigint>, data binary")
        written = materialise(packed, "fit-list")
        self.blocks = written.select("data").coalesce(MAX_PARTS)
        totals = written.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        found = {r["at"]: (r["s"], r["n"]) for r in totals.collect()}
        self.n = found[0][1] if found else 0
        self.sums = [found[k][0] for k in range(width)] if found else [0] * width
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(width)

    def reduce(self, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of `step(centred rows)` over all blocks."""
        width, mean = self.width, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for data in batch.column(0):
                    x = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width)
                    part = step(x - mean)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["part"])

        rows = self.blocks.mapInArrow(run, "part binary").collect()
        return sum(np.frombuffer(r["part"], float) for r in rows)

    def product(self, w: np.ndarray) -> np.ndarray:
        """Covariance (divisor n) times the columns of w."""
        return self.reduce(lambda c: c.T @ (c @ w)).reshape(w.shape) / self.n

    def trace(self) -> float:
        return float(self.reduce(lambda c: np.atleast_1d(np.einsum("ij,ij->", c, c)))[0]) / self.n

    def moments(self, axes: np.ndarray) -> np.ndarray:
        """Covariance over the fit list of the projections on the columns of `axes`, centred before multiplying."""
        m = axes.shape[1]
        shift = self.reduce(lambda c: (c @ axes).sum(axis=0)) / self.n

        def step(c):
            p = c @ axes - shift
            return p.T @ p

        return self.reduce(step).reshape(m, m) / self.n


def minres(operate: Product, rhs: np.ndarray, steps: int, goal: float = 1e-3) -> np.ndarray:
    """Columns x with operate(x) near rhs, each by its own MINRES recurrence, all sharing the products."""
    x = np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, v_old = rhs / start, np.zeros_like(rhs)
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    c, s = -np.ones_like(beta), np.zeros_like(beta)
    left, d_bar, eps = beta.copy(), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        p = operate(v) - beta * v_old
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v
        beta = np.linalg.norm(p, axis=0)
        eps_old, delta, g = eps, c * d_bar + s * alpha, s * d_bar - c * alpha
        eps, d_bar = s * beta, -c * beta
        size = np.hypot(g, beta)
        live = size > _EPS * start
        gamma = np.where(live, size, 1.0)
        c, s = np.where(live, g / gamma, 1.0), np.where(live, beta / gamma, 0.0)
        w, w_old = np.where(live, (v - eps_old * w_old - delta * w) / gamma, 0.0), w
        x = x + np.where(live, c * left, 0.0) * w
        left = np.where(live, s * left, 0.0)
        v_old, v = v, p / np.where(beta > _EPS * start, beta, np.inf)
        if (left <= goal * start).all():
            break
    return x


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The part of `new` outside the bases as orthonormal columns; dependent columns go."""
    kept = []
    for column in new.T:
        size = np.linalg.norm(column)
        if not size > 0:
            continue
        column = column / size
        for _ in range(2):
            for base in (*bases, np.array(kept).T.reshape(len(column), len(kept))):
                column = column - base @ (base.T @ column)
            rest = np.linalg.norm(column)
            if rest < 1e-8:
                break
            column = column / rest
        else:
            kept.append(column)
    return np.array(kept).T.reshape(new.shape[0], len(kept))


def jacobi_davidson(product: Product, width: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The `wanted` largest eigenvalues and their eigenvectors of a symmetric non-negative operator on `width` dimensions."""
    wanted = min(wanted, width)
    start = min(width, max(START_SPACE, wanted))
    room = min(width, MAX_SPACE)
    space = _orthonormal(np.random.default_rng(seed).standard_normal((width, start)))
    image = product(space)
    locked = np.zeros((width, 0))
    values: list[float] = []
    scale = 0.0
    for _ in range(MAX_ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max([scale, *np.abs(theta), *values])
        rest = image - space * theta
        rest = rest - locked @ (locked.T @ rest)
        sizes = np.linalg.norm(rest, axis=0)
        tolerance = 16 * _EPS * np.sqrt(width) * scale
        done = 0
        # Only leading pairs are locked, so no larger pair can be missed behind them.
        while done < len(theta) and len(values) + done < wanted and sizes[done] <= tolerance:
            done += 1
        if done:
            locked = np.hstack([locked, space[:, :done]])
            values += [float(t) for t in theta[:done]]
            space, image, theta, rest, sizes = space[:, done:], image[:, done:], theta[done:], rest[:, done:], sizes[done:]
        if len(values) >= wanted:
            order = np.argsort(-np.array(values), kind="stable")
            return np.array(values)[order], locked[:, order]
        if space.shape[1] + locked.shape[1] < width:
            todo = [k for k in range(min(wanted - len(values), space.shape[1])) if sizes[k] > tolerance]
            pairs, shifts, right = space[:, todo], theta[todo], -rest[:, todo]

            def project(t: np.ndarray) -> np.ndarray:
                t = t - locked @ (locked.T @ t)
                return t - pairs * (pairs * t).sum(axis=0)

            def operate(t: np.ndarray) -> np.ndarray:
                t = project(t)
                return project(product(t) - t * shifts)

            fresh = project(minres(operate, project(right), MINRES_STEPS)) if todo else np.zeros((width, 0))
        else:
            fresh = np.zeros((width, 0))
        if space.shape[1] + len(fresh.T) + locked.shape[1] > room and space.shape[1] > KEPT_SPACE:
            space, image = space[:, :KEPT_SPACE], image[:, :KEPT_SPACE]
        fresh = _orthonormal(fresh, locked, space)
        if not fresh.shape[1]:
            # The space is exhausted or invariant: its own basis is made exact, and a random direction follows where there is one.
            space = _orthonormal(space, locked)
            extra = np.random.default_rng(seed + len(values)).standard_normal((width, 1))
            fresh = _orthonormal(extra, locked, space)
            image = product(space)
            if not fresh.shape[1]:
                continue
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    raise ArithmeticError(f"{wanted - len(values)} of {wanted} eigenpairs did not reach double precision in {MAX_ROUNDS} rounds")


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector and component."""
    rows = whole_rows(df, key, vector)
    schema = f"`{key}` bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    sizes = rows.select("x").distinct().groupBy(F.size("x").alias("width")).count()
    width = sizes.orderBy(F.desc("count"), "width").limit(1).collect()
    fit = Fit(rows.where(F.size("x") == width[0]["width"]), width[0]["width"]) if width else None
    values, axes = jacobi_davidson(fit.product, fit.width, components) if fit and fit.n > 1 else (np.zeros(0), None)
    live = values > fit.width * _EPS * values[0] if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    if not live.any():
        return df.sparkSession.createDataFrame([], schema)
    values, axes = values[live], axes[:, live] / np.sqrt(values[live])
    explained = values / fit.trace()
    error = float(np.abs(fit.moments(axes) - np.eye(len(values))).max())
    d, n, mean, sums = fit.width, fit.n, fit.mean, fit.sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(values)
        total = np.array(sums, np.int64)
        for batch in batches:
            x = matrix(batch.column(1), d)
            if n * float(np.abs(x).max(initial=0)) + float(np.abs(total).max()) > 2.0**62:
                raise OverflowError("n * x does not fit into long")
            apart = n * x - total
            if (np.square(apart.astype(float)).sum(axis=1) > 2.0**62).any():
                raise OverflowError("deviation does not fit into long")
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), m)))
            columns = [
                keys, pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * m, n)),
                pa.array(np.repeat((apart * apart).sum(axis=1), m)), pa.array(((x - mean) @ axes).ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == d).mapInArrow(run, schema)
