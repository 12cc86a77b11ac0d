"""Logistic regression with L2 or elastic-net penalty over a path of settings, all folds in the same passes.

The objective is `(1 - ratio) / 2 |w|^2 + ratio |w|_1 + C * sum of weighted log losses`, the intercept free. A pass
returns loss, gradient and weighted Gram matrix of every unfinished problem (a fold left out, or none; a ratio); the
driver minimises the quadratic model with the penalty by coordinate descent, halves the step until the objective
falls enough, and stops when the optimality conditions hold. A path goes from the strongest penalty to the weakest and
starts each C where the one before ended, with what its last pass found there (that holds for every C and needs no pass).
Paths of several ratios, column choices and weightings advance in the same passes, each at its own pace; the fit of all
rows comes first, and the folds start at its solution. Problems on the same rows share the scaled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Sequence
from dataclasses import dataclass, field

import numpy as np

from cohortloom.operators.blocks import WHOLE, Block, Blocks, Prepared

#: Passes per C; a fit that needs more is an error.
MAX_PASSES = 200
#: Largest violation of the optimality conditions, against the gradient at the start.
TOLERANCE = 1e-9


@dataclass
class Linear:
    """One problem: without fold `without`, columns `keep`, weights per label."""

    without: int
    prepared: Prepared
    keep: np.ndarray
    C: float
    ratio: float
    classes: np.ndarray
    w: np.ndarray = field(default=None)  # coefficients, then the intercept
    done: bool = False
    weighting: int = 0

    def __post_init__(self):
        if self.w is None:
            self.w = np.zeros(len(self.keep) + 1)
        self.at, self.value, self.gradient, self.gram, self.got = self.w, np.inf, None, None, None
        self.step, self.toward, self.fall, self.scale = 1.0, None, 0.0, None

    def design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.prepared.scaled(x)[:, self.keep], np.ones((len(x), 1))])

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.design(x) @ self.w

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margins(x), -700, 700)))

    def follow(self, c: float) -> "Linear":
        """This solved problem at another C, from its solution and from what its last pass found there."""
        after = Linear(self.without, self.prepared, self.keep, c, self.ratio, self.classes, self.w, weighting=self.weighting)
        after.take(self.got)
        return after

    def started(self, solved: "Linear") -> None:
        """Start at the solution of a problem on other rows; columns it does not have start at zero."""
        known = dict(zip(solved.keep.tolist(), solved.w))
        self.w = self.at = np.array([*(known.get(k, 0.0) for k in self.keep.tolist()), solved.w[-1]])

    def penalty(self, w: np.ndarray) -> float:
        return (1 - self.ratio) / 2 * float(w[:-1] @ w[:-1]) + self.ratio * float(np.abs(w[:-1]).sum())

    def violation(self) -> float:
        """Largest distance of zero from the subdifferential, coordinate by coordinate."""
        g = self.C * self.gradient
        smooth = g[:-1] + (1 - self.ratio) * self.w[:-1]
        off = np.where(self.w[:-1] != 0, np.abs(smooth + self.ratio * np.sign(self.w[:-1])), np.maximum(np.abs(smooth) - self.ratio, 0.0))
        return float(max([abs(g[-1]), *off]))

    def take(self, got: np.ndarray) -> None:
        """Accept or shorten the step with what the pass found at `at`, and choose the next point."""
        m = len(self.w)
        value = self.C * got[0] + self.penalty(self.at)
        if self.toward is not None and value > self.value + 1e-4 * self.step * self.fall + 1e-13 * abs(self.value):
            self.step /= 2
            if self.step < 1e-12:
                raise ArithmeticError("the objective does not fall along the step")
            self.at = self.w + self.step * self.toward
            return
        self.w, self.value, self.gradient, self.gram, self.got = self.at, value, got[1 : 1 + m], got[1 + m :].reshape(m, m), got
        self.scale = self.scale or max(1.0, self.C * float(np.abs(self.gradient).max()))
        if self.violation() <= TOLERANCE * self.scale:
            self.done = True
            return
        best = descend(self.C * self.gram, self.C * self.gradient, self.w, self.ratio)
        self.toward = best - self.w
        self.fall = self.C * float(self.gradient @ self.toward) + self.penalty(best) - self.penalty(self.w)
        self.step, self.at = 1.0, best


def descend(gram: np.ndarray, gradient: np.ndarray, w: np.ndarray, ratio: float, sweeps: int = 2000) -> np.ndarray:
    """Minimum over v of gradient (v - w) + (v - w)' gram (v - w) / 2 + penalty(v), the last coordinate free."""
    m = len(w)
    ridge = np.append(np.full(m - 1, 1 - ratio), 0.0)
    curve = gram + np.diag(np.full(m, 1e-12 * max(1e-300, np.trace(gram) / m)))
    if ratio == 0:
        return w - np.linalg.solve(curve + np.diag(ridge), gradient + ridge * w)
    v, slope = w.copy(), gradient.copy()  # slope of the quadratic at v
    for _ in range(sweeps):
        most = 0.0
        for j in range(m):
            bend, free = curve[j, j], j == m - 1
            if free:
                new = v[j] - slope[j] / bend
            else:
                pull = bend * v[j] - slope[j]
                new = np.sign(pull) * max(abs(pull) - ratio, 0.0) / (bend + 1 - ratio)
            if new != v[j]:
                slope += curve[:, j] * (new - v[j])
                most, v[j] = max(most, abs(new - v[j]) * np.sqrt(bend)), new
        if most <= 1e-13 * (1.0 + float(np.abs(v).max())):
            break
    return v


def _pass(live: Sequence[Linear]) -> Callable[[Block], np.ndarray]:
    """Loss, gradient and Gram matrix of every live problem at its point, for the rows of a block."""
    plan: dict[int, tuple[Prepared, dict[tuple, list]]] = {}
    count = len(live)
    for number, p in enumerate(live):
        _, same = plan.setdefault(p.without, (p.prepared, {}))
        same.setdefault(tuple(p.keep.tolist()), []).append((number, p.at, p.weighting, p.classes))

    def step(b: Block) -> np.ndarray:
        out = [None] * count
        for without, (prepared, same) in plan.items():
            rows = np.flatnonzero(b.fold != without) if without != WHOLE else np.arange(len(b.label))
            columns = prepared.scaled(b.x[rows]).T
            columns = np.vstack([columns, np.ones((1, len(rows)))])
            y, weights = b.label[rows], b.weights[:, rows]
            for keep, problems in same.items():
                x = columns[[*keep, -1]]
                f = np.stack([at for _, at, _, _ in problems]) @ x
                weight = np.stack([weights[w] * classes[y.astype(int)] for _, _, w, classes in problems])
                e = np.exp(-np.abs(f))
                p = np.where(f >= 0, 1.0, e) / (1.0 + e)
                loss = (weight * (np.maximum(f, 0.0) + np.log1p(e) - y * f)).sum(axis=1)
                slope = (weight * (p - y)) @ x.T
                curve = weight * p * (1.0 - p)
                for i, (number, *_) in enumerate(problems):
                    out[number] = np.concatenate([[loss[i]], slope[i], ((curve[i] * x) @ x.T).ravel()])
        return np.concatenate(out)

    return step


@dataclass(frozen=True)
class Path:
    """Fits of one penalty ratio and weighting over several C, with the columns kept per left-out fold."""

    strengths: tuple[float, ...]
    ratio: float
    keep: dict[int, np.ndarray]
    weighting: int = 0


def paths(blocks: Blocks, lines: dict[Hashable, Path], outs: Sequence[int], balanced: bool = True) -> dict[tuple[Hashable, int, float], Linear]:
    """Fitted problems by (name of the path, left-out fold, C), all paths in shared passes."""
    prepared = blocks.prepared()
    found: dict[tuple[Hashable, int, float], Linear] = {}
    # The fit of all rows first: its solutions are close to those without a fold.
    for batch in ([k for k in outs if k == WHOLE], [k for k in outs if k != WHOLE]):
        live = {}
        for name, line in lines.items():
            for k in batch:
                classes, first = prepared[k].balance() if balanced else np.ones(2), min(line.strengths)
                problem = Linear(k, prepared[k], line.keep[k], first, line.ratio, classes, weighting=line.weighting)
                if (name, WHOLE, first) in found:
                    problem.started(found[name, WHOLE, first])
                live[name, k] = problem
        passes = dict.fromkeys(live, 0)
        while live:
            step = _pass(list(live.values()))
            sizes = np.cumsum([0] + [1 + len(p.w) + len(p.w) ** 2 for p in live.values()])
            got = blocks.reduce(step)
            for (place, p), a, z in zip(list(live.items()), sizes, sizes[1:]):
                p.take(got[a:z])
                passes[place] += 1
                name, k = place
                left = sorted(c for c in lines[name].strengths if c > p.C)
                while p.done:
                    found[name, k, p.C], passes[place] = p, 0
                    if not left:
                        break
                    p = p.follow(left.pop(0))
                live[place] = p
                if passes[place] >= MAX_PASSES:
                    raise ArithmeticError(f"no convergence in {MAX_PASSES} passes")
            live = {place: p for place, p in live.items() if not p.done}
    return found


def path(
    blocks: Blocks, strengths: Sequence[float], ratios: Sequence[float] = (0.0,), keeps: dict[int, dict[int, np.ndarray]] | None = None,
    balanced: bool = True, refit: bool = True,
) -> dict[tuple[int, float, float, int], Linear]:
    """Fitted problems by (left-out fold, C, ratio, name of the column choice).

    `keeps` names column choices per left-out fold, such as percentiles; None keeps all columns.
    """
    outs = [*blocks.folds, *([WHOLE] if refit or not blocks.folds else [])]
    everything = np.arange(len(blocks.features))
    keeps = keeps or {0: {k: everything for k in outs}}
    lines = {(ratio, name): Path(tuple(strengths), ratio, choice) for name, choice in keeps.items() for ratio in ratios}
    return {(k, c, ratio, name): p for ((ratio, name), k, c), p in paths(blocks, lines, outs, balanced).items()}
