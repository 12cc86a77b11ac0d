"""Gradient boosting on histograms: columns binned once, trees grown best leaf first, all problems in shared passes.

A pass over the binned rows returns, for every problem in work (a fold left out or none, a setting), gradient, hessian
and row sums per bin of the leaves that it asks for; sums are added in the tasks. Of two sibling leaves only the
smaller is asked for, the other is the parent's histogram less it. A tree grows by its best leaf; a pass asks ahead
for the children of as many of the best leaves as could still be split, so a tree takes about as many passes as it is
deep, and splits that were asked for in vain are not used. Each problem goes on to its next tree by itself.

Raw scores travel with the rows. They are written again after RECENT trees of some problem; trees since then are
applied in the pass. A missing value has a bin of its own and goes to the side with the larger gain.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.operators.blocks import WHOLE, Blocks, _partial, cut_points, total
from cohortloom.session import materialise

BINS = 255
MISSING = 255
RECENT = 10
#: Bytes of histograms that a pass may return; problems beyond wait for the next group.
PASS_BYTES = 64 << 20
_CELL = 256 * 3 * 8


@dataclass(frozen=True)
class Setting:
    rate: float = 0.1
    depth: int | None = None
    leaves: int = 31
    stages: int = 100
    min_rows: int = 20
    l2: float = 0.0
    min_hessian: float = 1e-3

    def text(self) -> str:
        return f"learning_rate={self.rate:g},max_depth={self.depth},max_leaf_nodes={self.leaves}"


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, start in (("feature", -1), ("bin", 0), ("missing_left", False), ("left", -1), ("right", -1), ("value", value)):
            getattr(self, name).append(start)
        return len(self.value) - 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        feature, cut, miss, left, right = (np.array(getattr(self, n)) for n in ("feature", "bin", "missing_left", "left", "right"))
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            seen = bins[rows, feature[at]]
            goes_left = np.where(seen == MISSING, miss[at], seen <= cut[at])
            node[rows] = np.where(goes_left, left[at], right[at])
        return node

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(bins)]


def best_split(hist: np.ndarray, s: Setting) -> tuple | None:
    """(gain, feature, bin, missing goes left, sums left, sums right) of the best split of a leaf, if there is one.

    `hist` is (feature, bin, [gradient, hessian, rows]); ties go to the first feature and bin, missing to the right.
    """
    whole = hist[0].sum(axis=0)
    gap, seen = hist[:, MISSING], np.cumsum(hist[:, :MISSING], axis=1)
    left = np.stack([seen, seen + gap[:, None]], axis=2)  # feature, bin, missing side, sums
    right = whole - left
    ok = (left[..., 2] >= s.min_rows) & (right[..., 2] >= s.min_rows) & (left[..., 1] >= s.min_hessian) & (right[..., 1] >= s.min_hessian)
    score = lambda t: t[..., 0] ** 2 / np.maximum(t[..., 1] + s.l2, 1e-300)
    gain = np.where(ok, score(left) + score(right) - score(whole), -np.inf)
    f, b, m = np.unravel_index(int(gain.argmax()), gain.shape)
    if not gain[f, b, m] > 1e-12:
        return None
    return float(gain[f, b, m]), int(f), int(b), bool(m), left[f, b, m], right[f, b, m]


class Boosted:
    """One problem: its finished trees and the one that grows."""

    def __init__(self, without: int, setting: Setting, base: float, cuts: list[np.ndarray]):
        self.without, self.setting, self.base, self.cuts = without, setting, base, cuts
        self.trees: list[Tree] = []
        self.written = 0  # trees that are in the written scores
        self._start()

    @property
    def done(self) -> bool:
        return len(self.trees) >= self.setting.stages

    def _start(self) -> None:
        self.grown, self.hists, self.splits, self.depth, self.sums = Tree(), {}, {}, {0: 0}, {}
        self.grown.add(0.0)
        self.wanted, self.siblings = [0], {}

    def probability(self, x: np.ndarray) -> np.ndarray:
        bins, raw = binned(x, self.cuts), np.full(len(x), self.base)
        for t in self.trees:
            raw += t.raw(bins)
        return 1.0 / (1.0 + np.exp(-np.clip(raw, -700, 700)))

    def take(self, hists: np.ndarray) -> None:
        """Use the histograms that were asked for; ends the tree or asks for more."""
        for node, hist in zip(self.wanted, hists):
            self.hists[node] = hist
            if node in self.siblings:
                other, parent = self.siblings[node]
                self.hists[other] = self.hists.pop(parent) - hist
        for node in {*self.wanted, *(o for o, _ in self.siblings.values())}:
            self.sums.setdefault(node, self.hists[node][0].sum(axis=0))
            self.splits[node] = best_split(self.hists[node], self.setting)
        chosen, ahead = self._grow()
        if ahead:
            self.wanted, self.siblings = [], {}
            for node in ahead:
                self._split(node)
                a, b = self.grown.left[node], self.grown.right[node]
                if self.sums[a][2] > self.sums[b][2]:
                    a, b = b, a
                self.wanted.append(a)
                self.siblings[a] = (b, node)
            return
        self.trees.append(self._finished(chosen))
        if not self.done:
            self._start()

    def _split(self, node: int) -> None:
        """Give a node its children."""
        if self.grown.left[node] >= 0:
            return
        _, f, b, miss, left, right = self.splits[node]
        self.grown.feature[node], self.grown.bin[node], self.grown.missing_left[node] = f, b, miss
        for side, sums in (("left", left), ("right", right)):
            child = self.grown.add(0.0)
            getattr(self.grown, side)[node] = child
            self.depth[child], self.sums[child] = self.depth[node] + 1, sums

    def _can_split(self, node: int) -> bool:
        s = self.setting
        return (s.depth is None or self.depth[node] < s.depth) and self.sums[node][2] >= 2 * s.min_rows

    def _grow(self) -> tuple[list[int], list[int]]:
        """(nodes split best first so far, nodes whose children are to be asked for)."""
        chosen, leaves = [], 1
        heap = [(-self.splits[0][0], 0)] if self.splits[0] and self._can_split(0) else []
        while heap and leaves < self.setting.leaves:
            node = heapq.heappop(heap)[1]
            self._split(node)
            chosen.append(node)
            leaves += 1
            children = [c for c in (self.grown.left[node], self.grown.right[node]) if self._can_split(c)]
            if leaves == self.setting.leaves or not children:
                continue
            if any(c not in self.splits for c in children):
                others = [n for _, n in heapq.nsmallest(self.setting.leaves - leaves, heap)]
                for n in others:
                    self._split(n)
                unknown = [n for n in others if n in self.hists and any(self._can_split(c) for c in (self.grown.left[n], self.grown.right[n]))]
                return chosen, [node, *unknown]
            for c in children:
                if self.splits[c]:
                    heapq.heappush(heap, (-self.splits[c][0], c))
        return chosen, []

    def _finished(self, chosen: list[int]) -> Tree:
        """The tree of the chosen splits alone, with its leaves' values."""
        s, out = self.setting, Tree()
        value = lambda node: float(-s.rate * self.sums[node][0] / max(self.sums[node][1] + s.l2, 1e-300))
        places, picked = {0: out.add(value(0))}, set(chosen)
        for node in chosen:  # parents come before their children
            at = places[node]
            out.feature[at], out.bin[at], out.missing_left[at] = self.grown.feature[node], self.grown.bin[node], self.grown.missing_left[node]
            for side in ("left", "right"):
                child = getattr(self.grown, side)[node]
                places[child] = out.add(value(child))
                getattr(out, side)[at] = places[child]
        assert all(out.feature[places[n]] >= 0 for n in picked)
        return out


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """Bin of every value; MISSING where there is none."""
    out = np.empty(x.shape, np.uint8)
    for k, c in enumerate(cuts):
        out[:, k] = np.where(np.isnan(x[:, k]), MISSING, np.searchsorted(c, x[:, k], side="left"))
    return out


def _rows(batches: Iterator[pa.RecordBatch], width: int, problems: int):
    for batch in batches:
        for k in range(batch.num_rows):
            head, bins, raw = (batch.column(c)[k].as_buffer() for c in range(3))
            label, fold, weight = np.frombuffer(head, float).reshape(3, -1)
            yield label, fold, weight, np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(raw, float).reshape(problems, -1)


_SCHEMA = "head binary, bins binary, raw binary"


def fit_group(blocks: Blocks, problems: list[Boosted], cuts: list[np.ndarray]) -> None:
    """Grow all problems together."""
    width = len(blocks.features)

    def first(b) -> dict[str, pa.Array]:
        raw = np.repeat([[p.base] for p in problems], len(b.label), axis=1)
        head = np.array([b.label, b.fold, b.weight])
        return {n: pa.array([v.tobytes()], pa.binary()) for n, v in (("head", head), ("bins", binned(b.x, cuts)), ("raw", raw))}

    state = materialise(blocks.map(first, _SCHEMA), "binned")
    while any(not p.done for p in problems):
        live = [(k, p) for k, p in enumerate(problems) if not p.done]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def one(label, fold, weight, bins, raw):
                parts = []
                for k, p in live:
                    rows = fold != p.without if p.without != WHOLE else np.ones(len(label), bool)
                    b, y, w = bins[rows], label[rows], weight[rows]
                    f = raw[k, rows]
                    for t in p.trees[p.written :]:
                        f = f + t.raw(b)
                    prob = 1.0 / (1.0 + np.exp(-np.clip(f, -700, 700)))
                    slot = np.full(len(p.grown.value), -1)
                    slot[p.wanted] = np.arange(len(p.wanted))
                    at = slot[p.grown.leaf_of(b)]
                    here = at >= 0
                    at, b, sums = at[here] * 256, b[here], (w * (prob - y), w * prob * (1 - prob), np.ones(len(y)))
                    hist = np.zeros((width, len(p.wanted) * 256, 3))
                    for c in range(width):
                        for j, v in enumerate(sums):
                            hist[c, :, j] = np.bincount(at + b[:, c], weights=v[here], minlength=len(p.wanted) * 256)
                    parts.append(hist.reshape(width, len(p.wanted), 256, 3).transpose(1, 0, 2, 3).ravel())
                return np.concatenate(parts)

            yield from _partial(one(*row) for row in _rows(batches, width, len(problems)))

        got, at = total(state.mapInArrow(step, "part binary, shape array<int>")), 0
        for _, p in live:
            size = len(p.wanted) * width * 256 * 3
            p.take(got[at : at + size].reshape(len(p.wanted), width, 256, 3))
            at += size
        if any(not p.done for p in problems) and max(len(p.trees) - p.written for p in problems) >= RECENT:

            def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for k, (_, _, _, bins, raw) in enumerate(_rows([batch], width, len(problems))):
                        raw = np.array([r + sum((t.raw(bins) for t in p.trees[p.written :]), np.zeros(len(r))) for r, p in zip(raw, problems)])
                        yield pa.RecordBatch.from_arrays([batch.column(0)[k : k + 1], batch.column(1)[k : k + 1], pa.array([raw.tobytes()], pa.binary())], names=["head", "bins", "raw"])

            state = materialise(state.mapInArrow(renew, _SCHEMA), "binned")
            for p in problems:
                p.written = len(p.trees)


def fit(blocks: Blocks, settings: Sequence[Setting], outs: Sequence[int] | None = None) -> dict[tuple[str, int], Boosted]:
    """Boosted models by (setting's text, left-out fold)."""
    cuts = cut_points(blocks, BINS)
    outs = [*blocks.folds, WHOLE] if outs is None else list(outs)
    places = {k: i for i, k in enumerate(outs)}

    def step(b) -> np.ndarray:
        got = np.zeros((len(outs), 2))
        for k, i in places.items():
            rows = b.fold != k if k != WHOLE else np.ones(len(b.label), bool)
            got[i] = [(b.weight * (b.label == y))[rows].sum() for y in (0, 1)]
        return got

    shares = blocks.reduce(step)
    if not (shares > 0).all():
        raise ValueError("a fold's train part has one label only")
    base = {k: float(np.log(shares[i, 1] / shares[i, 0])) for k, i in places.items()}
    problems = {(s.text(), k): Boosted(k, s, base[k], cuts) for s in settings for k in outs}
    group, size = [], 0
    for p in problems.values():
        need = (p.setting.leaves // 2 + 1) * len(blocks.features) * _CELL
        if group and size + need > PASS_BYTES:
            fit_group(blocks, group, cuts)
            group, size = [], 0
        group.append(p)
        size += need
    if group:
        fit_group(blocks, group, cuts)
    return problems
