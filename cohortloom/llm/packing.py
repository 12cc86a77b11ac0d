"""Packing documents into sequences by length patterns and non-negative least squares.

Documents are encoded where they lie; only pieces (key, place, length, checksum) are written. The histogram
of piece lengths has at most `capacity` bins, so the plan is made on the driver from it alone:

1. patterns of few documents whose lengths fill a sequence exactly are enumerated from the lengths present;
2. repeat counts are fitted to the histogram by non-negative least squares (multiplicative updates);
3. counts are rounded, never above what the histogram still holds;
4. the residual lengths are packed best-fit in decreasing order, all documents of a length at once.

The plan is a list of runs: documents of a length with ranks [rank, rank + n) go to sequences
[sequence, sequence + n) at an offset. It has at most MAX_PATTERNS times the documents of a pattern plus a
few runs per length, whatever the corpus size. Pieces get their rank inside their length block by block
and look up their run.

Defined cases: NULL and empty texts are a document of the end id alone; longer documents are cut into
pieces of `capacity`; repeated rows are packed each for itself; an empty table has no pieces.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.ranks import block_of, gapless, with_row_ids
from cohortloom.llm.tokens import END_ID, word_bpe_path, word_encoder

CAPACITY = 4096
MAX_PATTERNS = 20_000
FEW = 4


@dataclass
class Group:
    """`n` sequences filled alike: slots of (length, first rank, offset)."""

    n: int
    used: int
    slots: tuple[tuple[int, int, int], ...]

    def split(self, k: int) -> tuple[Group, Group]:
        rest = tuple((length, rank + k, offset) for length, rank, offset in self.slots)
        return Group(k, self.used, self.slots), Group(self.n - k, self.used, rest)

    def add(self, length: int, rank: int) -> Group:
        return Group(self.n, self.used + length, (*self.slots, (length, rank, self.used)))


def enumerate_patterns(histogram: dict[int, int], capacity: int, most: int = MAX_PATTERNS) -> list[tuple[int, ...]]:
    """Multisets of at most FEW present lengths that fill a sequence; all pairs first, then by plenty of their lengths."""
    present = {n for n, c in histogram.items() if c > 0}
    patterns = {(capacity,)} if capacity in present else set()
    patterns |= {(a, capacity - a) for a in present if a >= capacity - a and capacity - a in present}
    plenty = sorted(present, key=lambda n: (-histogram[n], n))
    for few in range(3, FEW + 1):
        width = int((most * few) ** (1 / (few - 1))) + few
        found = 0
        for inner in itertools.combinations_with_replacement(plenty[:width], few - 1):
            last = capacity - sum(inner)
            if last > 0 and last in present:
                before = len(patterns)
                patterns.add(tuple(sorted((*inner, last), reverse=True)))
                found += len(patterns) - before
                if found >= most // 2:
                    break
    return sorted(patterns, reverse=True)[:most]


def fit_repeats(patterns: list[tuple[int, ...]], histogram: dict[int, int], capacity: int, rounds: int = 400) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, longer lengths weighing more."""
    if not patterns:
        return np.zeros(0)
    rows = np.concatenate([np.full(len(p), k) for k, p in enumerate(patterns)])
    cols = np.concatenate([np.array(p) for p in patterns])
    want = np.zeros(capacity + 1)
    for length, count in histogram.items():
        want[length] = count
    weight = np.sqrt(np.arange(capacity + 1) / capacity)
    reach = np.bincount(rows, weights=(weight * want)[cols], minlength=len(patterns))
    uses = np.bincount(cols, minlength=capacity + 1)
    x = np.maximum(np.bincount(rows, weights=(want / np.maximum(uses, 1))[cols], minlength=len(patterns)), 1e-9)
    for _ in range(rounds):
        fitted = np.bincount(cols, weights=x[rows], minlength=capacity + 1)
        back = np.bincount(rows, weights=(weight * fitted)[cols], minlength=len(patterns))
        x *= reach / np.maximum(back, 1e-12)
    return x


def best_fit(left: dict[int, int], ranks: dict[int, int], groups: list[Group], capacity: int) -> list[Group]:
    """Best-fit decreasing of the residual counts into groups with room, and new sequences, a length at a time."""
    room: dict[int, list[Group]] = {}
    for g in groups:
        room.setdefault(capacity - g.used, []).append(g)
    free = sorted(room)
    full = room.pop(0, [])
    free = [r for r in free if r]

    def put(g: Group) -> None:
        r = capacity - g.used
        if r == 0:
            full.append(g)
        elif r in room:
            room[r].append(g)
        else:
            room[r] = [g]
            bisect.insort(free, r)

    for length in sorted((n for n, c in left.items() if c), reverse=True):
        count, rank = left[length], ranks.get(length, 0)
        while count:
            at = bisect.bisect_left(free, length)
            if at == len(free):
                each = capacity // length
                whole, rest = divmod(count, each)
                for n, docs in ((whole, each), (1, rest)):
                    if n and docs:
                        g = Group(n, 0, ())
                        for k in range(docs):
                            g = g.add(length, rank + k * n)
                        rank += n * docs
                        put(g)
                count = 0
                continue
            r = free[at]
            g = room[r].pop()
            if not room[r]:
                del room[r]
                free.pop(at)
            if g.n > count:
                g, other = g.split(count)
                put(other)
            put(g.add(length, rank))
            rank += g.n
            count -= g.n
    return full + [g for gs in room.values() for g in gs]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that hold every document of the histogram exactly once."""
    patterns = enumerate_patterns(histogram, capacity)
    fitted = fit_repeats(patterns, histogram, capacity)
    left, ranks, groups = dict(histogram), {}, []
    for k in np.argsort(-fitted, kind="stable"):
        pattern = patterns[k]
        most = min(left[n] // pattern.count(n) for n in set(pattern))
        repeats = min(most, int(round(float(fitted[k]))))
        if repeats > 0:
            g = Group(repeats, 0, ())
            for length in pattern:
                g = g.add(length, ranks.get(length, 0))
                ranks[length] = ranks.get(length, 0) + repeats
                left[length] -= repeats
            groups.append(g)
    return best_fit(left, ranks, groups, capacity)


def runs(groups: list[Group]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: a document of a length and rank finds its run by search."""
    rows, sequence = [], 0
    for g in groups:
        rows += [(length, rank, sequence, offset) for length, rank, offset in g.slots]
        sequence += g.n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every row's ids, cut at `capacity`."""
    path = tokenizer or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = word_encoder(path), END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            keys, out = batch.column(0).to_pylist(), []
            for k, t in zip(keys, batch.column(1)):
                ids = encoder.encode(t.as_py()) + end
                for p, a in enumerate(range(0, len(ids), step)):
                    part = ids[a : a + step]
                    out.append((k, p, a // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of `docs` with their sequence_id and their offset in it."""
    cut = with_row_ids(pieces(docs, key, text, tokenizer, capacity), "_row", "pieces").withColumn("_block", block_of("_row"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = runs(plan(histogram, capacity))
    ranked = gapless(cut, ["length"], "_block", ["_row"], "_rank").drop("_row", "_block")
    order = (table["length"] << 44) + table["rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(order, (length << 44) + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            columns = [batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(table["offset"][at])],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return ranked.select(key, "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        place, f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
