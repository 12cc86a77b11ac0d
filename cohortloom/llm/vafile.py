"""Centroid clustering over a vector approximation file.

Every vector is written twice to files of the shared folder: as a cell number of BITS bits per dimension (the
approximation), and whole, as a record of fixed width. A round reads the approximations. A lookup table per dimension
gives the least and the largest squared difference between a cell and each centroid; their sums are an interval of
the distance to each centroid. Centroids whose interval starts beyond the end of another's are out. For those left,
the difference of two distances is linear in the vector, so its error against the cells' middles has one bound per
pair of centroids; that is a second, tighter interval. Only vectors for which both leave more than one centroid, or
whose centroid changed (their sums move), are fetched whole from their place in the file. All numbers are integers,
so sums, centroids and distances are exact.

A row per file travels between rounds: its name, size, and the centroid of each vector. Sums are kept as
differences against the round before, added up in Spark; the driver holds the centroids only. A file holds at most
FILE_ROWS vectors and is worked on in chunks of CHUNK_ROWS. Files of lost or repeated tasks are in no list.

Defined cases: NULL vectors, vectors with NULL or non-finite entries, and those of another width are dropped. Fewer
vectors than centroids give that many centroids; an empty table gives no rows. Repeated rows are vectors of their
own; of equal hashes the smaller vector starts first, and NULL keys start last. Distances that tie go to the smaller
centroid. Components beyond 2^28 steps are an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.files import new_file, open_file
from cohortloom.llm.vectors import matrix, whole_rows
from cohortloom.session import materialise, scratch_path

BITS = 6
FILE_ROWS = 1 << 20
CHUNK_ROWS = 1 << 14
#: Records between two wanted ones that are read along rather than skipped.
NEAR = 16
LIMIT = 1 << 28
NONE = np.uint16(65535)


def record(width: int) -> np.dtype:
    return np.dtype([("key", "<i8"), ("missing", "u1"), ("x", "<i4", (width,))])


class Cells:
    """Even cells of `bits` bits between the least and the largest value of each dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int = BITS):
        self.low, self.bits = low, bits
        self.step = -(-(high - low + 1) // (1 << bits))  # whole numbers in a cell
        edges = low[:, None] + self.step[:, None] * np.arange((1 << bits) + 1)
        self.first, self.last = edges[:, :-1], edges[:, 1:] - 1

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Packed cell numbers, one row of bytes per vector."""
        cells = ((x - self.low) // self.step).astype(np.uint8)
        return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(x), -1), axis=1)

    def row_bytes(self) -> int:
        return (len(self.low) * self.bits + 7) // 8

    def decode(self, packed: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(packed, axis=1, count=len(self.low) * self.bits).reshape(len(packed), -1, self.bits)
        return np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - self.bits, 0))), axis=2)[:, :, 0]


class Bounds:
    """Lookup tables of one set of centroids."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        c = centroids.T[:, None, :]  # dimension, cell, centroid
        first, last = cells.first[:, :, None], cells.last[:, :, None]
        self.least = np.square(np.maximum(np.maximum(first - c, c - last), 0))
        self.most = np.square(np.maximum(np.abs(first - c), np.abs(last - c)))
        self.middle = np.square(first + last - 2 * c)  # four times the distance from the cell's middle
        apart = np.abs(centroids[:, None, :] - centroids[None, :, :])
        self.slack = (apart * (4 * (cells.step - 1))).sum(axis=2)  # four times the error of a difference of two distances

    def candidates(self, cells: np.ndarray) -> np.ndarray:
        """Whether a centroid may be the nearest, a row per vector."""
        shape = (len(cells), self.slack.shape[0])
        least, most, middle = (np.zeros(shape, np.int64) for _ in range(3))
        for d in range(cells.shape[1]):
            least += self.least[d][cells[:, d]]
            most += self.most[d][cells[:, d]]
            middle += self.middle[d][cells[:, d]]
        open_ = least <= most.min(axis=1)[:, None]
        best = np.where(open_, middle, np.iinfo(np.int64).max).argmin(axis=1)
        near = middle - middle[np.arange(len(cells)), best][:, None] <= self.slack[best]
        return open_ & near


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every vector to every centroid."""
    out = np.empty((len(x), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        apart = x - c
        out[:, k] = np.einsum("ij,ij->i", apart, apart)
    return out


def _fetch(source, wanted: np.ndarray, start: int, kind: np.dtype) -> np.ndarray:
    """Records at the ascending places `wanted` after record `start`; near ones in one read."""
    out = np.empty(len(wanted), kind)
    cuts = np.flatnonzero(np.diff(wanted) > NEAR) + 1
    for run in np.split(np.arange(len(wanted)), cuts) if len(wanted) else ():
        first, last = int(wanted[run[0]]), int(wanted[run[-1]])
        source.seek((start + first) * kind.itemsize)
        got = np.frombuffer(source.read((last - first + 1) * kind.itemsize), kind)
        out[run] = got[wanted[run] - first]
    return out


def _chunks(folder: str, cells: Cells, file: dict, bounds: Bounds):
    """(first place, candidates, source of whole records) of each chunk of a file."""
    step = cells.row_bytes()
    with open_file(folder, file["cells"]) as approx, open_file(folder, file["vectors"]) as whole:
        for start in range(0, file["n"], CHUNK_ROWS):
            count = min(CHUNK_ROWS, file["n"] - start)
            packed = np.frombuffer(approx.read(count * step), np.uint8).reshape(count, step)
            yield start, bounds.candidates(cells.decode(packed)), whole


class VectorFiles:
    """The written vectors of a table and the rounds over them."""

    def __init__(self, rows: DataFrame, width: int, bits: int = BITS):
        """`rows`: (key, x) with x of `width` whole numbers."""
        self.spark, self.width, self.folder = rows.sparkSession, width, scratch_path(rows.sparkSession, "vectors")
        ends = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
        spans = {r["at"]: (r["low"], r["high"]) for r in ends}
        if any(max(-a, b) > LIMIT for a, b in spans.values()):
            raise OverflowError(f"a component is beyond {LIMIT} steps")
        low, high = (np.array([spans.get(k, (0, 0))[i] for k in range(width)], np.int64) for i in (0, 1))
        self.cells = Cells(low, high, bits)
        self.state = self._write(rows)

    def _write(self, rows: DataFrame) -> DataFrame:
        folder, width, cells, kind = self.folder, self.width, self.cells, record(self.width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, out, count = TaskContext.get().partitionId(), None, 0

            def closed():
                for stream in out[1::2]:
                    stream.close()
                columns = [pa.array([out[0]]), pa.array([out[2]]), pa.array([count], pa.int64()), pa.array([b""], pa.binary())]
                return pa.RecordBatch.from_arrays(columns, names=["cells", "vectors", "n", "near"])

            for batch in batches:
                x, keys = matrix(batch.column(1), width), batch.column(0)
                for at in range(0, len(x), CHUNK_ROWS):
                    chunk, ids = x[at : at + CHUNK_ROWS], keys[at : at + CHUNK_ROWS]
                    if out is None:
                        out, count = (*new_file(folder, f"part-{part:06d}", ".cells"), *new_file(folder, f"part-{part:06d}", ".vectors")), 0
                    block = np.empty(len(chunk), kind)
                    block["key"], block["missing"] = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
                    block["x"] = chunk
                    out[1].write(cells.encode(chunk).tobytes())
                    out[3].write(block.tobytes())
                    count += len(chunk)
                    if count + CHUNK_ROWS > FILE_ROWS:
                        yield closed()
                        out = None
            if out is not None:
                yield closed()

        return materialise(rows.mapInArrow(run, "cells string, vectors string, n bigint, near binary"), "vector-files")

    def _spread(self) -> DataFrame:
        files = self.state.select("cells", "vectors", "n", "near")
        return files.repartition(max(1, min(files.count(), 8 * self.spark.sparkContext.defaultParallelism)))

    def round(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Assign every vector; differences of counts and sums per centroid, and the number of vectors fetched."""
        folder, cells, k, width, kind = self.folder, self.cells, len(centroids), self.width, record(self.width)
        bounds = Bounds(cells, centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.to_pylist():
                    before = np.frombuffer(file["near"], np.uint16) if file["near"] else np.full(file["n"], NONE)
                    after, counts, sums, fetched = np.empty(file["n"], np.uint16), np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0
                    for start, open_, whole in _chunks(folder, cells, file, bounds):
                        old, near = before[start : start + len(open_)], open_.argmax(axis=1)
                        wanted = np.flatnonzero((open_.sum(axis=1) > 1) | (near != old))
                        x = _fetch(whole, wanted, start, kind)["x"].astype(np.int64)
                        near[wanted] = squared(x, centroids).argmin(axis=1)
                        fetched += len(wanted)
                        after[start : start + len(open_)] = near
                        moved = near[wanted] != old[wanted]
                        for side, sign in ((near[wanted], 1), (old[wanted], -1)):
                            for c in np.unique(side[moved]):
                                if c != NONE:
                                    rows = x[moved & (side == c)]
                                    counts[c] += sign * len(rows)
                                    sums[c] += sign * rows.sum(axis=0)
                    columns = [
                        pa.array([file["cells"]]), pa.array([file["vectors"]]), pa.array([file["n"]], pa.int64()), pa.array([after.tobytes()], pa.binary()),
                        pa.array([np.concatenate([[fetched], counts, sums.ravel()]).tolist()], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["cells", "vectors", "n", "near", "totals"])

        made = self._spread().mapInArrow(run, "cells string, vectors string, n bigint, near binary, totals array<bigint>")
        self.state = materialise(made, "assigned")
        found = self.state.select(F.posexplode("totals").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(1 + k + k * width, np.int64)
        for r in found:
            flat[r["at"]] = r["v"]
        return flat[1 : 1 + k], flat[1 + k :].reshape(k, width), int(flat[0])

    def assigned(self, centroids: np.ndarray, key: str) -> DataFrame:
        """(key, cluster, distance) of every vector."""
        folder, cells, kind = self.folder, self.cells, record(self.width)
        bounds = Bounds(cells, centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for file in batch.to_pylist():
                    for start, open_, whole in _chunks(folder, cells, file, bounds):
                        got = _fetch(whole, np.arange(len(open_)), start, kind)
                        x, near = got["x"].astype(np.int64), open_.argmax(axis=1)
                        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
                        near[unsure] = squared(x[unsure], centroids).argmin(axis=1)
                        apart = x - centroids[near]
                        columns = [
                            pa.array(got["key"], mask=got["missing"].astype(bool)), pa.array(near.astype(np.int32)),
                            pa.array(np.einsum("ij,ij->i", apart, apart)),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, names=[key, "cluster", "distance"])

        return self._spread().mapInArrow(run, f"`{key}` bigint, cluster int, distance bigint")


def start_centroids(rows: DataFrame, count: int, salt: str) -> np.ndarray:
    """The vectors with the smallest sha256 of `<salt>:<key>`."""
    ranked = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256).alias("hash"), "x")
    first = ranked.orderBy(F.col("hash").asc_nulls_last(), "x").limit(count).collect()
    return np.array([r["x"] for r in first], np.int64)


def cluster(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = 64, count: int = 40, rounds: int = 5, salt: str = "2",
    bits: int = BITS,
) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector after `rounds` rounds."""
    spark = df.sparkSession
    rows = whole_rows(df, key, vector).where(F.size("x") == width)
    centroids = start_centroids(rows, count, salt)
    if not len(centroids):
        schema = f"`{key}` bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    files = VectorFiles(rows, width, bits)
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for _ in range(rounds):
        more, moved, _ = files.round(centroids)
        counts, sums = counts + more, sums + moved
        centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    found = materialise(files.assigned(centroids, key), "clusters")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}  # one row per centroid
    texts = [",".join(map(str, c)) for c in centroids.tolist()]
    rows = [(k, d, sum(inertia.values()), hashlib.sha256(texts[k].encode()).hexdigest()) for k, d in inertia.items()]
    per = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(width: int = 64, count: int = 40, rounds: int = 5, salt: str = "2") -> str:
    """SQL of `cluster` on `embeddings` with distinct keys: plain rounds over all distances."""
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {width}"
        f" AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {width})",
        f"e AS (SELECT vec_id, unnest(range({width})) AS i, unnest(x) AS v FROM v)",
        f"p AS (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS k, x FROM v QUALIFY k < {count})",
        f"c0 AS (SELECT k, unnest(range({width})) AS i, unnest(x) AS c FROM p)",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, k, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d FROM e JOIN c{r} USING (i) GROUP BY vec_id, k)")
        steps.append(f"a{r} AS (SELECT vec_id, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, k) = 1)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT k, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{r} JOIN e USING (vec_id) GROUP BY k, i)")
            steps.append(f"c{r + 1} AS (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM c{r} LEFT JOIN s{r} USING (k, i))")
    steps.append(f"h AS (SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)")
    return (
        "WITH " + ", ".join(steps) + " SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (k)"
    )
