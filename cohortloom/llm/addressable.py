"""Token ids in directly addressable codes: random access to any token without decoding a block.

An id is split into chunks from its low bits; level k stores the k-th chunk of the ids that reach it, one
after another, and a bitmap that says which of them go on to level k + 1. The place of an id on the next
level is the number of set bits before it, read from a rank directory (a running total for every 512 bits)
and the bits of one directory step. A file holds segments, each with its documents' keys and lengths and
its levels, and a footer with the segments' places:

    magic | segment... | footer (JSON) | footer length (8 bytes) | magic

A segment takes documents until it holds SEGMENT_IDS ids, so memory is bounded by that and the longest
document. Files are written in ascending order of the key by range partitions; a manifest table lists the
valid files in order, with the number of ids before each.

Defined cases: NULL and empty texts are the end id alone; NULL keys come first; repeated rows are written
one after another; an empty table has no files and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.files import new_file, open_file
from cohortloom.llm.tokens import END_ID, word_bpe_path, word_encoder
from cohortloom.session import materialise, scratch_path

MAGIC = b"DACTOK01"
WIDTHS = (8, 4, 4, 8, 8)
RANK_STEP = 512
SEGMENT_IDS = 1 << 21


def _pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2^width in `width` bits each, low bits first."""
    if width == 8:
        return values.astype(np.uint8).tobytes()
    if width == 4:
        halves = np.zeros(len(values) + len(values) % 2, np.uint8)
        halves[: len(values)] = values
        return (halves[0::2] | halves[1::2] << 4).tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=values.dtype)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack(data: memoryview, count: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if width == 8:
        return raw[:count].astype(np.uint32)
    if width == 4:
        out = np.empty(2 * len(raw), np.uint32)
        out[0::2], out[1::2] = raw & 15, raw >> 4
        return out[:count]
    bits = np.unpackbits(raw, count=count * width, bitorder="little").reshape(count, width)
    return bits @ (1 << np.arange(width, dtype=np.uint32))


class Span:
    """A stretch of an open file; slices are read when they are asked for."""

    def __init__(self, source, at: int, size: int):
        self.source, self.at, self.size = source, at, size

    def __getitem__(self, part: slice | int) -> bytes | int:
        if isinstance(part, int):
            return self.source.read_at(1, self.at + part)[0]
        first, last, _ = part.indices(self.size)
        return self.source.read_at(max(0, last - first), self.at + first)


def _part(data: memoryview | Span, at: int, size: int) -> memoryview | Span:
    return Span(data.source, data.at + at, size) if isinstance(data, Span) else data[at : at + size]


class Level:
    """Chunks of one level with their continuation bitmap and its rank directory, in memory or in a file."""

    def __init__(self, width: int, count: int, chunks: memoryview | Span, bitmap: memoryview | Span, ranks: memoryview | Span):
        self.width, self.count, self.chunks, self.bitmap, self.ranks = width, count, chunks, bitmap, ranks

    def chunk(self, i: int) -> int:
        first = i * self.width
        window = int.from_bytes(self.chunks[first // 8 : (first + self.width + 7) // 8], "little")
        return (window >> first % 8) & ((1 << self.width) - 1)

    def goes_on(self, i: int) -> bool:
        return bool(self.bitmap[i // 8] >> i % 8 & 1)

    def rank(self, i: int) -> int:
        """Set bits before place i."""
        step = i // RANK_STEP
        inside = int.from_bytes(self.bitmap[step * RANK_STEP // 8 : (i + 7) // 8], "little")
        return int.from_bytes(self.ranks[4 * step : 4 * step + 4], "little") + (inside & ((1 << (i - step * RANK_STEP)) - 1)).bit_count()


def encode_ids(ids: np.ndarray, widths: Sequence[int] = WIDTHS) -> tuple[list[dict], list[bytes]]:
    """Levels of the ids: their sizes, and chunks, bitmap and rank directory of each in turn."""
    sizes, parts, rest = [], [], ids.astype(np.uint32)
    for width in widths:
        more = rest >> np.uint32(width)
        on = more > 0
        bitmap = np.packbits(on, bitorder="little")
        steps = -(-len(on) // RANK_STEP)
        totals = np.add.reduceat(on, np.arange(steps) * RANK_STEP, dtype=np.int64) if steps else np.zeros(0, np.int64)
        ranks = (np.cumsum(totals) - totals).astype("<u4")
        own = [_pack(rest & np.uint32((1 << width) - 1), width), bitmap.tobytes(), ranks.tobytes()]
        sizes.append({"width": width, "count": len(rest), "sizes": [len(x) for x in own]})
        parts += own
        rest = more[on]
        if not len(rest):
            return sizes, parts
    raise ValueError("an id has more bits than all levels")


class Segment:
    """Ids of consecutive documents, from the bytes of a segment or from its stretch of a file."""

    def __init__(self, data: memoryview | Span):
        (size,) = struct.unpack("<Q", data[:8])
        head = json.loads(bytes(data[8 : 8 + size]))
        self._data, self._docs, self._at = data, head["docs"], 8 + size
        self.levels, at = [], self._at + 13 * self._docs
        for x in head["levels"]:
            own = []
            for n in x["sizes"]:
                own.append(_part(data, at, n))
                at += n
            self.levels.append(Level(x["width"], x["count"], *own))

    def _column(self, first: int, width: int, kind: str) -> np.ndarray:
        at = self._at + first * self._docs
        return np.frombuffer(self._data[at : at + width * self._docs], kind)

    @property
    def keys(self) -> np.ndarray:
        return self._column(0, 8, "<i8")

    @property
    def missing(self) -> np.ndarray:
        return self._column(8, 1, "u1").astype(bool)

    @property
    def lengths(self) -> np.ndarray:
        return self._column(9, 4, "<u4").astype(np.int64)

    def get(self, i: int) -> int:
        """The i-th id; only its own chunks and one directory step per level are read."""
        value = shift = 0
        for level in self.levels:
            value |= level.chunk(i) << shift
            if not level.goes_on(i):
                return value
            i, shift = level.rank(i), shift + level.width
        raise ValueError("the last level goes on")

    def ids(self) -> np.ndarray:
        """All ids."""
        out, places, shift = None, None, 0
        for level in self.levels:
            chunks = _unpack(level.chunks, level.count, level.width)
            if out is None:
                out, places = chunks, np.arange(level.count)
            else:
                out[places] |= chunks << np.uint32(shift)
            shift += level.width
            on = np.unpackbits(np.frombuffer(level.bitmap, np.uint8), count=level.count, bitorder="little").astype(bool)
            places = places[on]
        return out


def segment_bytes(keys: list[int | None], lengths: list[int], ids: np.ndarray, widths: Sequence[int] = WIDTHS) -> bytes:
    levels, parts = encode_ids(ids, widths)
    head = json.dumps({"docs": len(keys), "levels": levels}).encode()
    columns = [
        np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is None for k in keys), np.array(lengths, "<u4").tobytes(),
    ]
    return b"".join([struct.pack("<Q", len(head)), head, *columns, *parts])


class FileWriter:
    """One file of segments; documents are added in order."""

    def __init__(self, out):
        self.out, self.at, self.index = out, out.write(MAGIC), []
        self.keys, self.lengths, self.parts, self.held = [], [], [], 0

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.parts.append(ids)
        self.held += len(ids) // 4
        if self.held >= SEGMENT_IDS:
            self.flush()

    def flush(self) -> None:
        if self.keys:
            data = segment_bytes(self.keys, self.lengths, np.frombuffer(b"".join(self.parts), "<u4"))
            self.index.append({"at": self.at, "size": len(data), "docs": len(self.keys), "ids": self.held})
            self.at += self.out.write(data)
            self.keys, self.lengths, self.parts, self.held = [], [], [], 0

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the file."""
        self.flush()
        footer = json.dumps(self.index).encode()
        self.out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.out.close()
        return sum(x["docs"] for x in self.index), sum(x["ids"] for x in self.index)


class TokenFile:
    """Segments of a written file; `get` finds any id of the file without reading a segment."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        tail = source.read_at(16, end - 16)
        if tail[8:] != MAGIC or source.read_at(8, 0) != MAGIC:
            raise ValueError("not a token file, or cut off")
        (size,) = struct.unpack("<Q", tail[:8])
        self.index = json.loads(source.read_at(size, end - 16 - size))

    def segments(self) -> Iterator[Segment]:
        for x in self.index:
            yield Segment(memoryview(self.source.read_at(x["size"], x["at"])))

    def get(self, i: int) -> int:
        """The i-th id of the file: its segment's head, then a chunk, a directory step and a rank per level are read."""
        for x in self.index:
            if 0 <= i < x["ids"]:
                return Segment(Span(self.source, x["at"], x["size"])).get(i)
            i -= x["ids"]
        raise IndexError("past the last id of the file")


def write_tokens(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the ids of `docs` and return the manifest: part, file, docs, ids, start (ids before the file)."""
    path = tokenizer or word_bpe_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, writer = word_encoder(path), END_ID.to_bytes(4, "little"), None
        part = TaskContext.get().partitionId()
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    name, out = new_file(folder, f"tokens-{part:06d}", ".dac")
                    writer = FileWriter(out)
                writer.add(k, encoder.encode(t.as_py()) + end)
        if writer is not None:
            found, ids = writer.close()
            columns = [pa.array([part], pa.int32()), pa.array([name]), pa.array([found]), pa.array([ids])]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "file", "docs", "ids"])

    order = [F.col(key).cast("long").alias("key"), F.col(text).alias("text")]
    rows = docs.select(*order, F.xxhash64(text).alias("tie"))
    by = [F.col("key").asc_nulls_first(), F.col("tie")]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("key", "text")
    written = materialise(ranged.mapInArrow(run, "part int, file string, docs bigint, ids bigint"), "manifest")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    return written.withColumn("start", F.coalesce(before, F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files of the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_file(folder, file) as source:
                    for s in TokenFile(source).segments():
                        raw = memoryview(s.ids().astype("<u4").tobytes())
                        lengths = s.lengths
                        ends = np.cumsum(lengths)
                        crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - lengths, ends)]
                        columns = [
                            pa.array(s.keys, mask=s.missing), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                        ]
                        start += int(ends[-1])
                        yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "n_tokens", "ids_crc32"])

    files = manifest.select("file", "start")
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(run, f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write `docs` to new files of the shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_tokens(materialise(write_tokens(docs, folder, key, text, tokenizer), "files"), folder, key)
