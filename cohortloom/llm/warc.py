"""WARC archives of individually compressed records with an embedded Zstandard dictionary.

A file starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary, itself compressed, built
from the file's first records; every record is a frame of its own, compressed with the dictionary. Equal
payloads of at least `least` bytes are stored once: the row with the largest id is the response, the others
are revisit records with its payload digest and id. Which rows are revisits is decided on digests only, and
pages are met with those decisions by a hash of their id; a file takes a whole partition of pages.

The dictionary is trained on the first SAMPLE_BYTES of a file's records at most (a documented bound of the
training, not of the archive). A file with too few records to train has no dictionary frame, as the
format allows.

Defined cases: a NULL payload is empty; NULL urls become `urn:page:<id>`; a NULL id is archived without an
id header and is the response only where no other row has the payload; repeated rows of the largest id are
responses each; an empty table has no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.files import new_file, open_file
from cohortloom.session import materialise, scratch_path

LEAST = 1000
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
# Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page: int | None, digest: str, copy: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}:{copy}')}>"


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its HTTP block, or a revisit that refers to another page's response."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"),
        ("WARC-Payload-Digest", f"sha1:{sha}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if revisit:
        fields += [
            ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(fields by lower-case name, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


class ArchiveWriter:
    """Collects the first records until the dictionary can be trained, then compresses each as it comes."""

    def __init__(self, out):
        self.out, self.first, self.held, self.compressor = out, [], 0, None

    def add(self, record: bytes) -> None:
        if self.compressor is not None:
            self.out.write(self.compressor.compress(record))
            return
        self.first.append(record)
        self.held += len(record)
        if self.held >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, self.held // 8), self.first, level=LEVEL)
        except zstandard.ZstdError:
            trained = None  # too few or too small records
        if trained is not None:
            packed = zstandard.ZstdCompressor(level=19).compress(trained.as_bytes())
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True, write_checksum=True)
        for record in self.first:
            self.out.write(self.compressor.compress(record))
        self.first = []

    def close(self) -> None:
        if self.compressor is None:
            self.start()
        self.out.close()


def read_archive(source, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Records of an archive, frame by frame; only a chunk and one record are in memory."""
    trained, head = None, source.read(8)
    pending = head
    if len(head) == 8:
        magic, size = struct.unpack("<II", head)
        if magic == DICTIONARY_FRAME:
            data = source.read(size)
            if data[:4] == ZSTD_MAGIC:
                data = zstandard.ZstdDecompressor().decompress(data)
            trained, pending = zstandard.ZstdCompressionDict(data), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    frame, parts = None, []
    while True:
        if not pending:
            pending = source.read(chunk)
            if not pending:
                break
        if frame is None:
            frame, parts = decompressor.decompressobj(), []
        parts.append(frame.decompress(pending))
        pending = frame.unused_data if frame.eof else b""
        if frame.eof:
            yield b"".join(parts)
            frame = None
    if frame is not None:
        raise ValueError("the archive ends inside a record")


def revisits(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(key, digest, refers_to) of the rows whose payload another row of larger id holds."""
    raw = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.where(F.octet_length(F.coalesce(F.col(payload), F.lit(""))) >= least).select(F.col(key).alias("k"), F.sha1(raw).alias("digest"))
    repeated = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("refers_to"))
    repeated = repeated.where((F.col("n") > 1) & F.col("refers_to").isNotNull()).select("digest", "refers_to")
    met = rows.join(repeated, "digest").where(~F.col("k").eqNullSafe(F.col("refers_to")))
    return met.select("k", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages and return the list of files: file, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, count = None, 0
        for batch in batches:
            pages_, urls, texts, refs = (batch.column(k).to_pylist() for k in range(4))
            for page, u, text, ref in zip(pages_, urls, texts, refs):
                if writer is None:
                    name, out = new_file(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    writer = ArchiveWriter(out)
                data = (text or "").encode()
                writer.add(build_record(page, u, data, hashlib.sha1(data).hexdigest(), ref))
                count += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [count]})

    decided = revisits(pages, key, payload, least)
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), F.col(payload).alias("p"))
    same = decided.select(F.col("k").alias("k2"), "digest", "refers_to")
    digest = F.sha1(F.encode(F.coalesce("p", F.lit("")), "utf-8"))
    met = rows.join(same, F.col("k").eqNullSafe(F.col("k2")) & (digest == F.col("digest")), "left")
    return materialise(met.select("k", "u", "p", "refers_to").mapInArrow(run, "file string, records bigint"), "archives")


def read_archives(files: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) of every record of the listed files."""

    def rows_of(file: str) -> Iterator[tuple]:
        with open_file(folder, file) as source:
            for record in read_archive(source):
                fields, block = parse_record(record)
                http, _, body = block.partition(b"\r\n\r\n")
                stated = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                size = int(http.decode().rpartition("Content-Length: ")[2])
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (len(body) != size or hashlib.sha1(body).hexdigest() != stated):
                    raise ValueError(f"{file}: a payload differs from its digest")
                page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                yield (page and int(page), size, stated, fields["warc-type"], other and int(other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        names = [key, "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                held: list[tuple] = []
                for row in rows_of(file):
                    held.append(row)
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

    spread = files.select("file").repartition(max(1, files.count()))
    return spread.mapInArrow(run, f"`{key}` bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Write the pages to new archives of the shared folder and read them back."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, key, url, payload, least), folder, key)


def oracle(least: int = LEAST) -> str:
    """What `round_trip` of `pages` reads back, in DuckDB SQL."""
    return f"""
    WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS bytes FROM pages),
    m AS (SELECT *, CASE WHEN bytes >= {least} THEN max(page_id) OVER (PARTITION BY digest) END AS top FROM p)
    SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id <> top THEN top END AS refers_to FROM m"""
