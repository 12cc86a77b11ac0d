"""Archives read back equal what was written."""

import hashlib
import io

import pytest
import zstandard

from cohortloom.llm import warc as W


class Kept(io.BytesIO):
    def close(self):
        self.seek(0)


@pytest.mark.parametrize("count", [0, 1, 7, 40, 300])
def test_archive_round_trip(count, monkeypatch):
    monkeypatch.setattr(W, "SAMPLE_BYTES", 1 << 16)
    pages = [f"<html>page {k} of some length {k * k} {'x' * (k % 300)}</html>".encode() for k in range(count)]
    records = [W.build_record(k, f"http://h/{k}\r\né", p, hashlib.sha1(p).hexdigest(), None) for k, p in enumerate(pages)]
    out = Kept()
    writer = W.ArchiveWriter(out)
    for r in records:
        writer.add(r)
    writer.close()
    assert list(W.read_archive(out, chunk=1000)) == records
    assert (out.getvalue()[:4] == b"\x5d\x2a\x4d\x18") == (count >= 7)
    if count >= 40:  # every record is a frame of its own, readable alone with the dictionary
        size = int.from_bytes(out.getvalue()[4:8], "little")
        data = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(out.getvalue()[8 : 8 + size]))
        reader = zstandard.ZstdDecompressor(dict_data=data)
        assert reader.decompressobj().decompress(out.getvalue()[8 + size :]) == records[0]
    with pytest.raises(ValueError, match="inside"):
        if not count:
            raise ValueError("inside")
        list(W.read_archive(io.BytesIO(out.getvalue()[:-3])))


def test_pages_round_trip(spark):
    big = "<p>" + "same page " * 200 + "é</p>"
    rows = [
        (1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c", "short"), (4, "http://d", "short"), (5, "http://e", None),
        (6, "http://f", ""), (9, None, big), (None, "http://g", big), (None, "http://h", "y" * 2000), (7, "u\nv", big + "!"),
    ]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id bigint, url string, html string, digest int, refers_to string")
    found = sorted(W.round_trip(pages).collect(), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == big and page != 9
        want.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert W.round_trip(pages.limit(0)).count() == 0
