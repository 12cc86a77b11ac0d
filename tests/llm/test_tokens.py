"""The word memory, the directly addressable codes and the packing against the tokenizer itself."""

import io
import random
import zlib

import numpy as np
import pytest

from cohortloom.llm import addressable as A
from cohortloom.llm import packing as P
from cohortloom.llm import tokens as T
from cohortloom.session import scratch_path

from .conftest import EDGE_TEXTS


@pytest.fixture(scope="module")
def encoder():
    return T.word_encoder(T.word_bpe_path())


def ids_of(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, T.END_ID]


def test_words_encode_as_whole_texts(encoder, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 500)
    r = random.Random(5)
    signs = [*" \n\t\r\x0b\x1c\x85  abCDé'ÀßÿªºİıΣς’<|>.,!_9²ǅ́日\U0001f600-", "<|endoftext|>", "'s", "don't"]
    for _ in range(4000):
        text = "".join(r.choice(signs) for _ in range(r.randint(0, 14)))
        assert [*np.frombuffer(encoder.encode(text), "<u4"), 1] == ids_of(encoder, text), repr(text)
    assert len(encoder) <= 501


def test_codes_give_every_id_back():
    r = np.random.default_rng(1)
    for ids in (np.array([0], "<u4"), r.integers(0, 49408, 3000).astype("<u4"), np.array([0, 255, 256, 4095, 4096, 65535, 65536, 2**24, 2**32 - 1], "<u4")):
        s = A.Segment(A.segment_bytes([1, None], [len(ids) - 1, 1], ids))
        assert (s.ids() == ids).all() and [s.get(i) for i in range(len(ids))] == ids.tolist()
        assert s.keys[0] == 1 and s.missing.tolist() == [False, True]
    with pytest.raises(ValueError, match="more bits"):
        A.encode_ids(np.array([4096], "<u4"), (8, 4))


def test_files_round_trip(spark, docs_of, encoder, monkeypatch):
    docs = docs_of(EDGE_TEXTS)
    want, start = [], 0
    for d, ids in sorted(((d, ids_of(encoder, t)) for d, t in EDGE_TEXTS), key=lambda x: (x[0] is not None, x[0] or 0)):
        want.append((d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    rows = sorted(A.round_trip(docs).collect(), key=lambda r: r["start"])
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in rows) == sorted((d is not None, d or 0, n, c) for d, n, c in want)
    for r in rows:
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == [d for d, *_ in want]
    assert A.round_trip(docs.limit(0)).count() == 0


class Counted:
    """A file in memory that adds up the bytes read from it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.read += n
        return self.data[at : at + n]


def test_one_id_reads_a_step_of_each_level():
    r = np.random.default_rng(2)
    out = io.BytesIO()
    out.close = lambda: None
    writer = A.FileWriter(out)
    every = r.integers(0, 49408, 60000).astype("<u4")
    for k in range(600):
        writer.add(k, every[100 * k : 100 * k + 100].tobytes())
    assert writer.close() == (600, 60000)
    source = Counted(out.getvalue())
    found = A.TokenFile(source)
    opened = source.read
    for i in (0, 1, 511, 512, 31234, 59999):
        assert found.get(i) == every[i]
    # The head of the segment, then at most two chunk bytes, a rank and one directory step for each level.
    assert source.read - opened < 6 * (500 + 3 * (2 + 1 + 4 + A.RANK_STEP // 8)) < len(source.data) / 20
    with pytest.raises(IndexError):
        found.get(60000)


def test_random_access_into_a_file(spark, docs_of, encoder, monkeypatch):
    monkeypatch.setattr(A, "SEGMENT_IDS", 300)
    folder = scratch_path(spark, "test")
    docs = docs_of([(k, f"words of text {k} " * (k + 1)) for k in range(30)])
    files = A.write_tokens(docs, folder).orderBy("part").collect()
    every = [i for k in range(30) for i in ids_of(encoder, f"words of text {k} " * (k + 1))]
    assert sum(f["ids"] for f in files) == len(every)
    for f in files:
        from cohortloom.llm.files import open_file

        with open_file(folder, f["file"]) as source:
            found = A.TokenFile(source)
            assert [found.get(i) for i in range(0, f["ids"], 17)] == every[f["start"] : f["start"] + f["ids"] : 17]
            with pytest.raises(IndexError):
                found.get(f["ids"])


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_document_once(seed):
    r = np.random.default_rng(seed)
    lengths = np.clip(r.lognormal(4, 1.2, 3000).astype(int), 1, 512)
    if seed == 3:
        lengths[:1500] = 200  # one hot length
    histogram = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    groups = P.plan(histogram, 512)
    held = {}
    for g in groups:
        assert g.used == sum(length for length, _, _ in g.slots) <= 512
        for length, rank, offset in g.slots:
            held.setdefault(length, []).extend(range(rank, rank + g.n))
    assert {n: sorted(x) for n, x in held.items()} == {n: list(range(c)) for n, c in histogram.items()}
    best = sum(g.n for g in P.best_fit(dict(histogram), {}, [], 512))
    assert sum(g.n for g in groups) <= best + 1
    fitted = P.fit_repeats(P.enumerate_patterns(histogram, 512), histogram, 512)
    assert (fitted >= 0).all() and sum(g.n for g in groups if g.used == 512) > len(groups) / 10


def test_packing_documents(docs_of, encoder):
    docs = docs_of(EDGE_TEXTS)
    rows = P.pack(docs, capacity=64).collect()
    pieces = {}
    for d, t in EDGE_TEXTS:
        ids = ids_of(encoder, t)
        for k, a in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[a : a + 64], "<u4").tobytes()
            key = (d, k, a, len(part) // 4, zlib.crc32(part))
            pieces[key] = pieces.get(key, 0) + 1
    found = {}
    for r in rows:
        found[tuple(r)[:5]] = found.get(tuple(r)[:5], 0) + 1
    assert found == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert P.pack(docs.limit(0)).count() == 0
