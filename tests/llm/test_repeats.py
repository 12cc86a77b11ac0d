"""Repeated passages against a table of all strings."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortloom.llm import queries
from cohortloom.llm import repeats as R
from tests.llm.conftest import EDGE_TEXTS


def brute(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (key, _), d in zip(rows, data):
        gone = np.zeros(len(d) + 1, bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((key, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(n))

    base = [words(rng.randint(5, 160)) for _ in range(14)]
    passage, line = words(30), "=" * 70
    rows = list(enumerate(base))
    rows += [(100 + k, base[k % 3]) for k in range(12)]  # a third is copies
    rows += [(200 + k, base[5][: 50 + 17 * k] + "#" + base[5][60 + 17 * k :]) for k in range(8)]
    rows += [(300 + k, words(6) + " " + passage + " " + words(5 + k)) for k in range(9)]
    rows += [(400 + k, words(4) + "\n" + line + "\n" + words(4)) for k in range(6)]
    return rows + [(500, passage + passage), (501, "x" * 700), (502, "ab" * 300), *EDGE_TEXTS[:8], EDGE_TEXTS[11]]


@pytest.mark.parametrize(("length", "gram", "crowd"), [(40, 12, 512), (40, 12, 1), (64, 64, 3), (90, 30, 4)])
def test_removed_bytes_against_brute_force(spark, docs_of, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(R, "SEGMENT", 1 << 10)
    monkeypatch.setattr(R, "ARRAY_BYTES", 1 << 11)
    rows = corpus(length + crowd)
    got = R.Repeats(docs_of(rows), length=length, gram=gram, crowd=crowd).removed().collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, length)


def test_edge_texts_at_full_length(spark, docs_of):
    rows = [*EDGE_TEXTS, (20, "tail " * 10), (4, "another text of the key"), (21, "é" * 199 + "xy"), (22, "é" * 199 + "xy"), (23, "q" + "é" * 200)]
    assert sorted(map(tuple, R.Repeats(docs_of(rows)).removed().collect()), key=str) == brute(rows, 400)
    assert R.Repeats(docs_of(rows).limit(0)).removed().collect() == []


def maximal(pieces, weights, length):
    """Strings that occur twice, at most places longer to the right, with all their places; left ends differ or begin a piece."""
    places = defaultdict(list)
    for p, data in enumerate(pieces):
        for s in range(len(data)):
            for size in range(length, len(data) - s + 1):
                places[data[s : s + size]].append((p, s))
    out = {}
    for string, found in places.items():
        total = sum(weights[p] for p, _ in found)
        after = {pieces[p][s + len(string) : s + len(string) + 1] or (p, s) for p, s in found}
        before = {pieces[p][s - 1] if s else (p, s) for p, s in found}
        ends = len(after) > 1 or any(not pieces[p][s + len(string) :] for p, s in found)
        if total > 1 and ends and (len(before) > 1 or any(not s for _, s in found)):
            out[string] = (total, set(found))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_groups_have_all_occurrences(seed):
    rng = random.Random(seed)
    pieces = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(8, 16))) for _ in range(9)} | {b"abababababab", b"aaaaaaaaaaaa"})
    weights = [rng.choice([1, 1, 1, 3]) for _ in pieces]
    rows = R.maximal_repeats(pieces, weights, 6)
    own, parent, size, total = defaultdict(set), {}, {}, {}
    for p, s, length, group, up, n in rows:
        own[group].add((p, s))
        parent[group], size[group], total[group] = up, length, n
    everything = {g: set(v) for g, v in own.items()}
    for g in sorted(own, key=lambda g: -size[g]):
        if parent[g] >= 0:
            everything[parent[g]] |= everything[g]
    want = maximal(pieces, weights, 6)
    text = lambda p, s, n: pieces[p][s : s + n]
    assert {text(*next(iter(f)), size[g]): (total[g], f) for g, f in everything.items()} == want and len(everything) == len(want)
    covered = lambda spans: {(p, k) for p, s, n in spans for k in range(s, s + n)}
    assert covered([r[:3] for r in rows]) == covered([(p, s, len(t)) for t, (_, f) in want.items() for p, s in f])


def test_occurrences_name_places(spark, docs_of):
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, "one " + text + " end"), (2, "two " + text + " fin"), (3, "nothing here")]
    found = R.Repeats(docs_of(rows), length=100, gram=30).occurrences().collect()
    byte = {1: rows[0][1], 2: rows[1][1]}
    assert {r["doc_id"] for r in found} == {1, 2} and all(r["occurrences"] == 2 for r in found)
    by_group = defaultdict(set)
    for r in found:
        by_group[r["group"]].add(byte[r["doc_id"]][r["start"] : r["start"] + r["size"]])
    assert all(len(v) == 1 and len(next(iter(v))) >= 100 for v in by_group.values())


def brute_words(rows, length):
    data = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[p : p + length]) for w in data for p in range(len(w) - length + 1))
    out = []
    for (key, _), w in zip(rows, data):
        shared = {p + k for p in range(len(w) - length + 1) if seen[tuple(w[p : p + length])] > 1 for k in range(length)}
        out.append((key, len(shared)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "gram", "crowd"), [(17, 4, 512), (17, 4, 1), (20, 20, 3), (51, 8, 512)])
def test_passage_words_against_brute_force(spark, docs_of, monkeypatch, length, gram, crowd):
    monkeypatch.setattr(R, "SEGMENT", 1 << 9)
    monkeypatch.setattr(R, "ARRAY_BYTES", 1 << 11)
    rows = corpus(length + crowd)
    long_ = " ".join(f"{k * k % 97}" for k in range(140))
    rows += [(600, long_), (601, "before " + long_.replace(" ", "\n\t ")), (602, long_[:150] + "é" + long_[150:]), (603, long_ + " " + long_)]
    docs = docs_of(rows)
    got = R.Repeats(docs, length=40, gram=12).removed(R.Repeats(docs, length=length, gram=gram, crowd=crowd, words=True)).collect()
    assert sorted(((r["doc_id"], r["n_passage_words"]) for r in got), key=str) == brute_words(rows, length)
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(rows, 40)


def test_passages_of_over_50_words_below_400_bytes(spark, tmp_path, docs_of):
    passage = [f"w{k}" for k in range(51)]
    rows = [(1, "first " + " ".join(passage) + " tail"), (2, "\n".join(passage)), (3, "third " + " ".join(passage[1:])), (4, None), (5, "other " * 9)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op13_interval_tree(spark, str(tmp_path)).collect()}
    assert [got[k]["n_passage_words"] for k in range(1, 6)] == [51, 51, 0, 0, 0]
    assert all(r["n_removed"] == 0 for r in got.values())
