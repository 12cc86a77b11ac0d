"""Fingerprints against a plain Python version of the method."""

import hashlib
import math
import re

import pytest
import xxhash

from cohortloom.llm import imatch as I

from .conftest import EDGE_TEXTS


def signed(x):
    return x - 2**64 if x >> 63 else x


def terms(text):
    found = {w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w}
    return {signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in found}


def kept(term, at):
    return not term & (((1 << at) - 1) << 4)


def level(found):
    return max(0, (int(math.log2(len(found))) if found else 0) - 4)


def hashes(found):
    """Sets of terms per subset; None for an empty one."""
    return [frozenset(t for t in found if t % 16 == k) or None for k in range(16)]


def share(a, b):
    used = sum(x is not None or y is not None for x, y in zip(a, b))
    return sum(x is not None and x == y for x, y in zip(a, b)) / used if used else 0.0


def near(a, b, lexicon):
    if a == b:
        return 1.0
    prints = []
    for text in (a, b):
        found = terms(text)
        at = level(found)
        some = {t for t in found if kept(t, at)} & lexicon
        prints.append((at, hashes(some), hashes({t for t in some if kept(t, at + 1)})))
    (p, a0, a1), (q, b0, b1) = prints
    if not any(a0) and not any(b0):
        return 0.0
    if p == q:
        return 1.0 if (a0, a1) == (b0, b1) and any(a0) else max(share(a1, b1), share(a0, b0))
    return share(a1, b0) if p + 1 == q else share(a0, b1) if q + 1 == p else 0.0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42))))
    order = [r for k, r in enumerate(order) if r not in order[:k]]
    frequency = {}
    for _, t in rows:
        for x in terms(t):
            frequency[x] = frequency.get(x, 0) + 1
    lexicon = {t for t, n in frequency.items() if n >= 2 and n <= 0.1 * len(rows) + 1e-6}
    out = {}
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        edited = t[: n - n // 4] + following[: n // 4]
        out[(d, t)] = (n, hashlib.sha256(edited.encode()).hexdigest(), near(t, edited, lexicon), near(t, following, lexicon))
    return out


def corpus():
    import random

    r = random.Random(6)
    words = ["".join(r.choice("abcdeéü") for _ in range(r.randint(2, 6))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(5, 300))) for _ in range(60)]
    return [(3 * k + 1, t) for k, t in enumerate(texts)] + [(500, texts[0]), (501, texts[0]), (502, texts[5][:-40])]


def test_results_match_plain_python(docs_of):
    rows = corpus() + [(d, t) for d, t in EDGE_TEXTS if "endoftext" not in (t or "")]
    want = brute(rows)
    got = I.edit_likeness(docs_of(rows)).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t or "")
    for r in got:
        choices = [want[(r["doc_id"], t)] for t in texts[r["doc_id"]]]
        assert any(
            (r["n_chars"], r["edited_sha256"]) == c[:2] and r["near_edited"] == pytest.approx(c[2]) and r["near_next"] == pytest.approx(c[3]) for c in choices
        ), (r, choices)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["fingerprint"] == by_id[500]["fingerprint"] == by_id[501]["fingerprint"] and by_id[500]["near_next"] == 1.0
    assert sum(r["near_edited"] for r in got) > 3 * sum(r["near_next"] for r in got if r["doc_id"] != 500)


def test_plain_fingerprints_agree(docs_of):
    docs = docs_of(corpus())
    a = {r["doc_id"]: r["fingerprint"] for r in I.imatch(docs).collect()}
    b = {r["doc_id"]: r["fingerprint"] for r in I.edit_likeness(docs).collect()}
    assert a == b


def test_empty_and_single_tables(docs_of):
    docs = docs_of([(1, "alone here")])
    assert I.edit_likeness(docs.limit(0)).count() == 0
    row = I.edit_likeness(docs).collect()[0]
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"alone hal").hexdigest() or row["n_chars"] == 10


def test_a_large_group_of_copies_keeps_its_terms(docs_of):
    hot = [f"h{k}x" for k in range(200)]
    others = [" ".join(hot[5 * k : 5 * k + 5] + [f"o{k}y{j}" for j in range(40)]) for k in range(40)]
    rows = [(k, " ".join(hot)) for k in range(20)] + [(100 + k, t) for k, t in enumerate(others)]
    got = {r["doc_id"]: r for r in I.edit_likeness(docs_of(rows)).collect()}
    assert not any(got[k]["fingerprint"].startswith("text:") for k in range(20))
    assert got[19]["near_edited"] > 0
