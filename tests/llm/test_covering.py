"""Fingerprints against a direct definition, links against brute force."""

import itertools
import random

import xxhash
from pyspark.sql import functions as F

from cohortloom.llm import covering as C

from .conftest import EDGE_TEXTS, rows_of


def brute_print(text, words=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(prints, radius):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(list(parent), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {p: top(p) for p in prints}


def test_fingerprints_match_the_definition(docs_of):
    r = random.Random(1)
    texts = EDGE_TEXTS + [(50 + k, " ".join(r.choice(["Ab", "çÉ", "d\x85", "x"]) for _ in range(r.randint(0, 12)))) for k in range(60)]
    docs = docs_of(texts)
    got = C.fingerprints(docs.select("doc_id", "text", "fp")).collect()
    want = sorted((d is not None, d or 0, brute_print(t)) for d, t in texts)
    assert sorted((d is not None, d or 0, f & (2**64 - 1)) for d, f in got) == want


def test_every_pair_within_the_radius_meets_in_a_table():
    r = random.Random(2)
    for radius in (2, 4, 6):
        masks = C.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) > 16
        for _ in range(2000):
            flips = sum(1 << b for b in r.sample(range(64), radius))
            assert any(not flips & m for m in masks)


def clusters(seed, n):
    """Crowded fingerprints: chains and clouds around a few centres, so that buckets grow past SMALL_BUCKET."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = r.choice(centres)
        for b in r.sample(range(r.choice([12, 64])), r.randint(0, 9)):
            x ^= 1 << b
        out.add(x - 2**64 if x >> 63 else x)
    return sorted(out)


def partition(roots):
    """Components of two nodes or more."""
    groups = {}
    for node, root in roots.items():
        groups.setdefault(root, {root}).add(node)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_links_match_brute_force(spark, monkeypatch):
    prints = clusters(3, 500)
    want = partition(brute_roots(prints, 4))
    weighted = spark.createDataFrame([(p, 1) for p in prints], "fp bigint, n bigint")
    for small in (64, 2):  # with 2, nearly all remaining buckets go through the shared points
        monkeypatch.setattr(C, "SMALL_BUCKET", small)
        assert partition(dict(rows_of(C.link(weighted, 4)))) == want


def test_contraction_of_long_chains(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 99), (7, 7)]
    found = dict(rows_of(C.contract(spark.createDataFrame(chain, "a bigint, b bigint"))))
    assert partition(found) == {frozenset(range(41)), frozenset({99, 100})}


def test_components_of_documents(docs_of):
    text = " ".join(f"w{k}" for k in range(300))
    docs = docs_of([(9, text), (3, text.upper()), (5, "other words here"), (7, None), (8, " "), (None, text), (3, text)])
    found = C.components(C.fingerprints(docs)).select("doc_id", "component_id")
    assert rows_of(found) == [(None, 3), (3, 3), (3, 3), (5, 5), (7, 7), (8, 7), (9, 3)]
    assert C.components(C.fingerprints(docs.limit(0))).count() == 0


def test_keep_one_leaves_one_row_of_each_component(docs_of):
    text = " ".join(f"w{k}" for k in range(300))
    docs = docs_of([(9, text), (3, text), (3, text), (5, "other"), (None, "x y z"), (None, text), (7, None), (8, "")])
    kept = C.keep_one(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept.select("doc_id", "text")) == rows_of(docs.where("doc_id in (5, 7) or text = 'x y z'").select("doc_id", "text").union(docs.where("doc_id = 3").limit(1).select("doc_id", "text")))
    assert C.keep_one(docs.where(F.lit(False))).count() == 0


def test_exploded_tables_are_not_sent_through_the_driver(spark, monkeypatch):
    # The optimiser sizes them like the few prints they come from, so by its threshold they would be broadcast.
    prints = spark.range(400).selectExpr("id * id as fp", "1L as n")
    plans, kept = [], C.materialise

    def seen(df, label):
        plans.extend([df._jdf.queryExecution().sparkPlan().toString()] if label == "buckets" else [])
        return kept(df, label)

    monkeypatch.setattr(C, "materialise", seen)
    C.link(prints, 4).count()
    plans.append(C._balls(prints.select("fp"), 4)._jdf.queryExecution().sparkPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line]
    assert len(plans) == 3 and all("SortMergeJoin" in plan for plan in plans)
    # Only the written table of roots may be small enough.
    assert all("SortMergeJoin" in line for line in joins if "LeftOuter" not in line), joins
