"""Near copies against all pairs of exact five-word-shingle similarities."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from cohortloom.llm import shingles as S


def grams(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def heads(rows, threshold=0.8):
    """Smallest id of each component of single links."""
    top = {d: d for d, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (d, t), (e, u) in itertools.combinations(rows, 2):
        if jaccard(t, u) >= threshold:
            a, b = sorted((find(d), find(e)))
            top[b] = a
    return {find(d) for d, _ in rows}


def edited(r, words, n):
    words = list(words)
    for k in r.sample(range(len(words)), n):
        words[k] = f"new{r.randint(0, 10**6)}"
    return words


def test_texts_of_the_same_words_in_another_order_stay(spark, docs_of):
    words = [f"w{k}" for k in range(120)]
    mixed = random.Random(1).sample(words, 120)
    docs = docs_of([(1, " ".join(words)), (2, " ".join(mixed))])
    assert sorted(r["doc_id"] for r in P.near_copies(spark, docs, "").collect()) == [1, 2]


def test_kept_rows_match_all_pairs(spark, docs_of):
    r = random.Random(2)
    rows, d = [], 0
    for _ in range(12):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.randint(60, 250))]
        for _ in range(r.randint(1, 12)):
            d += 1
            rows.append((d, " ".join(edited(r, base, r.randint(0, max(1, len(base) // 18))))))
    hot = [f"h{k}" for k in range(150)]
    for _ in range(90):
        d += 1
        rows.append((d, " ".join(edited(r, hot, r.randint(0, 6)))))
    chain = [f"c{k}" for k in range(100)]
    for k in range(15):
        d += 1
        rows.append((d, " ".join(chain[k * 4 :] + [f"x{j}" for j in range(k * 4)])))
    rows += [(900, None), (901, " "), (902, "A b"), (903, "a  B"), (904, "a b c")]
    r.shuffle(rows)
    got = P.near_copies(spark, docs_of(rows), "")
    assert {x["doc_id"] for x in got.collect()} == heads(rows)
    assert got.dtypes == docs_of(rows).dtypes and P.near_copies(spark, docs_of(rows).limit(0), "").count() == 0


def test_large_buckets_are_not_paired(spark, docs_of, monkeypatch):
    # A cloud around one text whose members are mostly unlike each other, and true copies inside it.
    r = random.Random(4)
    base = [f"b{k}" for k in range(160)]
    rows = [(d, " ".join(edited(r, base, 9))) for d in range(120)]
    rows += [(200 + k, rows[5 * k][1] + " one more") for k in range(20)]
    seen = []
    measured = S.measured

    def counted(pairs, texts):
        seen.append(pairs.count())
        return measured(pairs, texts)

    monkeypatch.setattr(S, "measured", counted)
    got = {x["doc_id"] for x in P.near_copies(spark, docs_of(rows), "").collect()}
    want = heads(rows)
    assert len(got ^ want) <= 2 and not got & {200 + k for k in range(20)}
    assert sum(seen) < len(rows) * S.FINE_BANDS and len(seen) == 3 + S.ROUNDS


def test_covering_tables_alone_propose_links(spark, docs_of):
    import numpy as np

    from cohortloom.llm.covering import fingerprint
    from cohortloom.session import ship_package

    ship_package(spark)
    r = random.Random(5)
    base = [[f"w{r.randint(0, 5000)}" for _ in range(400)] for _ in range(6)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)] + [(10 + k, " ".join(b + ["more"])) for k, b in enumerate(base)]
    close = {k for k in range(6) if (fingerprint(rows[k][1]) ^ fingerprint(rows[6 + k][1])).bit_count() <= S.RADIUS}
    assert close
    docs = docs_of(rows).selectExpr("doc_id id", "text")
    signed = S.signatures(docs).selectExpr("id", "node", "size", f"slice(bands, {S.BANDS + 1}, 1000) bands")
    assert {len(x["bands"]) for x in signed.collect()} == {2 ** (S.RADIUS + 1) - 1}
    ids = {x["node"]: x["id"] for x in signed.collect()}
    found = {min(ids[x["a"]], ids[x["b"]]) for x in S.links(signed, docs).collect()}
    assert close <= found
    # Two prints within the radius share a table, whatever bits differ.
    for _ in range(200):
        p = r.getrandbits(64)
        q = p ^ sum(1 << k for k in r.sample(range(64), S.RADIUS))
        keys = S.table_buckets([x - 2**64 if x >> 63 else x for x in (p, q)])
        assert (keys[0] == keys[1]).any() and len(np.unique(keys[0])) == 31


def test_links_that_no_bucket_proposes_are_found(spark, docs_of):
    from cohortloom.session import ship_package

    ship_package(spark)
    r = random.Random(7)
    rows, d = [], 0
    for n in (8, 40, 150, 151, 600):
        base = [f"w{r.randint(0, 900)}" for _ in range(n)]
        for _ in range(25):
            d += 1
            rows.append((d, " ".join(edited(r, base, r.randint(0, max(1, n // 12))))))
    passage = " ".join(f"p{k}" for k in range(70))
    rows += [(500 + k, f"{passage} " + " ".join(f"v{r.randint(0, 10**6)}" for _ in range(r.choice([5, 12, 20, 90])))) for k in range(40)]
    rows += [(900, None), (901, ""), (902, "a b"), (903, "A B")]
    docs = docs_of(rows).selectExpr("doc_id id", "text")
    alone = S.signatures(docs).groupBy("node").agg(F.min("id").alias("id"), F.min("size").alias("size")).selectExpr("*", "array(node) bands")
    nodes = {x["node"]: x["id"] for x in alone.collect()}
    partnered = {i for i, t in rows if i in nodes.values() and any(grams(u) != grams(t) and jaccard(t, u) >= 0.8 for _, u in rows)}
    left = {x["id"] for x in S.unsettled(alone, docs, 0.8).collect()}
    assert partnered <= left and len(left) < len(nodes)
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x in S.links(alone, docs).collect():
        top[find(x["a"])] = find(x["b"])
    least = {}
    for n, i in nodes.items():
        least[find(n)] = min(least.get(find(n), i), i)
    assert set(least.values()) == heads(rows) and len(least) < len(nodes)
