"""Near copies by the Jaccard similarity of five-word shingles, each link checked on the texts.

Fingerprints only propose. A text lies in a bucket of each covering table of its SimHash (`covering`, four-word
shingles), so two texts within RADIUS bits share at least one; many texts at similarity 0.8 are farther apart, so a
second fingerprint is there for recall: BANDS buckets of ROWS MinHash minima, where two texts at similarity j share a
bucket with probability 1 - (1 - j^ROWS)^BANDS (0.9996 at 0.8). A link is kept only if the exact similarity of the two
shingle sets reaches the threshold; components are contracted from kept links alone.

1. texts of equal shingle sets are one node;
2. every member of a bucket is compared with the bucket's pivot, its smallest node, and kept links contracted;
3. in buckets of at most SMALL members that are then still in more than one component, all pairs of different
   components are compared, less those that the sizes of the sets or the distances to the pivot rule out (the
   Jaccard distance is a metric, so both bounds are exact);
4. the members of larger such buckets get FINE_BANDS finer buckets of FINE_ROWS minima, in which two texts at 0.8 meet
   with probability 0.99 and one pair of 160 at 0.6 does per band; there every member outside the pivot's component is
   compared with a pivot, ROUNDS times with another pivot and contraction between;
5. whatever buckets and pivots missed is found exactly (`missed`): shingles are ordered by the number of nodes that have
   them, those within one component first. The first shingle that two texts at the threshold share must stand so early
   in both lists that enough is left after it, so only such places meet, and pairs of different components are compared.

Steps 1 to 4 only save comparisons in step 5; the components are those of all pairs at the threshold. Before them
`unsettled` leaves out nodes that cannot be in a link: more of their shingles stand in no other text than a partner may
lack, counted over the hashes divisible by SHARE.

Defined cases: words are split at ASCII white space, with ASCII letters in lower case. A text of fewer than
five words is one shingle; NULL, empty and blank texts have none and equal each other only. A very long text is
hashed in parts of its shingles, never cut. Repeated rows and ties on the key: see `keep_one`. An empty table gives
no rows. Other columns are kept whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.covering import contract, covering_masks, fingerprint
from cohortloom.llm.ranks import fresh
from cohortloom.session import materialise

WORDS = 5
#: Differing bits of the SimHash within which the covering tables lose no pair.
RADIUS = 4
BANDS = 20
ROWS = 5
#: Members of a bucket of which all pairs of different components may be compared.
SMALL = 16
FINE_BANDS = 40
FINE_ROWS = 10
ROUNDS = 3
#: One shingle in so many is looked at to tell which texts cannot have a near copy.
SHARE = 3
#: Hashes sent from a Python worker at a time.
_SENT = 1 << 18
#: Shingles hashed at a time, so a long text needs little memory.
_PART = 4096


def shingles(text: str | None, words: int = WORDS) -> set[bytes]:
    """Distinct runs of `words` words."""
    found = text.encode().lower().split() if text else []
    line = b" ".join(found)
    if len(found) <= words:
        return {line} if found else set()
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    return {line[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :])}


def similarity(a: set[bytes], b: set[bytes]) -> float:
    """Jaccard similarity; two empty sets are equal."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _constants(bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    factors, shifts, mix = (r.integers(0, 2**64, bands * rows, dtype=np.uint64) for _ in range(3))
    return factors | np.uint64(1), shifts, mix | np.uint64(1)


def _hashes(found: set[bytes]) -> np.ndarray:
    return np.sort(np.array([xxhash.xxh64_intdigest(s, 42) for s in found], dtype=np.uint64))


def _node(hashes: np.ndarray) -> int:
    """Hash of the set."""
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), 7))))


def signature(found: set[bytes], constants: tuple[np.ndarray, np.ndarray, np.ndarray], bands: int = BANDS) -> tuple[int, np.ndarray]:
    """Hash of the set, and its bucket in each band."""
    factors, shifts, mix = constants
    hashes = _hashes(found)
    least = np.full(len(factors), 2**64 - 1, dtype=np.uint64)
    for k in range(0, len(hashes), _PART):
        least = np.minimum(least, (hashes[k : k + _PART] * factors[:, None] + shifts[:, None]).min(axis=1))
    mixed = (least ^ (least >> np.uint64(31))) * mix
    mixed ^= mixed >> np.uint64(29)
    keys = (mixed * mix[::-1]).reshape(bands, -1).sum(axis=1, dtype=np.uint64)
    return _node(hashes), keys.view(np.int64)


def table_buckets(prints: list[int], radius: int = RADIUS) -> np.ndarray:
    """Bucket of each (signed) SimHash in each covering table, a row per print."""
    masks = np.array(covering_masks(radius), dtype=np.uint64)
    kept = np.array(prints, dtype=np.int64).view(np.uint64)[:, None] & masks
    # The masks differ, so the table's number is part of the hash.
    mixed = (kept ^ (kept >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def fine_buckets(texts: DataFrame) -> DataFrame:
    """(node, bucket) of the finer bands of rows (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants(FINE_BANDS, FINE_ROWS, 12)
        for batch in batches:
            keys = [signature(shingles(t.as_py()), constants, FINE_BANDS)[1] for t in batch.column(1)]
            nodes = batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), FINE_BANDS)))
            yield pa.RecordBatch.from_arrays([nodes, pa.array(np.concatenate(keys) if keys else [], pa.int64())], names=["node", "bucket"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, bucket bigint")


def signatures(rows: DataFrame) -> DataFrame:
    """(id, node, size, bands) of rows (id, text); `bands` has the MinHash buckets, then those of the covering tables.

    Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        constants = _constants()
        for batch in batches:
            nodes, sizes, bands, prints = [], [], [], []
            for t in batch.column(1):
                text = t.as_py()
                found = shingles(text)
                node, own = signature(found, constants)
                nodes.append(node)
                sizes.append(len(found))
                bands.append(own)
                prints.append(fingerprint(text))
            whole = np.hstack([np.array(bands, dtype=np.int64).reshape(-1, BANDS), table_buckets(prints)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * whole.shape[1]), pa.array(whole.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists], names=["id", "node", "size", "bands"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, node bigint, size int, bands array<bigint>")


def _hashed_shingles(rows: DataFrame, share: int, *columns: str) -> DataFrame:
    """(token, node, columns) for each distinct shingle hash divisible by `share` of rows (text, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "node", *columns]
        for batch in batches:
            first, sent, tokens, nodes, counts = 0, 0, [], [], []
            for k, t in enumerate(batch.column(0)):
                hashes = _hashes(shingles(t.as_py()))
                some = hashes[hashes % np.uint64(share) == 0]
                tokens.append(some.view(np.int64))
                nodes.append(_node(hashes))
                counts.append(len(some))
                sent += len(some)
                if sent >= _SENT or k + 1 == batch.num_rows:
                    place = pa.array(np.repeat(np.arange(first, k + 1), counts))
                    whole = [pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(nodes, np.int64), counts))]
                    yield pa.RecordBatch.from_arrays([*whole, *(c.take(place) for c in batch.columns[1:])], names=names)
                    first, sent, tokens, nodes, counts = k + 1, 0, [], [], []

    kinds = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.select("text", *columns).mapInArrow(run, f"token bigint, node bigint{kinds}")


def unsettled(nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The rows of `nodes` (node, size, ...) that may have a partner at the threshold; `docs` has (text)."""
    tokens = _hashed_shingles(docs, SHARE)
    alone = tokens.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("_alone"))
    some = nodes.join(alone, "node", "left").where(F.coalesce("_alone", F.lit(0)) <= (1 - threshold) * F.col("size") + 1e-9)
    return some.select(*nodes.columns)


def measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of node pairs (a, b) by the texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, set()
        for batch in batches:
            out = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:
                    last, one = b, shingles(tb.as_py())
                out.append(similarity(shingles(ta.as_py()), one))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a bigint, b bigint, similarity double")


def _sizes_allow(a: str, b: str, threshold: float) -> Column:
    return F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9


def links(nodes: DataFrame, docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b) links that connect what all pairs at the threshold connect.

    `nodes` has (node, size, bands, id), `docs` (id, text).
    """
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("node").alias("p"), F.col("size").alias("s"))).alias("m")
    ).where("n > 1").select("bucket", F.col("m.p").alias("pivot"), F.col("m.s").alias("pivot_size"))
    # The optimiser sizes exploded members like the nodes, so without the hint the buckets might go through the driver.
    shared = materialise(members.join(buckets.hint("merge"), "bucket"), "buckets")
    texts = materialise(docs.join(nodes.select("node", "id"), "id").dropDuplicates(["node"]).select("node", "text"), "texts")
    stars = shared.where((F.col("node") != F.col("pivot")) & _sizes_allow("size", "pivot_size", threshold))
    scored = materialise(measured(stars.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), texts), "stars")
    kept = scored.where(F.col("similarity") >= threshold)
    labelled = _rooted(shared, contract(kept))
    split = materialise(
        labelled.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).where("r0 <> r1").select("bucket", "n"), "split"
    )
    known = scored.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("similarity")).alias("far"))
    # Unmeasured members (sizes too different) have bounds of their own: the distance is at least 1 - smaller / larger.
    rest = labelled.join(split.where(F.col("n") <= SMALL).select("bucket"), "bucket").join(known, ["node", "pivot"], "left")
    far = F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("far"))
    kept = materialise(kept.select("a", "b").unionByName(_between(rest.withColumn("far", far), texts, threshold)), "links")
    crowded = labelled.join(split.where(F.col("n") > SMALL).select("bucket"), "bucket", "left_semi").select("node", "size").distinct()
    fine = fine_buckets(texts.join(crowded, "node", "left_semi")).join(crowded, "node")
    fine = materialise(fine, "fine")
    for salt in range(0 if fine.isEmpty() else ROUNDS):
        kept = materialise(kept.unionByName(_to_pivots(_rooted(fine, contract(kept)), texts, threshold, salt)), "links")
    return kept.unionByName(missed(_rooted(nodes.select("node", "size"), contract(kept)), texts, threshold))


def missed(nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between different components of nodes (node, size, root), all of them."""
    tokens = _hashed_shingles(texts.join(nodes, "node"), 1, "size", "root")
    across = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    entries = tokens.join(across.select("token", "n").hint("merge"), "token")
    # Shingles within one component come first and are only counted: no pair looked for shares one.
    ahead = F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("node"))
    at = ahead + F.row_number().over(Window.partitionBy("node").orderBy("n", "token")) - 1
    early = entries.withColumn("at", at).where(F.col("at") <= (1 - threshold) * F.col("size") + 1e-9)
    early = materialise(early.select("token", "node", "size", "root", "at"), "prefixes")
    other = early.select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "size", "root", "at")])
    # The shared shingles are this one, if it is the first, and at most what is left of the shorter rest.
    most = F.least(F.col("size") - F.col("at"), F.col("size2") - F.col("at2"))
    enough = most >= threshold / (1 + threshold) * (F.col("size") + F.col("size2")) - 1e-9
    pairs = early.join(other, "token").where((F.col("root") < F.col("root2")) & enough & _sizes_allow("size", "size2", threshold))
    pairs = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    return measured(pairs, texts).where(F.col("similarity") >= threshold).select("a", "b")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` with the root of each node."""
    roots = roots.withColumnRenamed("node", "m").withColumnRenamed("root", "r")
    return members.join(roots, members["node"] == roots["m"], "left").select(*members.columns, F.coalesce("r", "node").alias("root"))


def _between(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of members (bucket, node, size, root, far from one point) of small buckets between different components."""
    rest = materialise(members.select("bucket", "node", "size", "root", "far"), "rest")
    other = rest.select("bucket", F.col("node").alias("node2"), F.col("size").alias("size2"), F.col("root").alias("root2"), F.col("far").alias("far2"))
    near = F.coalesce(F.abs(F.col("far") - F.col("far2")) <= 1 - threshold + 1e-9, F.lit(True))
    # Root order names each pair of different components once.
    pairs = rest.join(other, "bucket").where((F.col("root") < F.col("root2")) & near & _sizes_allow("size", "size2", threshold))
    pairs = pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct()
    return measured(pairs, texts).where(F.col("similarity") >= threshold).select("a", "b")


def _to_pivots(members: DataFrame, texts: DataFrame, threshold: float, salt: int) -> DataFrame:
    """Links (a, b) of members (node, size, bucket, root) to a node of their bucket, where that is of another component."""
    first = F.min(F.struct(F.xxhash64("node", F.lit(salt)).alias("h"), "node", "size", "root"))
    buckets = members.groupBy("bucket").agg(first.alias("p"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    buckets = materialise(buckets.select("bucket", F.col("p.node").alias("b"), F.col("p.size").alias("b_size"), F.col("p.root").alias("b_root")), "pivots")
    pairs = members.join(buckets, "bucket").where((F.col("root") != F.col("b_root")) & _sizes_allow("size", "b_size", threshold))
    pairs = pairs.select(F.col("node").alias("a"), "b").distinct()
    return measured(pairs, texts).where(F.col("similarity") >= threshold).select("a", "b")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` less near copies: of each component the row with the smallest key stays, once.

    Of several rows with that key the one whose text has the smallest hash stays; rows without a key count
    as the largest.
    """
    (same,) = fresh(docs, "_same")
    identity = F.struct(F.coalesce(F.col(key), F.lit(2**63 - 1)).alias("k"), F.xxhash64(text).alias("h"))
    rows = docs.select(identity.alias("id"), F.col(text).alias("text"))
    signed = materialise(signatures(rows), "signatures")
    nodes = signed.groupBy("node").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialise(nodes, "nodes")
    roots = contract(links(materialise(unsettled(nodes, rows, threshold), "unsettled"), rows, threshold))
    rooted = nodes.select("node", "id").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("id").alias("head")).select("head")
    kept = docs.withColumn(same, identity).join(heads, F.col(same) == F.col("head"), "left_semi")
    return kept.dropDuplicates([same]).drop(same)
