"""SimHash fingerprints linked by covering locality-sensitive hashing.

Masks: every bit of the fingerprint gets a non-zero vector of radius + 1 bits; a table for each non-zero
vector v keeps the fingerprint bits whose vector has an odd product with v. At most `radius` differing bits
span at most `radius` dimensions, so some v is orthogonal to them all: there the two fingerprints keep
equal bits, and 2^(radius + 1) - 1 tables lose no pair.

Linking works on distinct fingerprints and emits no pairs of a bucket:

1. every member of a bucket is compared with one pivot, the member with the most rows;
2. buckets whose members are then still in more than one component are looked at again: small ones
   (at most SMALL_BUCKET members) compare members of different components;
3. members of larger ones are linked through the fingerprints at half the radius around them, which two
   fingerprints share exactly when they are within the radius, so the work stays in proportion to members.

Every step is exact, so the choice between them changes the work and not the links. Components are found
by contraction to a hashed first neighbour, one shuffle of the remaining edges per round.

Tables made by an explode are joined by merging: the optimiser sizes them like the rows before it, up to 2,081
times too low, and would send them through the driver.

Defined cases: NULL, empty and blank texts have fingerprint zero and are linked like any other. Repeated
rows stay and share a component. A component's id is its smallest non-NULL doc_id (NULL if it has none).
Extra columns are ignored by the fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.ranks import fresh
from cohortloom.session import materialise

BITS = 64
SMALL_BUCKET = 64


def fingerprint(text: str | None, words: int = 4, distinct: bool = False) -> int:
    """Bit k is set if bit k of XXH64 (seed 42) is set in over half the word shingles."""
    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    if words == 1:
        shingles = found
    else:
        line = b" ".join(found)
        ends = list(itertools.accumulate([len(w) + 1 for w in found]))
        if len(found) <= words:
            shingles = [line]
        else:
            shingles = [line[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :])]
    if distinct:
        shingles = set(shingles)
    hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, max(1, len(hashes) // 65536)):
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distinct: bool = False) -> DataFrame:
    """(key, fp long) of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(t.as_py(), words, distinct) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """Masks (unsigned) of the 2^(radius + 1) - 1 tables."""
    count = (1 << (radius + 1)) - 1
    order = np.random.default_rng(5).permutation(max(bits, count))
    vectors = [int(1 + order[i] % count) for i in range(bits)]
    masks = []
    for v in range(1, 1 << (radius + 1)):
        masks.append(sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2))
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _near(a: str, b: str, radius: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= radius


def contract(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): one node stands for each component of the edges (a, b); roots themselves are not listed.

    Each round a node takes the name of the neighbour, or itself, that is first in an order hashed anew, so
    the number of names falls by a share every round, also along chains; one shuffle of what is left.
    """
    edges = materialise(edges.where("a <> b").select("a", "b").distinct(), label)
    maps = []
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = [F.xxhash64(F.lit(len(maps)), c) for c in ("a", "b")]
        best = both.groupBy("a").agg(F.min(F.struct(rank[1].alias("h"), F.col("b").alias("to"))).alias("m"))
        moved = best.where(F.col("m.h") < rank[0]).select(F.col("a").alias("node"), F.col("m.to").alias("parent"))
        moved = materialise(moved, label)
        maps.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        right = moved.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = edges.join(left, "a", "left").join(right, "b", "left")
        edges = edges.select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b")).where("a <> b")
        edges = materialise(edges.distinct(), label)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    done = maps[-1].select("node", F.col("parent").alias("root"))
    for moved in reversed(maps[:-1]):
        later = done.select(F.col("node").alias("parent"), "root")
        earlier = moved.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
        kept = done.join(moved.select("node"), "node", "left_anti")
        done = materialise(earlier.unionByName(kept), label)
    return done


def _balls(fps: DataFrame, radius: int) -> DataFrame:
    """Edges between fingerprints that share a point within half the radius of both."""
    # No flip, or one of the bits; later flips never go back, so a set of bits is made once.
    bits = F.lit([0, *[_signed(1 << k) for k in range(BITS)]])
    points = fps.select("fp", F.col("fp").alias("point"), F.lit(1).alias("at"))
    for _ in range(radius // 2):
        points = points.select("fp", "point", "at", F.posexplode(F.slice(bits, F.col("at"), F.lit(BITS + 1))).alias("more", "bit"))
        points = points.select("fp", F.col("point").bitwiseXOR(F.col("bit")).alias("point"), (F.col("at") + F.col("more")).alias("at"))
    points = points.select("fp", "point")
    shared = points.groupBy("point").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).where("first < last")
    return points.join(shared.hint("merge"), "point").select(F.col("fp").alias("a"), F.col("first").alias("b")).where("a <> b").distinct()


def link(weighted: DataFrame, radius: int = 4) -> DataFrame:
    """(node, root) over distinct fingerprints (fp, n rows) within `radius` (even) differing bits, transitively."""
    if radius % 2:
        raise ValueError("the radius must be even: half of it is the radius of the shared points")
    masks = [_signed(m) for m in covering_masks(radius)]
    keys = F.transform(
        F.lit(masks), lambda m, k: F.struct(k.alias("t"), F.col("fp").bitwiseAND(m).alias("bucket"))
    )
    # Each fingerprint becomes a row per table, so the few partitions of the small input are spread first.
    parts = int(weighted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = weighted.repartition(parts, "fp").select("fp", "n", F.explode(keys).alias("k")).select("fp", "n", "k.t", "k.bucket")
    at = ["t", "bucket"]
    buckets = members.groupBy(*at).agg(
        F.count(F.lit(1)).alias("size"), F.max_by("fp", F.struct("n", "fp")).alias("pivot")
    ).where("size > 1")
    shared = materialise(members.join(buckets.hint("merge"), at).select(*at, "fp", "size", "pivot"), "buckets")
    stars = shared.where((F.col("fp") != F.col("pivot")) & _near("fp", "pivot", radius))
    first = contract(stars.select(F.col("fp").alias("a"), F.col("pivot").alias("b")))
    roots = first.withColumnRenamed("node", "fp")
    labelled = shared.join(roots, "fp", "left").select(*at, "fp", "size", F.coalesce("root", "fp").alias("root"))
    split = labelled.groupBy(*at).agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select(*at)
    rest = materialise(labelled.join(split.hint("merge"), at), "buckets")
    small = rest.where(F.col("size") <= SMALL_BUCKET)
    other = small.select(*at, F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    pairs = small.join(other.hint("merge"), at).where((F.col("root") < F.col("root2")) & _near("fp", "fp2", radius))
    wide = rest.where(F.col("size") > SMALL_BUCKET).select("fp").distinct()
    more = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).unionByName(_balls(wide, radius))
    chained = first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b"))
    return contract(chained)


def components(prints: DataFrame, key: str = "doc_id", radius: int = 4) -> DataFrame:
    """The rows (key, fp) with `component_id`, the smallest key reachable over links of at most `radius` bits."""
    prints = materialise(prints.select(key, "fp"), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")), "distinct")
    roots = link(distinct.select("fp", "n"), radius).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(named, "root").select("fp", "component_id")
    return prints.join(by_print.hint("merge"), "fp").select(key, "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, distinct: bool = False, radius: int = 4) -> DataFrame:
    """The rows of `docs` less near copies: of each component the row with the smallest key stays, once.

    Of several rows with that key the one whose text has the smallest hash stays; rows without a key count
    as the largest.
    """
    (part, mark, same) = fresh(docs, "_component", "_mark", "_same")
    prints = fingerprints(docs.select(F.struct(F.coalesce(F.col(key), F.lit(2**63 - 1)).alias("k"), F.xxhash64(text).alias("h")).alias("id"), text), "id", text, words, distinct)
    whole = components(prints, "id", radius)
    heads = whole.where("id = component_id").select(F.col("id").alias(mark)).distinct()
    marked = docs.withColumn(same, F.struct(F.coalesce(F.col(key), F.lit(2**63 - 1)).alias("k"), F.xxhash64(text).alias("h")))
    kept = marked.join(heads, F.col(same) == F.col(mark), "left_semi")
    return kept.dropDuplicates([same]).drop(same)
