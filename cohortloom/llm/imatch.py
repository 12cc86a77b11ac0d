"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions only.

Terms are the distinct lower-case runs of letters and digits of a text, known by their 64-bit hash. The
lexicon keeps terms whose inverse document frequency, log(texts / texts with the term) over distinct texts,
lies in a band. It is divided by hash into SUBSETS random subsets, and each of those is thinned by powers of two;
a text reads two neighbouring thinnings, chosen by its number of distinct terms so that a subset holds
about one or two of its terms. Each subset's terms are sorted and hashed. The fingerprint is

    level:h0.h1...h15|h0.h1...h15

with an empty hash where the subset has none of the text's terms. The likeness of two fingerprints is the
share of equal hashes at the finest level they have in common, among the subsets that are not empty in
both; equal fingerprints have likeness 1, fingerprints without a common level 0.

Only the few terms that a subset keeps are shuffled to meet their frequencies, never whole texts.

Defined cases: a NULL text is the empty text. A text without a term inside the band gets `text:` and the
hash of the whole text: equal texts have equal fingerprints, likeness to others is 0. Repeated rows get
equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

SUBSETS = 16
_PLACE_BITS = 4


@dataclass(frozen=True)
class Band:
    """Kept terms: at least `rare` distinct texts hold them, and at most the share `common` of all."""

    rare: int = 2
    common: float = 0.1

    def idf(self, documents: int) -> tuple[float, float]:
        return math.log(1 / self.common), math.log(max(1, documents) / self.rare)


def terms(text: Column) -> Column:
    """Distinct term hashes of a text (array of long)."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def level(distinct_terms: Column) -> Column:
    """Coarser of the two thinnings that a text of so many terms reads."""
    return F.greatest(F.floor(F.log2(F.greatest(distinct_terms, F.lit(1)))).cast("int") - _PLACE_BITS, F.lit(0))


def _kept(term: Column, at: Column) -> Column:
    """Whether the thinning `at` keeps a term: its `at` bits above the subset's are zero."""
    low = F.call_function("shiftleft", F.lit(1).cast("long"), at + _PLACE_BITS) - F.lit(1 << _PLACE_BITS)
    return term.bitwiseAND(low) == 0


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df) over distinct texts, so copies of a text do not make its terms common."""
    once = docs.select(F.coalesce(F.col(text), F.lit("")).alias(text)).distinct()
    return once.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def distinct_texts(docs: DataFrame, text: str = "text") -> int:
    """Number of distinct texts, by their 64-bit hash."""
    return docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit("")))).distinct().count()


def lexicon(frequencies: DataFrame, documents: int, band: Band) -> DataFrame:
    """Terms inside the band."""
    low, high = band.idf(documents)
    idf = F.log(F.lit(float(documents)) / F.col("df"))
    return frequencies.where(idf.between(low - 1e-9, high + 1e-9)).select("term")


def candidate_terms(text: Column) -> Column:
    """struct(at, terms): the level of a text and those of its terms that the level keeps."""
    return F.transform(
        F.array(terms(text)),
        lambda t: F.transform(
            F.array(level(F.size(t))), lambda at: F.struct(at.alias("at"), F.filter(t, lambda x: _kept(x, at)).alias("terms"))
        )[0],
    )[0]


def _hashes(found: Column) -> Column:
    """Hash per subset of a sorted array of terms; NULL for an empty subset."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(SUBSETS - 1)),
        lambda k: F.transform(
            F.array(F.filter(found, lambda x: F.pmod(x, F.lit(SUBSETS)) == k)),
            lambda own: F.when(F.size(own) > 0, F.substring(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), 1, 8)),
        )[0],
    )


def prints(at: Column, found: Column) -> Column:
    """struct(at, coarse, fine) of the in-band terms that the level `at` keeps."""
    return F.struct(
        at.alias("at"),
        _hashes(F.sort_array(found)).alias("coarse"),
        _hashes(F.sort_array(F.filter(found, lambda x: _kept(x, at + 1)))).alias("fine"),
    )


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(h, F.lit(""))), ".")


def fingerprint(p: Column, whole: Column) -> Column:
    """Text form of a print; `whole` is the hash of the text, for texts without a term in the lexicon."""
    empty = F.size(F.filter(p["coarse"], lambda h: h.isNotNull())) == 0
    return F.when(empty, F.concat(F.lit("text:"), whole)).otherwise(
        F.concat(p["at"].cast("string"), F.lit(":"), _joined(p["coarse"]), F.lit("|"), _joined(p["fine"]))
    )


def _share(a: Column, b: Column) -> Column:
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    used = F.size(F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull()))
    equal = F.size(F.filter(both, lambda x: x["a"] == x["b"]))
    return F.when(used > 0, equal / used).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column, fa: Column, fb: Column) -> Column:
    """Likeness (0 to 1) of prints `a` and `b` with text forms `fa` and `fb`."""
    shared = (
        F.when(a["at"] == b["at"], F.greatest(_share(a["fine"], b["fine"]), _share(a["coarse"], b["coarse"])))
        .when(a["at"] + 1 == b["at"], _share(a["fine"], b["coarse"]))
        .when(b["at"] + 1 == a["at"], _share(a["coarse"], b["fine"]))
        .otherwise(F.lit(0.0))
    )
    return F.when(fa == fb, F.lit(1.0)).otherwise(F.coalesce(shared, F.lit(0.0)))


def in_lexicon(rows: DataFrame, key: str, lists: dict[str, str], lexicon_terms: DataFrame) -> DataFrame:
    """Per key the terms of each array column that are in the lexicon; keys without any are absent.

    `lists` names the result of each array column. A term that several columns hold is sent once.
    """
    names = list(lists)
    flags = [F.when(F.array_contains(n, F.col("term")), F.lit(1 << k)).otherwise(F.lit(0)) for k, n in enumerate(names)]
    where = flags[0]
    for flag in flags[1:]:
        where = where + flag
    every = F.array_distinct(F.flatten(F.array(*names)))
    sent = rows.select(key, *names, F.explode(every).alias("term")).select(key, "term", where.cast("byte").alias("held"))
    met = sent.join(lexicon_terms, "term")
    return met.groupBy(key).agg(
        *[
            F.collect_set(F.when(F.col("held").bitwiseAND(F.lit(1 << k).cast("byte")) != 0, F.col("term"))).alias(lists[n])
            for k, n in enumerate(names)
        ]
    )


def text_hash(text: Column) -> Column:
    """64-bit hash of a whole text as hex."""
    return F.lower(F.hex(F.xxhash64(F.coalesce(text, F.lit("")))))


def imatch(docs: DataFrame, key: str = "doc_id", text: str = "text", band: Band = Band()) -> DataFrame:
    """(key, print, fingerprint) of every row; `key` must be unique and not NULL."""
    known = lexicon(document_frequencies(docs, text), distinct_texts(docs, text), band)
    rows = docs.select(
        key, candidate_terms(F.col(text)).alias("c"), text_hash(F.col(text)).alias("whole")
    ).select(key, "c.at", F.col("c.terms").alias("kept"), "whole")
    rows = materialise(rows, "imatch")
    found = in_lexicon(rows, key, {"kept": "found"}, known)
    out = rows.join(found, key, "left").withColumn(
        "print", prints(F.col("at"), F.coalesce("found", F.array().cast("array<bigint>")))
    )
    return out.select(key, "print", fingerprint(F.col("print"), F.col("whole")).alias("fingerprint"))


IDENT = ("k0", "k1", "h")


def _ident(key: str, text: str) -> list[Column]:
    """Columns that identify a distinct document: its integer key, whether that is NULL, hash of its text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.coalesce(F.col(key), F.lit(0)).alias("k0"), F.col(key).isNull().alias("k1"), F.xxhash64(whole).alias("h")]


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct documents in ascending order of `key` (NULL first, then hash of the text): ident, n, place, next_place.

    Places are unique; the next place of the last document is the first one's. Sorting is by range
    partitions of keys, and one row per partition links it to the following one.
    """
    n = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = docs.select(*_ident(key, text), n.alias("n")).groupBy(*IDENT).agg(F.min("n").alias("n"))
    order = [F.col("k1").desc(), F.col("k0"), F.col("h")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("place", F.monotonically_increasing_id()), "order")
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    following = F.coalesce(F.lead("first").over(Window.orderBy("part")), F.min("first").over(Window.partitionBy()))
    crossing = parts.select(F.col("last").alias("place"), following.alias("across"))
    linked = placed.join(crossing, "place", "left")
    return linked.select(*IDENT, "n", "place", F.coalesce("across", F.col("place") + 1).alias("next_place"))


def edited_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(place, next_place, key, text, edited): each row with its text after an edit.

    The edit replaces the last quarter of the code points (rounded down) by the first as many, or all, of
    the next document. Texts are shuffled once by their identity; only the given quarter moves again.
    """
    order = materialise(with_next(docs, key, text), "next")
    to = [f"to_{c}" for c in IDENT]
    takers = order.select(
        F.col("next_place").alias("place"), F.floor(F.col("n") / 4).cast("int").alias("give"),
        *[F.col(c).alias(t) for c, t in zip(IDENT, to)],
    )
    info = order.join(takers, "place").select(*IDENT, "place", "next_place", "give", *to)
    own = docs.select(*_ident(key, text), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = own.join(info, list(IDENT))
    given = placed.select(*[F.col(t).alias(c) for c, t in zip(IDENT, to)], F.substring("text", F.lit(1), F.col("give")).alias("given"))
    given = given.dropDuplicates(list(IDENT))
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 4)).cast("int")), F.col("given"))
    return placed.join(given, list(IDENT)).select(
        "place", "next_place", F.when(F.col("k1"), None).otherwise(F.col("k0")).alias(key), "text", edited.alias("edited")
    )


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", band: Band = Band()) -> DataFrame:
    """Fingerprint of every row's text and edited text, and their likeness to each other and to the next row's."""
    known = lexicon(document_frequencies(docs, text), distinct_texts(docs, text), band)
    texts = edited_texts(docs, key, text)
    cands = texts.select(
        key, "place", "next_place", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        candidate_terms(F.col("text")).alias("a"), candidate_terms(F.col("edited")).alias("b"),
        text_hash(F.col("text")).alias("whole_a"), text_hash(F.col("edited")).alias("whole_b"),
    )
    rows = materialise(
        cands.select(
            key, "place", "next_place", "n_chars", "edited_sha256", "whole_a", "whole_b",
            F.col("a.at").alias("at_a"), F.col("b.at").alias("at_b"), F.col("a.terms").alias("a"), F.col("b.terms").alias("b"),
        ),
        "imatch",
    )
    found = in_lexicon(rows, "place", {"a": "found_a", "b": "found_b"}, known)
    none = F.array().cast("array<bigint>")
    printed = rows.drop("a", "b").join(found, "place", "left")
    for side in "ab":
        printed = printed.withColumn(f"print_{side}", prints(F.col(f"at_{side}"), F.coalesce(f"found_{side}", none)))
        printed = printed.withColumn(f"fp_{side}", fingerprint(F.col(f"print_{side}"), F.col(f"whole_{side}")))
    printed = materialise(printed.drop("found_a", "found_b"), "prints")
    following = printed.select(F.col("place").alias("next_place"), F.col("print_a").alias("print_n"), F.col("fp_a").alias("fp_n"))
    both = printed.join(following.dropDuplicates(["next_place"]), "next_place")
    return both.select(
        key, "n_chars", "edited_sha256", F.col("fp_a").alias("fingerprint"), F.col("fp_b").alias("edited_fingerprint"),
        likeness(F.col("print_a"), F.col("print_b"), F.col("fp_a"), F.col("fp_b")).alias("near_edited"),
        likeness(F.col("print_a"), F.col("print_n"), F.col("fp_a"), F.col("fp_n")).alias("near_next"),
    )
