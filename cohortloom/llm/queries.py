"""Registered queries of the training-data operators, with SQL where DuckDB can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import addressable, covering, crf, dealing, imatch, ledger, licences, mixture, packing, repeats, vafile, warc, whitening
from cohortloom.session import materialise, ship_package

SHARDS = 24


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_imatch(spark: SparkSession, folder: str) -> DataFrame:
    """I-Match fingerprints of every document and its edited text."""
    return imatch.edit_likeness(_table(spark, folder, "documents"))


def op2_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document."""
    return licences.scan(_table(spark, folder, "documents"))


def op3_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements, failure bits and verdicts of every document."""
    rows = ledger.build_ledger(_table(spark, folder, "documents").select("doc_id", "text"))
    base, web = ledger.policy_named("base"), ledger.policy_named("web")
    failed = ~ledger.passes(ledger.mask_of(base))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        ledger.passes(ledger.mask_of(web)).alias("kept"), "failures",
    )


def op4_covering(spark: SparkSession, folder: str) -> DataFrame:
    """SimHash components of every document."""
    prints = covering.fingerprints(_table(spark, folder, "documents"))
    found = covering.components(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    docs = _table(spark, folder, "documents")
    return crf.find(docs, crf.fit(crf.labelled_table(spark)))


def op6_addressable(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document, written and read back."""
    return addressable.round_trip(_table(spark, folder, "documents"))


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Archive records of every page, written and read back."""
    return warc.round_trip(_table(spark, folder, "pages"))


def op8_dealing(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32")
    )
    dealt = dealing.deal(rows, SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of every document in the mixed order."""
    docs = _table(spark, folder, "documents").select("doc_id", "source", "text")
    copies = mixture.replicate(docs, mixture.source_rates(docs)).select("doc_id", "source", "copy")
    return mixture.global_order(materialise(copies, "copies")).select("doc_id", "source", "copy", "position")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document packed into sequences."""
    return packing.pack(_table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened leading components of every embedding."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op12_vafile(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters of every embedding."""
    return vafile.cluster(_table(spark, folder, "embeddings"))


def op13_interval_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without its bytes that repeat elsewhere, and how many of its words lie in passages of over 50 that do."""
    documents = _table(spark, folder, "documents")
    return repeats.Repeats(documents).removed(repeats.Repeats(documents, words=True))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules, near copies, personal data, mixture and packing of the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


_WORDS = r"[^\x20\x09-\x0D]+"
OP3_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS l FROM w),
pos AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM pos) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(regexp_extract_all(text, '!')) AS ex, len(regexp_extract_all(text, '\p{{Lu}}')) AS caps, len(list_distinct(w)) AS dist
  FROM w JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 2 * ex > n_words THEN 16 ELSE 0 END + CASE WHEN 2 * caps > word_chars THEN 32 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 128 ELSE 0 END
  + CASE WHEN 10 * dist < n_words THEN 256 ELSE 0 END AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) > 0 AS base_failed, (failures & 255) = 0 AS kept, failures FROM f"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_imatch, op2_licences, op3_ledger, op4_covering, op5_crf, op6_addressable, op7_warc, op8_dealing, op9_mixture, op10_packing,
        op11_whitening, op12_vafile, op13_interval_tree, pipeline,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that DuckDB can express."""
    import corpus_pipeline

    found = {"op2_licences": licences.oracle(), "op3_ledger": OP3_SQL, "op7_warc": warc.oracle(), "op9_mixture": mixture.oracle(), "op12_vafile": vafile.oracle()}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
