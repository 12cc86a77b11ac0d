"""The pipeline stage by stage against plain Python, and the registered queries' shapes."""

import collections
import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from cohortloom.llm import crf, mixture
from cohortloom.llm import ledger as L

from .conftest import rows_of
from .test_shingles import heads

SMALL = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark, docs_of):
    base = [" ".join(f"w{k}x{j}" for j in range(80 + k)) for k in range(12)]
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(base)]
    rows += [(20, base[3] + " mail me at x.y@zz.org", "s0"), (21, base[4], "s1"), (22, base[4], "s1"), (23, "too short", "s1"), (24, None, None), (25, base[5] + " 10.1.2.3 " * 1, None)]
    docs = docs_of(rows)
    clash = docs.withColumns({"n_words": docs["doc_id"], "failures": docs["doc_id"]})
    assert P.quality(spark, clash, "").where("n_words <> doc_id or failures <> doc_id").count() == 0
    kept = P.quality(spark, docs, "")
    assert kept.dtypes == docs.dtypes and sorted(r["doc_id"] for r in kept.collect()) == [*range(12), 20, 21, 22, 25]
    one = P.near_copies(spark, kept, "")
    texts = {d: t for d, t, _ in rows}
    left = {r["doc_id"] for r in one.collect()}
    assert left == heads([(d, texts[d]) for d in sorted(set(texts) - {23, 24})]) and 20 not in left  # 79 of 83 shingles are those of 3
    assert 21 not in left and 22 not in left
    field = crf.fit(crf.labelled_table(spark))
    masked = P.personal_data(spark, docs, "")
    want = {d: crf.masked_text(t, crf.all_spans([t], field)[0][1]) for d, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in masked.collect()} == want and "[EMAIL]" in want[20] and "[IP]" in want[25]
    mixed = P.mixing(spark, docs, "")
    assert mixed.dtypes == docs.dtypes and set(rows_of(mixed)) <= set(rows_of(docs))
    packed = P.packed(spark, mixed, "")
    pieces = collections.Counter(r["doc_id"] for r in packed.collect())
    assert pieces == collections.Counter(r["doc_id"] for r in mixed.collect())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["op2_licences", "op3_ledger", "op7_warc", "op9_mixture"])
def test_against_the_oracle(spark, name):
    import check

    verdict = check.compare(entry.queries()[name](spark, SMALL), check.connect(SMALL), entry.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_run_covers_the_kept_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    final = P.run(spark, SMALL)
    kept = {r["doc_id"] for r in P.quality(spark, docs, SMALL).collect()}
    assert {r["doc_id"] for r in final.collect()} <= kept
    assert [n for n, _ in P.STAGES] == ["quality rules", "near copies", "personal data", "mixture", "packing"] and P.ORACLE_SQL is None
