"""Measurements against plain Python, policies and ablations from the bits alone."""

import collections
import random
import re

from cohortloom.llm import ledger as L

from .conftest import EDGE_TEXTS, rows_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    triples = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if triples[tuple(words[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct_words": len(set(words)),
        "n_exclamations": text.count("!"), "n_capitals": len(re.findall("[A-ZÀ-ÖØ-Þ]", text)),
    }


def test_measures_match_plain_python(spark, docs_of):
    r = random.Random(4)
    texts = ["".join(r.choice(["a ", "b ", "c", "\n", "#", "d\t", "!", "É "]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    docs = docs_of(EDGE_TEXTS + [(100 + k, t) for k, t in enumerate(texts)])
    found = L.build_ledger(docs).select("text", *L.MEASURES).collect()
    assert len(found) == len(EDGE_TEXTS) + len(texts)
    for row in found:
        assert {m: row[m] for m in L.MEASURES} == brute(row["text"]), repr(row["text"])[:80]


def test_bits_follow_the_rules_and_policies_read_them(spark, docs_of):
    docs = docs_of([(1, "w " * 60), (2, None), (3, " ".join(f"word{k}" for k in range(80))), (4, " ".join(f"w{k}#" for k in range(80)))])
    judged = L.apply_policy(L.build_ledger(docs), L.policy_named("web")).select("doc_id", "failures", "kept")
    names = [r.name for r in L.RULES]
    found = {d: ({n for k, n in enumerate(names) if f >> k & 1}, kept) for d, f, kept in rows_of(judged)}
    assert found[1] == ({"repeated_windows", "short_words", "few_distinct_words"}, False)
    assert found[2] == ({"too_few_words"}, False)
    assert found[3] == (set(), True)
    assert found[4] == ({"many_symbols"}, False)


def test_ablation_counts_from_masks(spark, docs_of):
    policy = L.policy_named("base")
    ledger = spark.createDataFrame([(0,), (1,), (1,), (2,), (3,), (4,)], "failures bigint")
    assert [tuple(r) for r in L.ablate(ledger, policy).orderBy("rule").collect()] == [
        ("base", 1, "repeated_windows", 2, 1, 2, 3), ("base", 1, "too_few_words", 3, 2, 2, 4),
    ]
    assert {r["failed"] for r in L.ablate(ledger.limit(0), policy).collect()} == {0}


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 99, 5)], "doc_id bigint, text string, n_words int, failures string")
    row = L.build_ledger(docs).collect()[0]
    assert row["n_words"] == 2 and row["failures"] == 1 + 64  # few and short words
    assert L.build_ledger(docs.limit(0)).count() == 0
