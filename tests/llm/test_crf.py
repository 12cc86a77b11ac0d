"""Base patterns against plain regular expressions; the field on held-out rows."""

import random
import re

import numpy as np
import pytest

from cohortloom.llm import crf as C

from .conftest import EDGE_TEXTS


@pytest.fixture(scope="module")
def field(spark):
    return C.fit(C.labelled_table(spark))


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and C.luhn(digits(m[0]))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    r = random.Random(8)
    for _ in range(20000):
        text = "".join(r.choice("ab12345678900@@.+-_%( )é. ") for _ in range(r.randint(0, 50)))
        assert C.base_spans(text) == plain(text), text
    for text in ("a" * 50000 + "@", "1" * 50000, "a@b.c_x@d.e", "4111 1111-1111 1111", "+" * 9 + "1 (234) 567-8901"):
        assert C.base_spans(text)[:9] == (plain(text) if len(text) < 100 else [])


def test_held_out_words_are_labelled(field):
    rows = [C.sequence_of(*r) for r in C.labelled_rows(400, seed=123)]
    found = C.viterbi(field, [C.features(w) for w, _ in rows])
    pairs = [(a, b) for (_, want), got in zip(rows, found) for a, b in zip(want, got)]
    hit = sum(a == b != "O" for a, b in pairs)
    assert hit / sum(b != "O" for _, b in pairs) > 0.95
    assert hit / sum(a != "O" for a, _ in pairs) > 0.93


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(0)
    n = len(C.LABELS)
    moves, first = C._allowed()
    f = C.Field(r.normal(size=(C.FEATURES, n)).astype("f4"), (moves + r.normal(size=(n, n))).astype("f4"), (first + r.normal(size=n)).astype("f4"), r.normal(size=n).astype("f4"))
    rows = [C.features(["word"] * 0 + w.split()) for w in ("a 1", "b 22 x", "c", "4 d 5")]
    import itertools

    for x, got in zip(rows, C.viterbi(f, rows)):
        score = f.state[x].sum(axis=1)
        best = max(itertools.product(range(n), repeat=len(x)), key=lambda p: f.first[p[0]] + f.last[p[-1]] + sum(score[i, v] for i, v in enumerate(p)) + sum(f.moves[a, b] for a, b in zip(p, p[1:])))
        assert got == [C.LABELS[v] for v in best]


def test_added_spans_keep_the_base(field):
    texts = ["call (555) 010-4477 now", "mail ann [at] host [dot] org please", "version 2.0. of 2019 and 12345", "from +1 (555) 555-0199 at a.b@c.de", None, "", "clean words only"]
    found = C.all_spans(texts, field)
    assert [[t[a:b] for _, a, b in every] for t, (_, every) in zip(texts, found) if t] == [
        ["(555) 010-4477"], ["ann [at] host [dot] org"], [], ["a.b@c.de", "+1 (555) 555-0199"], [],
    ]
    for base, every in found:
        assert set(base) <= set(every)
    assert C.masked_text(texts[3], found[3][1]) == "from [PHONE] at [EMAIL]"


def test_find_and_mask(spark, docs_of, field):
    docs = docs_of(EDGE_TEXTS + [(20, "reach me: x@y.zz 10.0.0.1")])
    rows = {(r["doc_id"], r["n_email"], r["n_ip"], r["spans"]) for r in C.find(docs, field).collect()}
    assert (20, 1, 1, "email:10:16,ip:17:25") in rows and (1, 0, 0, "") in rows
    assert C.find(docs, field).count() == docs.count()
    masked = C.mask(docs, field)
    assert masked.dtypes == docs.dtypes and masked.where("doc_id = 20").collect()[0]["text"] == "reach me: [EMAIL] [IP]"
    assert masked.where("doc_id = 20").collect()[0]["n_chars"] == 22
    assert C.mask(docs.limit(0), field).count() == 0
    with pytest.raises(ValueError, match="labelled"):
        C.fit(C.labelled_table(spark, 30), most=10)
