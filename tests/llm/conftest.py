import pytest


def rows_of(df):
    """Rows as tuples in a stable order, NULLs first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is not None, str(type(x)), x) for x in t))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table from (doc_id, text[, source]) rows, with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], "en", (r[2] if len(r) > 2 else "s"), len(r[1] or ""), 7, "x", 1) for r in rows]
        return spark.createDataFrame(
            full, "doc_id bigint, text string, lang string, source string, n_chars bigint, fp int, _row string, shard int"
        )

    return make


EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "two words"), (None, "no id here"), (None, None),
    (6, "Long " * 30000), (7, "é" * 5000), (8, "a b c d e\na b c d e\n\nx" * 40), (9, "\x85  <|endoftext|> it's 2.0 (555) 010-4477"),
]
