"""Licence scan: Dice coefficient over word bigrams against templates, in DataFrame functions only.

Units are the lines of a text and the whole text. A unit is normalised to lower-case ASCII letters and
digits in single spaces, cut into words, and compared as a set of word bigrams. Two sets of sizes a and b
have a Dice coefficient of at most 2 min(a, b) / (a + b), so only templates with
a t / (2 - t) <= b <= a (2 - t) / t can reach the threshold t; units outside all bounds are dropped by
their word count before any bigram is made. The bounds also give the least number of shared bigrams, and
with it a few bigrams of which a matching unit must hold one; texts and lines without the words of any are
skipped. The templates are a literal of the plan (their number and
length are fixed), so nothing is joined or shuffled.

Defined cases: NULL, empty and blank texts, and units of fewer than two words, have no bigrams and match
nothing. Equal lines of a text are separate matches. Of several templates above the threshold all are
reported, `best` marks the highest (ties: the first name). Repeated rows give repeated matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Short notices of common licences.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
}
THRESHOLD = 0.8


def normal_words(text: str) -> list[str]:
    """Words of a template, as `unit_words` makes them of a column."""
    return re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of bigram sets whose Dice coefficient with a set of this size can reach the threshold."""
    low = next(k for k in range(1, size + 1) if 2 * k >= threshold * (size + k))
    high = size
    while 2 * size >= threshold * (size + high + 1):
        high += 1
    return low, high


def sure_pairs(grams: list[str], low: int, threshold: float) -> set[str]:
    """Bigrams of a template of which every unit that reaches the threshold holds at least one.

    Such a unit shares at least threshold * (low + size) / 2 of the template's bigrams, so it misses fewer
    than are taken here; long ones are taken, since they are rare in other texts.
    """
    shared = math.ceil(threshold * (low + len(grams)) / 2 - 1e-9)
    return set(sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - shared + 1])


def unit_words(unit: Column) -> Column:
    plain = F.lower(F.btrim(F.regexp_replace(unit, "[^A-Za-z0-9]+", " ")))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per matching unit and template: key, line (from 1; 0 for the whole text), licence, dice, best."""
    known = {}
    for name, notice in sorted(templates.items()):
        grams = bigrams(normal_words(notice))
        if not grams:
            raise ValueError(f"template {name} has fewer than two words")
        known[name] = (grams, *size_bounds(len(grams), threshold))
    fewest = min(low for _, low, _ in known.values())
    most = max(high for _, _, high in known.values())
    sure = sorted(set().union(*[sure_pairs(own, low, threshold) for own, low, _ in known.values()]))

    def may_match(of: Column) -> Column:
        """Whether both words of one of the sure bigrams occur at all; plain substring searches rule out most texts and lines."""

        def any_of(low_case: Column) -> Column:
            found = F.lit(False)
            for first, second in map(str.split, sure):
                found = found | (F.contains(low_case, F.lit(first)) & F.contains(low_case, F.lit(second)))
            return found

        return let(F.lower(of), any_of)

    docs = docs.where(may_match(F.col(text)))
    lines = F.split(F.col(text), "\\n")
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line"), F.col(text).alias("unit"))))
    units = docs.select(F.col(key).alias("key"), F.explode(F.concat(numbered, F.coalesce(whole, F.array().cast("array<struct<line:int,unit:string>>")))).alias("u"))
    # A set of `fewest` bigrams needs as many words and one more; each word and the gap after it takes two characters.
    units = units.where((F.length("u.unit") >= 2 * fewest + 1) & may_match(F.col("u.unit")))
    def pairs(words: Column) -> Column:
        return F.array_distinct(
            F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
        )

    def score(grams: Column, name: str, own: list[str], low: int, high: int) -> Column:
        dice = F.lit(2.0) * F.size(F.array_intersect(grams, F.lit(own))) / (F.size(grams) + F.lit(len(own)))
        return F.when(F.size(grams).between(low, high), F.struct(F.lit(name).alias("licence"), dice.alias("dice")))

    def hits(grams: Column) -> Column:
        every = F.filter(F.array(*[score(grams, n, *k) for n, k in known.items()]), lambda s: s["dice"] >= threshold)
        return F.when(F.size(grams).between(fewest, most), every)

    def best(found: Column) -> Column:
        """The highest score's first name; each score is negated so that one minimum decides both."""
        lowest = F.array_min(F.transform(found, lambda s: F.struct((-s["dice"]).alias("d"), s["licence"].alias("n"))))
        return F.struct(lowest["n"].alias("first"), found.alias("hits"))

    whole_hits = let(unit_words(F.col("u.unit")), lambda w: F.when(F.size(w) > fewest, let(pairs(w), hits)))
    marked = units.select("key", "u.line", let(whole_hits, best).alias("m")).where(F.size("m.hits") > 0)
    marked = marked.select("key", "line", "m.first", "m.hits")
    flat = marked.select("key", "line", "first", F.explode("hits").alias("hit"))
    return flat.select(
        F.col("key").alias(key), "line", "hit.licence", "hit.dice", (F.col("hit.licence") == F.col("first")).alias("best")
    )


def oracle(templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The scan in DuckDB SQL, without pruning."""
    rows = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    normal = "list_filter(string_split(lower(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' '), lambda w: w <> '')"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
    WITH templates(licence, notice) AS (VALUES {rows}),
    t AS (SELECT licence, {pairs.format('w')} AS tg FROM (SELECT licence, {normal.format('notice')} AS w FROM templates)),
    lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS unit FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    units AS (SELECT doc_id, CAST(line AS INTEGER) AS line, unit FROM lines UNION ALL
      SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
    g AS (SELECT doc_id, line, {pairs.format('w')} AS g FROM (SELECT doc_id, line, {normal.format('unit')} AS w FROM units)),
    hits AS (SELECT doc_id, line, licence, CAST(2.0 AS DOUBLE) * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
      FROM g, t WHERE len(g) BETWEEN 1 AND 200)
    SELECT doc_id, line, licence, dice,
      row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, licence) = 1 AS best
    FROM hits WHERE dice >= {threshold}"""
