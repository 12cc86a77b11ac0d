"""Quality rules as a bitmask ledger: every rule is evaluated once, policies only read its bits.

`build_ledger` adds the measurements and one `failures` bitmask to the rows. A policy is a versioned mask:
a row is kept when no bit of the mask failed. Ablations count rows per failure mask with map-side
aggregation (at most one row per distinct mask leaves a task) and never evaluate a rule again.

Defined cases: a NULL, empty or blank text has no words, all measurements 0, and fails `too_few_words`.
Texts of any length are measured whole. Repeated rows are judged alike. Columns of the input that share
a name with a measurement are replaced by the measurement.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the measurements.
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3


@dataclass(frozen=True)
class Rule:
    """A rule fails a row when its SQL condition over the measurements holds."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of the set of rules that reject."""

    name: str
    version: int
    rules: tuple[str, ...]


#: The place of a rule is its bit; append, never reorder.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("many_exclamations", "2 * n_exclamations > n_words"),
    Rule("mostly_capitals", "2 * n_capitals > word_chars"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_distinct_words", "10 * n_distinct_words < n_words"),
)
POLICIES: tuple[Policy, ...] = (
    Policy("base", 1, ("too_few_words", "repeated_windows")),
    Policy(
        "web", 1,
        ("too_few_words", "repeated_windows", "many_symbols", "duplicate_lines", "many_exclamations", "mostly_capitals",
         "short_words", "long_words"),
    ),
)
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_exclamations",
    "n_capitals",
)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window whose words occur as a window at least twice in the row's array.

    Windows are compared by a 64-bit hash. Only rows with a repeated hash sort theirs: neighbours in the
    sorted list that share a hash are the repeats, and the covered words follow from their places in order.
    """

    def covered(starts: Column) -> Column:
        return F.aggregate(
            starts,
            F.struct(F.lit(0).cast("long").alias("total"), F.lit(-WINDOW).alias("last")),
            lambda acc, s: F.struct(
                (acc["total"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("total"), s.alias("last")
            ),
        )["total"]

    def repeats(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _let(
            placed,
            lambda p: F.filter(
                p,
                lambda x, k: F.coalesce(F.get(p, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
            ),
        )
        return covered(F.sort_array(F.transform(twice, lambda x: x["i"])))

    def windows(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), repeats(hashes)).otherwise(F.lit(0).cast("long"))

    return _let(words, lambda w: _let(windows(w), count))


def _lines(text: Column) -> Column:
    """(lines with a word, how many of them equal an earlier one)"""
    worded = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return _let(
        worded,
        lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )


def _words(text: Column) -> Column:
    return _let(
        F.filter(F.split(text, WHITE), lambda x: x != ""),
        lambda w: F.struct(
            F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct"), repeated_words(w).alias("repeat")
        ),
    )


def measures(text: Column) -> dict[str, Column]:
    """Measurements of a text column by name."""
    whole = F.coalesce(text, F.lit(""))
    words, lines = _words(whole), _lines(whole)

    def matching(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern))

    return {
        "_words": words,
        "_lines": lines,
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")),
        "n_symbols": matching(SYMBOLS),
        "n_exclamations": matching("!"),
        "n_capitals": matching(r"\p{Lu}"),
    }


def build_ledger(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows with their measurements (long) and `failures`: bit k is set when rule k fails."""
    if len(rules) > 63:
        raise ValueError("a ledger has 63 bits")
    found = measures(F.col(text))
    helpers = {f"__ledger{k}": v for k, v in found.items()}
    rows = docs.drop(*[c for c in docs.columns if c.lower() in {*MEASURES, "failures"} and c != text])
    rows = rows.withColumns(helpers)
    rows = rows.withColumns(
        {
            "n_words": F.col("__ledger_words.n"),
            "n_distinct_words": F.col("__ledger_words.distinct"),
            "n_repeat_words": F.col("__ledger_words.repeat"),
            "n_lines": F.col("__ledger_lines.n"),
            "n_dup_lines": F.col("__ledger_lines.dup"),
            **{k: F.col(f"__ledger{k}") for k in found if not k.startswith("_")},
        }
    ).drop(*helpers)
    rows = rows.withColumns({m: F.col(m).cast("long") for m in MEASURES})
    bits = [F.when(F.expr(r.fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, r in enumerate(rules)]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return rows.withColumn("failures", failures)


def mask_of(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    """Bitmask of a policy's rules."""
    places = {r.name: k for k, r in enumerate(rules)}
    return sum(1 << places[name] for name in policy.rules)


def policy_named(name: str, version: int | None = None) -> Policy:
    """A registered policy; the newest version unless one is asked for."""
    found = [p for p in POLICIES if p.name == name and version in (None, p.version)]
    if not found:
        raise KeyError(f"no policy {name} {version or ''}")
    return max(found, key=lambda p: p.version)


def passes(mask: int) -> Column:
    """Whether no rule of the mask failed."""
    return F.col("failures").bitwiseAND(F.lit(mask).cast("long")) == 0


def apply_policy(ledger: DataFrame, policy: Policy, out: str = "kept") -> DataFrame:
    """The ledger with the policy's verdict; no rule is evaluated again."""
    return ledger.withColumn(out, passes(mask_of(policy)))


def ablate(ledger: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per rule of the policy: rows it fails, rows that only it rejects, rows kept without it, rows kept in all.

    An empty ledger gives zeros.
    """
    mask = mask_of(policy, rules)
    masks = ledger.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for place, rule in enumerate(rules):
        if rule.name in policy.rules:
            bit = F.lit(1 << place).cast("long")
            parts.append((rule.name, F.sum(F.when(F.col("m").bitwiseAND(bit) != 0, F.col("n"))), F.sum(F.when(F.col("m") == bit, F.col("n")))))
    kept = F.coalesce(F.sum(F.when(F.col("m") == 0, F.col("n"))), F.lit(0)).alias("kept")
    zero = F.lit(0)
    sums = masks.agg(
        kept,
        F.array(
            *[F.struct(F.lit(n).alias("rule"), F.coalesce(f, zero).alias("failed"), F.coalesce(o, zero).alias("only")) for n, f, o in parts]
        ).alias("rules"),
    )
    return sums.select("kept", F.explode("rules").alias("r")).select(
        F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "r.rule", "r.failed", "r.only",
        "kept", (F.col("kept") + F.col("r.only")).alias("kept_without"),
    )
