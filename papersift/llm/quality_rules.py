"""Rule bitmask ledger: every quality rule is evaluated once for each document, and its failures are kept
as bits beside the measurements.  A policy is a versioned mask over those bits, so applying another
policy, or asking what one rule alone removes, reads the ledger and no text.

DataFrame functions only; nothing is shuffled but the few counts of an ablation.

Definitions: words are runs of ``[^\\x20\\x09-\\x0D]``.  ``n_repeat_words`` counts the words inside
8-word windows that occur at least twice in the text, the first occurrence included.

Defined results: null text has no words and fails ``few_words``; repeated rows and null ids each keep their row;
an empty table gives an empty ledger; columns of the input that a measurement would hide are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "longest_word")

#: Rules in the order of their bits: name, condition that fails a document.  Ratios are compared in integers.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbol_heavy", "100 * n_symbols > 10 * word_chars"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 20 * n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "n_letters >= 200 AND 100 * n_upper > 60 * n_letters"),
    ("long_word", "longest_word > 1000"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def policy(*names: str) -> int:
    return sum(BIT[n] for n in names)


#: The contract's base rules, then the policies by version; later versions add rules, none is ever changed.
BASE = policy("few_words", "repeated_windows")
POLICIES = {
    1: BASE,
    2: BASE | policy("symbol_heavy", "short_mean_word", "long_mean_word"),
    3: BASE | policy("symbol_heavy", "short_mean_word", "long_mean_word", "duplicate_lines", "upper_case", "long_word"),
}
CURRENT = 3


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column) -> Column:
    """A 64-bit hash of each run of WINDOW words."""
    last = F.size(words) - WINDOW
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: windows in order of (hash, place), those equal to a
    neighbour kept, their places in order, and each adds the words up to the next place, WINDOW at most."""

    def repeated(s: Column) -> Column:
        def place(k: Column) -> Column:
            own = F.get(s, k)["h"]
            same = F.coalesce(own == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(own == F.get(s, k + 1)["h"], F.lit(False))
            return F.when(same, F.get(s, k)["i"])

        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), place), lambda p: p.isNotNull()))

    def summed(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        any_twice = F.size(F.array_distinct(h)) < F.size(h)
        return F.when(any_twice, _let(_let(ordered, repeated), summed)).otherwise(F.lit(0))

    return _let(hashes, of)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _word_measures(words: Column) -> Column:
    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        _covered(_windows(words)).cast("long").alias("n_repeat_words"),
        F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("long").alias("longest_word"),
    )


def _line_measures(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def _only(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id`` or the ``carried`` columns, and the measurements, from the whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = carried or {"doc_id": F.col("doc_id").cast("long")}
    rows = docs.select(*[c.alias(n) for n, c in own.items()], text.alias("text"))
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: F.translate(x, SPACES, "") != "")
    chars = F.length("text")
    rows = rows.select(
        *own,
        _let(_words(F.col("text")), _word_measures).alias("w"),
        _let(lines, _line_measures).alias("l"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _only(F.col("text"), "[^\\p{Lu}]+").alias("n_upper"),
        _only(F.col("text"), "[^\\p{L}]+").alias("n_letters"),
    )
    return rows.select(*own, "w.*", "l.*", "word_chars", "n_symbols", "n_upper", "n_letters").select(*own, *MEASURES)


def ledger(docs: DataFrame, carried: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id`` or the ``carried`` columns, the measurements and ``failed``, the bits of all rules that the document fails."""
    bits = sum((F.when(F.expr(test), F.lit(BIT[name])).otherwise(F.lit(0)) for name, test in RULES), F.lit(0))
    return measure(docs, carried).withColumn("failed", bits.cast("long"))


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy."""
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE)) != 0).withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: how many documents it fails, and how many fail it alone, so would come back without it.

    The bits are first counted by value, at most 2 ** rules rows, whatever the input.
    """
    mask = POLICIES[version]
    counts = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n, _ in RULES if BIT[n] & mask])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failing_alone"),
    )


def keep(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows that a policy keeps, with all their columns."""
    return apply_policy(ledger(docs, {"row": F.struct("*")}), version).where("kept").select("row.*")
