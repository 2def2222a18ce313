"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit per rule;
policies are versioned masks over those bits, so changing a policy or asking what a rule alone rejects
(an ablation) reads the ledger's bits and never the texts.

Defined results: a null text counts as empty (no words, which fails ``too_few_words``); a repeated row gets
the same ledger row each time; further columns of the input are passed on unless they bear a ledger name,
then the ledger's column replaces them; an empty table gives an empty ledger and ablations of zero.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.base import fresh, once, text_of, words_of

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_pipes", "n_stutters")
#: Rule -> failure, over the measurements. Bit k of the ledger belongs to the k-th rule; append only.
RULES: dict[str, Column | Callable[[], Column]] = {
    "too_few_words": lambda: F.col("n_words") < 20,
    "repeated_windows": lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
    "symbol_share": lambda: 5 * F.col("n_symbols") > F.col("n_words"),
    "bang_share": lambda: 3 * F.col("n_bangs") > F.col("n_words"),
    "pipe_share": lambda: 5 * F.col("n_pipes") > F.col("n_words"),
    "duplicate_lines": lambda: (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines")),
    "word_length": lambda: ~F.col("word_chars").between(2 * F.col("n_words"), 25 * F.col("n_words")),
    "stutter_share": lambda: 10 * F.col("n_stutters") > 3 * F.col("n_words"),
}
BASE = ("too_few_words", "repeated_windows")
#: Version -> rules it enforces.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": (*BASE, "symbol_share", "bang_share"), "v2": tuple(RULES)}


def mask(rules: tuple[str, ...]) -> int:
    """The bits of these rules."""
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def _repeat_words(words: Column) -> Column:
    return once(words, _covered)


def _covered(words: Column) -> Column:
    """Words in windows of WINDOW words that the text holds twice or more.

    Windows are compared by 64-bit hash. Most texts have no equal pair and stop there; others sort
    (hash, start), flag starts with an equal neighbour and add up the gaps between them, WINDOW at most.
    """
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(F.lit(None).cast("array<int>"))
    hashes = F.coalesce(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)])), F.array().cast("array<bigint>"))

    def flagged(ranked: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(ranked, i + d)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ranked, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

    def covered(s: Column) -> Column:
        gaps = F.transform(s, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(s, k + 1) - p), F.lit(WINDOW)).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    ranked = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = lambda h: once(ranked(h), lambda r: once(flagged(r), covered))
    return once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(count(h)))


def ledger(docs: DataFrame, text: str = "text", rules: Mapping[str, Callable[[], Column]] = RULES) -> DataFrame:
    """docs with the MEASURES and fail_bits (long), without the text's copies: one narrow pass, no shuffle."""
    own = text_of(text)
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = fresh(docs, "_words", "_lines")
    out = docs.withColumns(dict(zip(held, (words_of(own), lines), strict=True)))
    words, lines = map(F.col, held)
    symbols = F.regexp_count(own, F.lit(r"[#*$%&|<>]"))
    out = out.withColumns({
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(words),
        "n_bangs": F.regexp_count(own, F.lit("!")).cast("long"),
        "n_pipes": F.regexp_count(own, F.lit(r"\|")).cast("long"),
        "n_stutters": once(words, lambda ws: F.size(F.filter(ws, lambda w, i: F.get(ws, i - 1) == w)).cast("long")),
        "n_lines": F.size(lines).cast("long"),
        "n_words": F.size(words).cast("long"),
    }).drop(*held)
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(rule(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return out.withColumn("fail_bits", bits)


def apply_policy(found: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with base_failed, kept (no enforced rule failed) and policy."""
    failed = lambda names: F.col("fail_bits").bitwiseAND(F.lit(mask(names)).cast("long")) != 0
    return found.withColumns({"base_failed": failed(BASE), "kept": ~(failed(BASE) | failed(POLICIES[version])), "policy": F.lit(version)})


def ablations(found: DataFrame, version: str = "v2") -> DataFrame:
    """Per enforced rule: documents failing it, and documents that only it rejects (kept were it left out).

    One aggregation over the bits; the ledger's rows are first folded to one count for each pattern of bits.
    """
    enforced = POLICIES[version]
    hit = F.col("fail_bits").bitwiseAND(F.lit(mask(enforced)).cast("long"))
    patterns = found.groupBy(hit.alias("hit")).agg(F.count(F.lit(1)).alias("n"))
    bit = lambda k: F.lit(1 << k).cast("long")
    sums = [F.struct(F.lit(name).alias("rule"),
                     F.coalesce(F.sum(F.when(F.col("hit").bitwiseAND(bit(k)) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
                     F.coalesce(F.sum(F.when(F.col("hit") == bit(k), F.col("n"))), F.lit(0)).alias("n_only"))
            for k, name in enumerate(RULES) if name in enforced]
    return patterns.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def keep_good(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns."""
    found = apply_policy(ledger(docs.select(F.struct("*").alias("row"), F.col("text"))), version)
    # A deterministic filter would be pushed below the ledger, which would then be worked out twice.
    return found.filter(F.when(F.rand(0) >= 0, F.col("kept"))).select("row.*")
