"""Quality rules judged per host: rule failures by domain, shrunk rates, verdict joined back.

Every document is measured with built-in functions only. Failures of each
rule are counted per host with partial aggregation, the rates are shrunk by a
beta prior fitted to all hosts (moments), and a host whose shrunk rate passes
``reject_rate`` for some rule is rejected with all its documents.

Null text counts as empty (no words, fails the base rule); a null host is a
host of its own; repeated rows are judged one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsledger.llm.common import SPACE, table

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
NO_HOST = "\x00"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(trigrams: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    Windows are sorted by (hash, place); equal neighbours are the repeated
    ones. Their places in order then cover min(3, step) new words each.
    """
    def covered(s: Column) -> Column:
        def repeated(x: Column, j: Column) -> Column:
            h = x["h"]
            return F.when((F.get(s, j - 1)["h"] == h) | (F.get(s, j + 1)["h"] == h), x["i"])
        places = F.sort_array(F.filter(F.transform(s, repeated), lambda x: x.isNotNull()))
        return F.aggregate(
            places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
            lambda acc: acc["n"])
    return _let(F.sort_array(F.transform(trigrams, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)


def _word_stats(words: Column) -> Column:
    """Struct of n (words) and again (n_repeat_words)."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    again = _let(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), _repeat_words(t)).otherwise(F.lit(0)))
    return F.struct(n.alias("n"), F.when(n >= 4, again).otherwise(F.lit(0)).alias("again"))


def _line_stats(lines: Column) -> Column:
    """Struct of n (lines that hold a word) and dup (those equal to an earlier one)."""
    return F.struct(F.size(lines).alias("n"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"))


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_w": _let(words, _word_stats), "_l": _let(lines, _line_stats)})
    return out.withColumns({
        "n_words": F.col("_w.n").cast("long"),
        "word_chars": F.length(F.translate(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.col("_l.n").cast("long"),
        "n_dup_lines": F.col("_l.dup").cast("long"),
        "n_repeat_words": F.col("_w.again").cast("long")}).drop("_w", "_l")


def rules() -> dict[str, Column]:
    """Rule name -> failure condition over the columns of ``document_stats``."""
    return {
        "base": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "dup_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("n_words") > 0) & ((F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
    }


def host_verdicts(flagged: DataFrame, host_col: str, names: list[str], reject_rate: float = 0.9,
                  max_strength: float = 1000.0) -> DataFrame:
    """One row per host: n, shrunk rate of each rule (``rate_<rule>``), ``host_rejected``.

    Prior of a rule: mean m of all documents, variance v between hosts beyond
    the binomial noise; strength m(1-m)/v - 1, kept in [1, max_strength].
    """
    hosts = flagged.groupBy(host_col).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"fail_{r}").cast("long")).alias(f"k_{r}") for r in names])
    hosts = table(hosts, "hosts")
    whole = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), *[F.sum(f"k_{r}").alias(f"k_{r}") for r in names]).first()
    if not whole["n"]:
        return hosts.select(host_col, "n", *[F.lit(0.0).alias(f"rate_{r}") for r in names], F.lit(False).alias("host_rejected"))
    mean = {r: whole[f"k_{r}"] / whole["n"] for r in names}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(f"k_{r}") / F.col("n") - F.lit(mean[r]), 2)).alias(r) for r in names]).first()
    rates = []
    for r in names:
        m = mean[r]
        between = spread[r] / whole["n"] - m * (1 - m) * whole["hosts"] / whole["n"]
        strength = max_strength if between <= 0 else min(max(m * (1 - m) / between - 1, 1.0), max_strength)
        rates.append(((F.col(f"k_{r}") + F.lit(m * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{r}"))
    out = hosts.select(host_col, "n", *rates)
    return out.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{r}") for r in names], F.lit(0.0)) > reject_rate)


def judge(docs: DataFrame, carry: list[str], text_col: str = "text", host_col: str = "source",
          reject_rate: float = 0.9) -> DataFrame:
    """Columns ``carry`` of ``docs`` plus the statistics, ``base_failed``, ``host_rejected`` and ``kept``.

    The measured rows are written once; the host table is aggregated from them
    and joined back on the host. Where it is not small enough to broadcast, the
    adaptive skew join splits a host that holds many documents.
    """
    names = list(rules())
    measured = document_stats(docs, text_col).withColumn("_host", F.coalesce(F.col(host_col), F.lit(NO_HOST)))
    flagged = table(measured.select(*carry, "_host", *STATS, *[c.alias(f"fail_{r}") for r, c in rules().items()]), "measured")
    verdicts = table(host_verdicts(flagged, "_host", names, reject_rate).select("_host", "host_rejected"), "verdicts")
    out = flagged.join(verdicts, "_host", "left")
    return (out.withColumn("base_failed", F.col("fail_base"))
            .withColumn("kept", ~F.col("fail_base") & ~F.col("host_rejected"))
            .drop("_host", *[f"fail_{r}" for r in names]))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The digest of ``op10``: doc_id, n_words, four statistics, base_failed, kept, host_rejected."""
    judged = judge(docs.select("doc_id", "text", "source"), ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "host_rejected")
