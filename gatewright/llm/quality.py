"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Signals of a text (shares of symbols, capitals, marks, repeated lines and repeated word windows)
are each held against a cutoff; a text above any of them is rejected. Cutoffs are chosen on a
labelled holdout: for each stratum, rule and candidate cutoff the number k of good documents
among n that it would reject gives the exact binomial probability of k or fewer under a false
rejection rate of ``alpha / rules``. A cutoff is certified if that probability is at most
``delta`` divided by the number of all tests (Bonferroni), so with probability 1 - delta every
certified cutoff of every stratum keeps its rate, whichever of them is then chosen. Of the
certified ones the cutoff that rejects most bad documents is taken, of equal ones the largest.
A stratum without a certified cutoff for a rule rejects nothing by it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import PREFIX, let, materialize, unwrap, wrap

#: Separators of words, and characters counted as symbols: fixed values of the contract.
WHITE_CHARS = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: The rules, each with its candidate cutoffs. A share above the cutoff rejects.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
    "capital_share": (0.05, 0.08, 0.12, 0.16, 0.2, 0.3, 0.4, 0.6),
    "mark_share": (0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2),
    "dup_line_share": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7),
    "repeat_share": (0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16),
}


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    trimmed = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, WHITE_CLASS)).otherwise(F.array().cast("array<string>"))


def _repeated(hashes: Column, width: int) -> Column:
    """How many words stand in windows that occur twice or more, given a hash of each window."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        same = lambda e, other: F.coalesce(e["h"] == other["h"], F.lit(False))
        found = F.filter(ordered, lambda e, k: same(e, F.get(ordered, k - 1)) | same(e, F.get(ordered, k + 1)))
        return let(F.sort_array(F.transform(found, lambda e: e["i"])), covered)

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)),
    )


def text_signals(text: Column) -> Column:
    """A struct of counts over the whole text; all zero for a null text.

    A window is known by a 64-bit hash, so two of one text that differ count as equal with a
    probability below n * n / 2**65.
    """
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def windows(w: Column) -> Column:
        heads = F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0)))
        return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, WINDOW)]))

    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated(windows(w), WINDOW).alias("n_repeat_words"),
        ),
    )
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    return F.struct(by_words.alias("words"), by_lines.alias("lines"), count(SYMBOLS).alias("n_symbols"), count(r"\p{Lu}").alias("n_capitals"), count("[!?]").alias("n_marks"))


def flat_signals(s: Column) -> list[Column]:
    """Counts, the shares that the rules look at, and the base verdict, from ``text_signals``."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n_words, chars = s["words"]["n_words"], s["words"]["word_chars"]
    repeat = s["words"]["n_repeat_words"]
    return [
        n_words.alias("n_words"),
        chars.alias("word_chars"),
        s["n_symbols"].alias("n_symbols"),
        s["lines"]["n_dup_lines"].alias("n_dup_lines"),
        repeat.alias("n_repeat_words"),
        ((n_words < 10) | (100 * repeat > 20 * n_words)).alias("base_failed"),
        share(s["n_symbols"], chars).alias("symbol_share"),
        share(s["n_capitals"], chars).alias("capital_share"),
        share(s["n_marks"], chars).alias("mark_share"),
        share(s["lines"]["n_dup_lines"], s["lines"]["n_lines"]).alias("dup_line_share"),
        share(repeat, n_words).alias("repeat_share"),
    ]


def binomial_at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), summed term by term in logarithms."""
    odds = math.log(rate) - math.log1p(-rate)
    first = n * F.lit(math.log1p(-rate))

    def more(acc: Column, i: Column) -> Column:
        log_term = acc["log_term"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double")) + F.lit(odds)
        return F.struct(log_term.alias("log_term"), (acc["total"] + F.exp(log_term)).alias("total"))

    start = F.struct(first.cast("double").alias("log_term"), F.exp(first).alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1)))).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, start, more, lambda acc: acc["total"])


def calibrate(signals: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", stratum_col: str = "stratum", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row for each stratum with its cutoff for each rule (null: none is certified).

    ``signals`` has the id, the stratum and the shares. Rows whose base verdict is failed take
    no part. An id with several labels is good only if all say 1. All strata with labelled
    rows are tested.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).groupBy("id").agg(F.min("label").alias("label"))
    rows = signals.where(~F.col("base_failed")).join(marked, F.col(id_col) == F.col("id"))
    # A value above j cutoffs of its rule counts for the first j of them. One row a rule, stratum and
    # number of cutoffs leaves the labelled rows; -1 stands for all rows of the stratum.
    passed = lambda rule: lambda c: c < F.col(rule)
    above = [F.size(F.filter(F.array(*map(F.lit, cutoffs)), passed(rule))) for rule, cutoffs in RULES.items()]
    pairs = [F.struct(F.lit(i).alias("i"), n.alias("above")) for i, n in enumerate(above)]
    good, bad = (F.col("label") == 1).cast("long"), (F.col("label") == 0).cast("long")
    each = rows.select(F.col(stratum_col).alias("stratum"), good.alias("good"), bad.alias("bad"), F.inline(F.array(*pairs)))
    held = each.groupBy("stratum", "i", "above").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    at = F.explode(F.sequence(F.lit(-1), F.col("above") - 1)).alias("j")
    counted = held.select("stratum", "i", "good", "bad", at).groupBy("stratum", "i", "j").agg(F.sum("good").alias("k"), F.sum("bad").alias("caught"))
    counted = materialize(counted, "quality-strata")
    strata = max(counted.agg(F.countDistinct("stratum")).collect()[0][0], 1)
    # A few dozen rows a stratum.
    n = F.max(F.when(F.col("j") == -1, F.col("k"))).over(Window.partitionBy("stratum", "i"))
    grid = F.array(*[F.array(*map(F.lit, cutoffs)) for cutoffs in RULES.values()])
    tested = counted.withColumn("n", n).where("j >= 0").withColumn("cutoff", F.get(F.get(grid, F.col("i")), F.col("j")))
    rate, n_tests = alpha / len(RULES), sum(len(c) for c in RULES.values())
    # At k of rate * n or more the probability is about a half or more, far above any level.
    p_value = F.when(F.col("k") < F.col("n") * rate, binomial_at_most(F.col("k"), F.col("n"), rate)).otherwise(F.lit(1.0))
    certified = tested.where((p_value <= delta / n_tests / strata) & (F.col("caught") > 0))
    best = [F.max(F.when(F.col("i") == i, F.struct("caught", "cutoff")))["cutoff"].alias(f"cut_{rule}") for i, rule in enumerate(RULES)]
    return certified.groupBy("stratum").agg(*best)


def _kept() -> Column:
    """No reason to reject. The reasons are counted in one term, so that a filter on it stays above
    the join and the signals are computed once."""
    reasons = F.coalesce(F.col("base_failed").cast("int"), F.lit(0))
    for rule in RULES:
        reasons = reasons + F.coalesce((F.col(rule) > F.col(f"cut_{rule}")).cast("int"), F.lit(0))
    return reasons == 0


def signal_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The id, the stratum (``und`` for null) and all signals of each row, without the text."""
    s = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"), let(F.col(text_col), text_signals).alias("s"))
    return s.select("doc_id", "stratum", *flat_signals(F.col("s")))


def verdicts(signals: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``signals`` with ``kept``; the cutoffs have a small row a stratum, and are joined without a hint."""
    return signals.join(cutoffs.withColumnRenamed("stratum", PREFIX + "of"), F.col("stratum") == F.col(PREFIX + "of"), "left").withColumn("kept", _kept())


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row of counts, ``base_failed`` and ``kept`` for each row of ``docs``.

    The signals are computed once over all rows, written without the texts, and serve both the
    calibration and the verdicts. A null text has no word and fails the base rule; a null id has
    no label but is judged; repeated rows are judged each; no labels mean no certified cutoff.
    """
    signals = materialize(signal_table(docs), "quality-signals")
    return verdicts(signals, materialize(calibrate(signals, labels, **options), "quality-cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.

    The signals are computed once and written beside their rows; calibration reads them without
    the rows. A null text has no word and goes; a null stratum is ``und``; a null id has no label
    but is judged; repeated rows are judged each; an empty table gives no rows.
    """
    row = F.col(PREFIX + "row")
    wrapped = wrap(docs).select(row, F.coalesce(row[stratum_col].cast("string"), F.lit("und")).alias("stratum"), let(row[text_col], text_signals).alias("s"))
    signals = materialize(wrapped.select(row[id_col].alias("doc_id"), "stratum", *flat_signals(F.col("s")), row), "quality-rows")
    cutoffs = materialize(calibrate(signals.drop(PREFIX + "row"), labels, **options), "quality-cutoffs")
    return verdicts(signals, cutoffs).where("kept").select(*unwrap(docs.columns, []))
