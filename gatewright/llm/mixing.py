"""Mixing to target weights by soft membership, in DataFrame functions only.

A labelled table says for some documents which domain they belong to. A naive Bayes classifier
over binned features (shares of symbols, of capitals and of words that repeat the word before,
length, and how many words of a small lexicon learned for each domain the text holds) gives
every document a posterior over domains. Nonnegative rates are then fitted so that the expected
tokens of each domain, the sum of tokens * posterior * rate, match the targets: least squares on
the errors relative to the targets, by accelerated projected gradient steps, each an aggregate.

A step is scaled by a document's tokens, so it depends on the posterior alone, and that on the
feature cell alone: documents of one cell keep one rate. So the sum over all documents that a
step needs is taken once by cell, over all rows; the rounds then sum over cells, whose number is
bounded by the bins, not by the documents.

The classifier's tables are data to the plan (JSON literals), not generated code.
"""

from __future__ import annotations

import json
import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_scan import SEPARATORS
from .scratch import PREFIX, drawn, let, materialize, unwrap, wrap

#: Upper bounds of the bins of each share, and of the word count.
SYMBOL_BINS = (0.002, 0.03, 0.1)
CAPITAL_BINS = (0.08, 0.3)
REPEAT_BINS = (0.05, 0.3)
LENGTH_BINS = (16, 128, 1024)
LEXICON_BINS = (0, 1)
#: Lexicons multiply the cells: with this many domains there are at most 944,784.
MAX_DOMAINS = 8
#: Cells in one partition of the rounds.
CELLS_AT_ONCE = 1 << 16
TOLERANCE = 1e-3
#: The largest part of its expected share that a domain to be thinned is to keep.
THIN = 0.5

log = logging.getLogger(__name__)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"[{SEPARATORS}]+"), lambda w: w != "")


def _bin(value: Column, bounds: tuple) -> Column:
    out = F.lit(0)
    for b in bounds:
        out = out + (value > b).cast("int")
    return out


def learn_lexicons(
    docs: DataFrame,
    domains: DataFrame,
    names: list[str],
    *,
    text_col: str,
    id_col: str,
    size: int = 64,
    min_docs: int = 4,
    max_docs_per_domain: int = 1000,
) -> dict[str, list[str]]:
    """For each domain the ``size`` words that its documents hold most above the others' rate, at twice the odds at least.

    The lexicon, a part of the classifier, is fitted on a bounded sample: about
    ``max_docs_per_domain`` labelled documents of each domain, chosen by a hash of the id.
    """
    n_of = {r["domain"]: r["count"] for r in domains.groupBy("domain").count().collect()}
    chosen = F.lit(False)
    for d in names:
        share = max_docs_per_domain / max(n_of.get(d, 1), 1)
        chosen = chosen | ((F.col("domain") == d) & drawn(11, F.col("id"), share))
    # At most about max_docs_per_domain ids for each of MAX_DOMAINS domains, so they may be broadcast.
    sample = F.broadcast(domains.where(chosen))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    held = texts.join(sample, "id").select("domain", F.array_distinct(_words(F.col("text"))).alias("words"))
    held = materialize(held, "mixing-lexicon")
    drawn_of = {r["domain"]: r["count"] for r in held.groupBy("domain").count().collect()}
    own_counts = [F.count(F.when(F.col("domain") == d, 1)).alias(f"n_{i}") for i, d in enumerate(names)]
    words = held.select("domain", F.explode("words").alias("word")).groupBy("word").agg(*own_counts)
    total = sum(drawn_of.values()) or 1
    everywhere = sum((F.col(f"n_{i}") for i in range(len(names))), F.lit(0))
    out = {}
    for i, d in enumerate(names):
        n, share = F.col(f"n_{i}"), drawn_of.get(d, 0) / total
        expected = everywhere * share
        score = (n - expected) / F.sqrt(expected * (1 - share) + 1)
        at_odds = n * (1 - share) > 2 * (everywhere - n) * share
        top = words.where((n >= min_docs) & (score > 4) & at_odds).orderBy(score.desc(), "word").limit(size)
        out[d] = [r["word"] for r in top.select("word").collect()]
    return out


def feature_bins(text: Column, lexicons: dict[str, list[str]]) -> tuple[Column, list[int]]:
    """A struct of ``tokens`` and ``cell`` for a text, and the number of bins of each feature."""
    whole = F.coalesce(text, F.lit(""))
    n_chars = F.greatest(F.length(whole), F.lit(1))
    shares = [
        (F.regexp_count(whole, F.lit(r"[#*$%&|<>]")) / n_chars, SYMBOL_BINS),
        (F.regexp_count(whole, F.lit(r"\p{Lu}")) / n_chars, CAPITAL_BINS),
    ]
    sizes = [len(b) + 1 for b in (SYMBOL_BINS, CAPITAL_BINS, REPEAT_BINS, LENGTH_BINS, *[LEXICON_BINS] * len(lexicons))]

    def of_words(words: Column) -> Column:
        n = F.size(words)
        again = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
        parts = [*shares, (again / F.greatest(n, F.lit(1)), REPEAT_BINS), (n, LENGTH_BINS)]
        for d in sorted(lexicons):
            known = F.from_json(F.lit(json.dumps(lexicons[d])), "array<string>")
            parts.append((F.size(F.array_intersect(words, known)), LEXICON_BINS))
        cell = F.lit(0)
        for value, bounds in parts:
            cell = cell * (len(bounds) + 1) + _bin(value, bounds)
        return F.struct(n.cast("long").alias("tokens"), cell.cast("int").alias("cell"))

    return let(_words(whole), of_words), sizes


def _bins_of(cell: Column, sizes: list[int]) -> Column:
    """An array of the bin of each feature, from the number of the cell."""
    out, below = [], 1
    for n in reversed(sizes):
        out.append(F.pmod(F.floor(cell / below), F.lit(n)).cast("int"))
        below *= n
    return F.array(*out[::-1])


def posteriors(counts: DataFrame, names: list[str], sizes: list[int], cell: Column) -> Column:
    """P(domain | cell) of naive Bayes as an array, from a table of (domain, cell, n) over the labelled rows."""
    bins = counts.select("domain", "n", F.posexplode(_bins_of(F.col("cell"), sizes)).alias("feature", "bin"))
    per = bins.groupBy("domain", "feature", "bin").agg(F.sum("n").alias("n"))
    found = {(r["domain"], r["feature"], r["bin"]): r["n"] for r in per.collect()}  # domains * features * bins rows
    tables = []
    for d in names:
        rows = sum(found.get((d, 0, b), 0) for b in range(sizes[0]))
        logs = [[math.log((found.get((d, f, b), 0) + 0.5) / (rows + 0.5 * n)) for b in range(n)] for f, n in enumerate(sizes)]
        tables.append([[math.log(rows + 1)], *logs])
    known = F.from_json(F.lit(json.dumps(tables)), "array<array<array<double>>>")

    def softmax(scores: Column) -> Column:
        powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
        return let(powers, lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, x: a + x)))

    def of_bins(own: Column) -> Column:
        # Table 0 of a domain is its prior alone, which stands at place 0.
        at = F.concat(F.array(F.lit(0)), own)
        picked = lambda table: F.zip_with(table, at, lambda row, b: F.get(row, b))
        return let(F.transform(known, lambda t: F.aggregate(picked(t), F.lit(0.0), lambda a, x: a + x)), softmax)

    return let(_bins_of(cell, sizes), of_bins)


def fit_rates(cells: DataFrame, names: list[str], targets: dict[str, float], *, keep_domain: str | None = None, max_rate: float = 16.0, rounds: int = 100, patience: int = 20, tolerance: float = TOLERANCE) -> tuple[Column, dict[str, float]]:
    """The rate of a cell as a Column over ``p`` (its posteriors), fitted on cells (tokens, p), and the tokens it gives each domain.

    ``targets`` are tokens of each domain. Rates lie between 0 and ``max_rate``, and are one or
    more in cells that most likely belong to ``keep_domain``. The fit ends when all targets are
    met within ``tolerance``, or when ``patience`` rounds have brought it no hundredth nearer, as
    when the bounds forbid the targets. Every round sums the expected tokens over all rows; only
    as many numbers as there are domains, and the test for a restart, come back.
    """
    k = range(len(names))
    p = [F.element_at("p", i + 1) for i in k]
    weight = [1 / max(targets[d], 1.0) for d in names]
    kept = cells.select("tokens", "p").cache()  # the bins bound its rows; lost parts are read again
    gram = kept.agg(*[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in k for j in k if i <= j]).collect()[0]
    g = [[(gram[f"g{min(i, j)}_{max(i, j)}"] or 0.0) * math.sqrt(weight[i] * weight[j]) for j in k] for i in k]
    largest = max((sum(abs(x) for x in line) for line in g), default=0.0)  # bounds the largest eigenvalue
    floor = F.lit(0.0) if keep_domain is None else F.when(p[names.index(keep_domain)] >= 0.5, 1.0).otherwise(0.0)
    steps: list[list[float]] = []  # of each step its slope by domain, and its momentum

    def state() -> Column:
        """Rates after all steps. The steps are data to one expression, so every round runs the same code."""
        done = F.from_json(F.lit(json.dumps(steps)), "array<array<double>>")
        start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"), F.lit(0.0).alias("turn"))

        def take(x: Column, step: Column) -> Column:
            along = sum((p[i] * step[i] for i in k), F.lit(0.0))
            rate = F.least(F.greatest(floor, x["ahead"] - along), F.lit(max_rate))
            return F.struct(rate.alias("rate"), (rate + step[len(names)] * (rate - x["rate"])).alias("ahead"), ((x["ahead"] - rate) * (rate - x["rate"])).alias("turn"))

        return F.aggregate(done, start, take)

    def totals() -> tuple[list[float], float]:
        s = F.col("s")
        sums = [F.sum(F.col("tokens") * p[i] * s["rate"]).alias(f"m{i}") for i in k]
        row = kept.withColumn("s", state()).agg(*sums, F.sum(F.col("tokens") * s["turn"]).alias("turn")).collect()[0]
        return [row[f"m{i}"] or 0.0 for i in k], row["turn"] or 0.0

    goal = [targets[d] for d in names]
    held, _ = totals()
    ahead, inertia, near, mark = held, 1.0, math.inf, 0
    for n in range(rounds):
        errors = [m - t for m, t in zip(held, goal, strict=True)]
        cost = sum(w * e * e for w, e in zip(weight, errors, strict=True))
        if cost < 0.99 * near:
            near, mark = cost, n
        if not largest or max(abs(e) * w for e, w in zip(errors, weight, strict=True)) < tolerance or n - mark >= patience:
            break
        steps.append([*[(m - t) * w / largest for m, t, w in zip(ahead, goal, weight, strict=True)], 0.0])
        last, (held, turn) = held, totals()
        if turn > 0:  # momentum leads uphill: start it anew
            inertia = 1.0
        else:
            grown = (1 + math.sqrt(1 + 4 * inertia * inertia)) / 2
            steps[-1][-1], inertia = (inertia - 1) / grown, grown
        ahead = [m + steps[-1][-1] * (m - b) for m, b in zip(held, last, strict=True)]
    kept.unpersist()
    return state()["rate"], dict(zip(names, held, strict=True))


def thinned(goal: dict[str, float], before: dict[str, float], thin: tuple[str, ...]) -> dict[str, float]:
    """Shares aimed at, where those of ``thin`` are at most ``THIN`` of the ones before and the others take what that frees."""
    low = {d: min(goal[d], THIN * before[d]) for d in goal if d in thin}
    rest = sum(t for d, t in goal.items() if d not in low)
    return {d: low[d] if d in low else (1 - sum(low.values())) * t / rest for d, t in goal.items()}


class Mixture:
    """A fitted mixture: rates and posteriors by feature cell, for the documents it was fitted on."""

    def __init__(self, names: list[str], rates: DataFrame, features: DataFrame, shares: tuple[dict[str, float], ...]):
        self.names, self.rates, self.features = names, rates, features
        #: Expected tokens of each domain, as parts of ``total``: at rate 1, aimed at, and at the fitted rates.
        self.before, self.goal, self.reached = shares

    def unmet(self) -> list[str]:
        """The domains whose target the fit did not reach, as when the bounds of the rates forbid it."""
        return [d for d in self.names if abs(self.reached[d] - self.goal[d]) > TOLERANCE * max(self.goal[d], TOLERANCE)]


def fit_mixture(
    docs: DataFrame,
    domains: DataFrame,
    targets: dict[str, float],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    total: float | None = None,
    thin: tuple[str, ...] = (),
    whole_rows: bool = False,
    **options,
) -> Mixture:
    """Fit posteriors and rates. ``domains`` has (id, domain); ``targets`` the share of each domain.

    ``total`` is the number of expected tokens, by default the tokens of ``docs``. The target of a
    domain of ``thin`` is at most ``THIN`` of its expected share in ``docs``; what that frees goes to
    the other domains. A target that is not reached is logged, with what is. Other options are those
    of ``fit_rates``.

    The features of each row are computed once and written; with ``whole_rows`` the row itself
    stands beside them, under a number of its own. Null ids and domains teach nothing; an id
    labelled twice counts for each label; without labels all posteriors are even. A null text is
    empty: no tokens, rated like other empty ones. Rows and ids may repeat. Empty ``docs`` give
    empty results; columns of any name or type may stand beside the id and the text.
    """
    names = sorted(targets)
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    known = domains.select(F.col(id_col).alias("id"), F.col("domain")).where(F.col("id").isNotNull() & F.col("domain").isin(*names)).distinct()
    lexicons = learn_lexicons(docs, known, names, text_col=text_col, id_col=id_col)
    row = F.col(PREFIX + "row")
    f, sizes = feature_bins(row[text_col], lexicons)
    carried = [row, F.monotonically_increasing_id().alias("rid")] if whole_rows else []
    features = wrap(docs if whole_rows else docs.select(id_col, text_col)).select(row[id_col].alias("id"), f.alias("f"), *carried)
    features = materialize(features.select("id", "f.tokens", "f.cell", *[PREFIX + "row", "rid"] * whole_rows), "mixing-features")
    labelled = features.select("id", "cell").join(known, "id").groupBy("domain", "cell").agg(F.count("*").alias("n"))
    sums = features.groupBy("cell").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    p = posteriors(labelled, names, sizes, F.col("cell"))
    cells = sums.select("cell", "tokens", "docs", p.alias("p")).coalesce(math.ceil(math.prod(sizes) / CELLS_AT_ONCE))
    cells = materialize(cells, "mixing-cells")
    expected = [F.sum(F.col("tokens") * F.element_at("p", i + 1)) for i in range(len(names))]
    held = cells.agg(F.sum("tokens"), *expected).collect()[0]
    tokens = total if total is not None else float(held[0] or 0)
    share = lambda by_domain: {d: by_domain[d] / tokens if tokens else 0.0 for d in names}
    before = share({d: held[i + 1] or 0.0 for i, d in enumerate(names)})
    goal = thinned({d: t / sum(targets.values()) for d, t in targets.items()}, before, thin)
    rate, found = fit_rates(cells, names, {d: tokens * t for d, t in goal.items()}, **options)
    mixture = Mixture(names, cells.select("cell", "p", rate.alias("rate"), "tokens", "docs"), features, (before, goal, share(found)))
    if tokens and mixture.unmet():
        log.warning("mixing: targets of %s are not reached: before %s, aimed at %s, reached %s", ", ".join(mixture.unmet()), before, goal, mixture.reached)
    return mixture


def document_rates(mixture: Mixture, *, id_col: str = "doc_id") -> DataFrame:
    """One row ``(id, n_tokens, p_<domain>..., rate)`` for each document of the fit, null ids and repeated rows included.

    The cells are bounded by the bins, so their rates may be broadcast.
    """
    joined = mixture.features.select("id", "tokens", "cell").join(F.broadcast(mixture.rates.select("cell", "p", "rate")), "cell")
    by_domain = [F.element_at("p", i + 1).alias(f"p_{d}") for i, d in enumerate(mixture.names)]
    return joined.select(F.col("id").alias(id_col), F.col("tokens").alias("n_tokens"), *by_domain, "rate")


def mix(
    docs: DataFrame,
    domains: DataFrame,
    targets: dict[str, float],
    *,
    text_col: str = "text",
    keep_domain: str | None = None,
    seed: int = 42,
    **options,
) -> DataFrame:
    """``docs`` with each row as often as its rate says, with all columns: the mixture itself.

    A rate of r gives floor(r) copies and one more with probability r - floor(r), drawn by a
    seeded hash of the row's own number, so repeated rows are drawn each for itself. Rows that
    most likely belong to ``keep_domain`` have rates of one or more. Null ids and texts are rows
    like others; empty ``docs`` give no rows; columns may have any name and type.
    """
    mixture = fit_mixture(docs, domains, targets, text_col=text_col, keep_domain=keep_domain, whole_rows=True, **options)
    row = F.col(PREFIX + "row")
    found = mixture.features.select(row, "rid", "cell").join(F.broadcast(mixture.rates.select("cell", "rate")), "cell")
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("rid")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (u < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    each = F.explode(F.sequence(F.lit(1), F.greatest(copies, F.lit(1)))).alias("copy")
    repeated = found.select(row, each, copies.alias("copies")).where(F.col("copy") <= F.col("copies"))
    return repeated.select(*unwrap(docs.columns, []))
