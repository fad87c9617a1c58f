"""Quality filtering by learned decision lists.

Features are per-word and per-line rates of a text, computed with built-in expressions.
Learning joins a bounded sample of labels (``SAMPLE_ROWS`` rows of least hash of doc_id)
to their documents, cuts every feature at quantiles, and counts labelled rows per
combination of bins: these statistics, at most one row per sampled label, are all that
leaves the cluster. Sequential covering then grows one rule after the other: conditions
``feature >= t`` or ``feature < t`` are added by FOIL gain on two thirds of the rows and
pruned from the end on the other third; a rule is kept if it is precise on both. The list
becomes one ordered CASE expression; rows that no rule covers are kept.

Null texts have no words. doc_id may be null or repeated; every row is judged by itself.
Without labels there are no rules, and only the base rule applies. Columns of docs named
like a result are replaced by it; others stay. An empty table stays empty. Of cuts with
equal gain the first by feature and threshold counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that are learned from, at most.
SAMPLE_ROWS = 20_000
#: Cuts per feature, at most.
CUTS = 24
RULES, CONDITIONS = 12, 3
#: Share of rows that a rule covers that must be bad, and how many it must cover.
PRECISION, SUPPORT = 0.95, 4

# What parts words, and the symbols counted.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_HASH = "xxhash64({words})"
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
FEATURES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def word_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the rates in ``FEATURES`` (double)."""
    text = F.coalesce("text", F.lit(""))
    bare = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    # a generator holds its array for the expressions above: filters on a feature, pushed down, would else split the text again for every word
    wide = docs.select("*", F.explode_outer(F.array(F.struct(F.when(bare == "", none).otherwise(F.split(bare, _SPLIT)).alias("words"), lines.alias("lines")))).alias("__held"))
    wide = wide.withColumns({"__words": F.col("__held.words"), "__lines": F.col("__held.lines")}).drop("__held")
    n = F.size("__words").cast("long")
    counted = wide.withColumns({
        "n_words": n,
        "n_lines": F.size("__lines").cast("long"),
        "word_chars": _without(text, SPACES).cast("long"),
        "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__upper": F.length(text) - _without(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "__digits": F.length(text) - _without(text, "0123456789"),
        "__marks": F.length(text) - _without(text, "!?"),
        # low bits of a window's key are its place, so one sort of longs brings equal windows together
        "__low": F.expr("shiftleft(1L, 1 + CAST(ceil(log2(size(__words) + 1)) AS int)) - 1"),
    })
    window = "get(__words, CAST({i} AS int)), get(__words, CAST({i} AS int) + 1), get(__words, CAST({i} AS int) + 2)"
    hashed = _HASH.format(words=window.format(i="i"))
    sorted_keys = counted.withColumn("__keys", F.expr(f"explode_outer(array(CASE WHEN n_words < 3 THEN CAST(array() AS array<bigint>) ELSE sort_array(transform(sequence(0L, n_words - 3), i -> ({hashed} & ~__low) | i)) END))"))
    meets = "coalesce((x ^ get({of}, i {j} 1)) BETWEEN 0 AND __low, false)"
    near = sorted_keys.withColumn("__near", F.expr(f"explode_outer(array(filter(__keys, (x, i) -> {meets.format(of='__keys', j='-')} OR {meets.format(of='__keys', j='+')})))"))
    # windows of equal hashes are compared word by word; if any differ, the text's windows are sorted as they are
    unlike = f"size(filter(__near, (x, i) -> {meets.format(of='__near', j='-')} AND struct({window.format(i='(x & __low)')}) <> struct({window.format(i='(get(__near, i - 1) & __low)')}))) > 0"
    plain = f"sort_array(transform(sequence(0L, n_words - 3), i -> named_struct('w', concat_ws(' ', {window.format(i='i')}), 'i', i)))"
    exact = f"flatten(transform(array({plain}), s -> transform(filter(s, (x, i) -> coalesce(x.w = get(s, i - 1).w, false) OR coalesce(x.w = get(s, i + 1).w, false)), x -> x.i)))"
    twins = near.withColumn("__twins", F.expr(f"sort_array(CASE WHEN {unlike} THEN {exact} ELSE transform(__near, x -> x & __low) END)"))
    repeats = twins.withColumn("n_repeat_words", F.expr("aggregate(__twins, named_struct('last', -3L, 'n', 0L), (a, p) -> named_struct('last', p, 'n', a.n + least(3L, p - a.last)), a -> a.n)"))
    words, kept = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    rates = repeats.withColumns({
        "word_length": F.col("word_chars") / words,
        "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / words,
        "upper_rate": F.col("__upper") / kept,
        "digit_rate": F.col("__digits") / kept,
        "mark_rate": F.col("__marks") / words,
    })
    return rates.drop("__words", "__lines", "__upper", "__digits", "__marks", "__low", "__keys", "__near", "__twins")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.at_least else F.col(self.feature) < self.threshold


Rule = tuple[Condition, ...]
#: Bins of the features, good and bad rows, in grow set or not.
_Cell = tuple[tuple[int, ...], int, int, bool]


def _covers(test: tuple[int, bool, int], bins: tuple[int, ...]) -> bool:
    feature, at_least, cut = test
    return (bins[feature] >= cut) == at_least


def _count(rule: list[tuple[int, bool, int]], cells: list[_Cell], grow: bool) -> tuple[int, int]:
    good = bad = 0
    for bins, g, b, own in cells:
        if own == grow and all(_covers(t, bins) for t in rule):
            good, bad = good + g, bad + b
    return good, bad


def _grow(cells: list[_Cell], cuts: list[list[float]]) -> list[tuple[int, bool, int]]:
    """Conditions added while they gain, on the grow set."""
    rule: list[tuple[int, bool, int]] = []
    rest = [c for c in cells if c[3]]
    while len(rule) < CONDITIONS:
        good, bad = sum(c[1] for c in rest), sum(c[2] for c in rest)
        if not good or not bad:
            break
        base, best = log2(bad / (bad + good)), (1e-9, None)
        for f, own in enumerate(cuts):
            sums: dict[int, list[int]] = {}
            for bins, g, b, _ in rest:
                x = sums.setdefault(bins[f], [0, 0])
                x[0], x[1] = x[0] + g, x[1] + b
            for cut in range(1, len(own) + 1):
                low = [sum(x[k] for v, x in sums.items() if v < cut) for k in (0, 1)]
                for at_least, (g, b) in ((False, low), (True, [good - low[0], bad - low[1]])):
                    if b:
                        gain = b * (log2(b / (b + g)) - base)
                        best = max(best, (gain, (f, at_least, cut)), key=lambda x: x[0])
        if best[1] is None:
            break
        rule.append(best[1])
        rest = [c for c in rest if _covers(best[1], c[0])]
    return rule


def cover(cells: list[_Cell], cuts: list[list[float]]) -> list[Rule]:
    """Rules for bad rows, in order, by sequential covering."""
    rules: list[Rule] = []
    while len(rules) < RULES:
        rule = _grow(cells, cuts)
        if not rule:
            break
        worth = []
        for size in range(1, len(rule) + 1):
            good, bad = _count(rule[:size], cells, grow=False)
            worth.append(((bad - good) / (bad + good) if bad + good else -1.0, -size))
        rule = rule[: -max(worth)[1]]
        good, bad = (sum(x) for x in zip(_count(rule, cells, True), _count(rule, cells, False)))
        if bad < SUPPORT or bad < PRECISION * (bad + good):
            break
        rules.append(tuple(Condition(FEATURES[f], at_least, cuts[f][cut - 1]) for f, at_least, cut in rule))
        cells = [c for c in cells if not all(_covers(t, c[0]) for t in rule)]
    return rules


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """A decision list for bad rows from labels (doc_id, quality: 0 bad, 1 good)."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = word_features(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    rows = rows.where("n_words >= 50 AND 2 * n_repeat_words <= n_words").select("doc_id", "quality", *FEATURES).persist()
    try:
        # quantiles of the values above zero: a rare feature is zero on most rows, and its least value counts most
        share = [k / CUTS for k in range(CUTS + 1)]
        found = rows.agg(*(F.percentile_approx(F.when(F.col(f) > 0, F.col(f)), share, 2000).alias(f) for f in FEATURES)).first()
        # a cut halfway to the next quantile keeps thresholds off the values themselves
        cuts = []
        for f in FEATURES:
            values = sorted({0.0, *(found[f] or [])})
            cuts.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        bins = [sum(((F.col(f) >= c).cast("int") for c in own), F.lit(0)).alias(f) for f, own in zip(FEATURES, cuts)]
        grow = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0).alias("grow")
        stats = rows.select(*bins, grow, "quality").groupBy(*FEATURES, "grow").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        cells = [(tuple(x[f] for f in FEATURES), x["good"], x["bad"], x["grow"]) for x in stats.orderBy(*FEATURES, "grow").collect()]  # bounded by sample_rows
        return cover(cells, cuts)
    finally:
        rows.unpersist()


def verdict(rules: list[Rule]) -> Column:
    """The list as an ordered conditional expression: true is kept."""
    out = None
    for rule in rules:
        covered = F.lit(True)
        for c in rule:
            covered = covered & c.column()
        out = F.when(covered, False) if out is None else out.when(covered, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with the features, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return word_features(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
