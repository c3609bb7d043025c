"""Quality rules as a learned decision list.

Statistics of every text are plain Spark expressions. A bounded sample of labelled rows teaches an
ordered list of threshold conjunctions by sequential covering: each rule is grown on two thirds of the
sample, pruned on the rest, and the rows it covers are taken away before the next. The list becomes one
Spark ``CASE`` expression.

Null and empty texts have no words: all counts are 0 and the base check fails. Repeated rows are judged
alike, an empty table gives an empty result, and columns besides ``doc_id`` and ``text`` are not read.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenceline.llm import common

#: Labelled rows that teach the list, chosen by hash.
SAMPLE_ROWS = 6000
#: Share of bad rows that a rule must have on the pruning rows.
PRECISION = 0.97
MAX_RULES = 12
MAX_CONDITIONS = 4
WINDOW = 5

#: Statistics that do not grow with the length of a text; the rules test these.
FEATURES = (
    "mean_word_chars",
    "symbols_per_word",
    "duplicate_line_share",
    "repeated_word_share",
    "upper_share",
    "digit_share",
    "punctuation_share",
    "distinct_word_share",
    "words_per_line",
)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.value if self.above else c <= self.value

    def holds(self, x: np.ndarray) -> np.ndarray:
        """Which rows of a matrix of FEATURES it holds for."""
        values = x[:, FEATURES.index(self.feature)]
        return values > self.value if self.above else values <= self.value

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.value:g}"


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts and shares of each whole text in added columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    stripped = F.translate(text, common.SPACE_CHARS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, common.SPACE_CHARS, "") != "")
    # A 64-bit hash stands for a window: within one text two windows never share one by chance.
    windows = F.slice(
        F.transform("_words", lambda w, i: F.xxhash64(w, *[F.get("_words", i + k) for k in range(1, WINDOW)])),
        1,
        F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)),
    )
    out = docs.withColumns({"_words": common.words(F.col("text")), "_lines": lines, "_stripped": stripped})
    out = out.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length("_stripped").cast("long"),
            "n_symbols": F.regexp_count("_stripped", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_upper": F.regexp_count("_stripped", F.lit(r"\p{Lu}")),
            "_digit": F.regexp_count("_stripped", F.lit(r"[0-9]")),
            "_punctuation": F.regexp_count("_stripped", F.lit(r"[!?;:\"'()\[\]{}/\\=_~^@+-]")),
            "_distinct": F.size(F.array_distinct("_words")),
            "_windows": windows,
        }
    )
    # Only a text that repeats a window has its windows sorted.
    out = out.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twice = F.filter(
        "_sorted",
        lambda e, j: (F.when(j > 0, F.get("_sorted", j - 1)["h"]) == e["h"]).eqNullSafe(True)
        | (F.get("_sorted", j + 1)["h"] == e["h"]).eqNullSafe(True),
    )
    out = out.withColumn("_at", F.sort_array(F.transform(twice, lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", j + 1) - p, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    # The test of the partition id is always true. It keeps later filters above this column; pushed below
    # it, they would copy the arrays into their own lambdas and evaluate them once per element.
    counted = F.when(F.spark_partition_id() >= 0, F.coalesce(covered, F.lit(0)))
    out = out.withColumn("n_repeat_words", counted.cast("long"))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines_n = F.greatest(F.col("n_lines"), F.lit(1))
    return out.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbols_per_word": F.col("n_symbols") / words,
            "duplicate_line_share": F.col("n_dup_lines") / lines_n,
            "repeated_word_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("_upper") / chars,
            "digit_share": F.col("_digit") / chars,
            "punctuation_share": F.col("_punctuation") / chars,
            "distinct_word_share": F.col("_distinct") / words,
            "words_per_line": F.col("n_words") / lines_n,
        }
    ).drop("_words", "_lines", "_stripped", "_upper", "_digit", "_punctuation", "_distinct", "_windows", "_sorted", "_at")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list[dict]:
    """At most ``rows`` labelled documents with their statistics, chosen by the hash of their id."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("quality").alias("_quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `rows` small rows
    found = statistics(found).where(~base_failed()).select("doc_id", "_quality", *FEATURES)
    return [r.asDict() for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()]


def _thresholds(values: np.ndarray) -> list[float]:
    return sorted({float(v) for v in np.quantile(values, np.linspace(0, 1, 41), method="lower")})


def _gain(bad: np.ndarray, good: np.ndarray, bad_before: int, good_before: int) -> np.ndarray:
    """Information gained per bad row that stays covered."""
    share = np.log2(np.maximum(bad, 1e-9) / np.maximum(bad + good, 1e-9))
    return bad * (share - np.log2(bad_before / (bad_before + good_before)))


def _grow(x: np.ndarray, bad: np.ndarray) -> list[Condition]:
    """Add the condition of largest gain until no good row is covered."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and bad.any() and not bad.all():
        best, best_gain = None, 1e-9
        for k, feature in enumerate(FEATURES):
            cuts = np.array(_thresholds(x[:, k]))
            above = x[:, k][:, None] > cuts
            for side, inside in ((True, above), (False, ~above)):
                b, g = (inside & bad[:, None]).sum(0), (inside & ~bad[:, None]).sum(0)
                gain = _gain(b, g, int(bad.sum()), int((~bad).sum()))
                if gain.max() > best_gain:
                    best, best_gain = Condition(feature, side, float(cuts[gain.argmax()])), float(gain.max())
        if best is None:
            break
        rule.append(best)
        held = best.holds(x)
        x, bad = x[held], bad[held]
    return rule


def _covered(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(x) for c in rule])


def learn(rows: list[dict]) -> list[list[Condition]]:
    """Sequential covering: an ordered list of conjunctions, each of which says "bad"."""
    x = np.array([[r[f] for f in FEATURES] for r in rows], dtype=float).reshape(-1, len(FEATURES))
    bad = np.array([r["_quality"] == 0 for r in rows], dtype=bool)
    pruning = np.arange(len(rows)) % 3 == 0
    rules: list[list[Condition]] = []
    while len(rules) < MAX_RULES:
        rule = _grow(x[~pruning], bad[~pruning])
        if not rule:
            break

        def worth(r):
            inside = bad[_covered(r, x) & pruning]
            return (inside.sum() + 1) / (len(inside) + 2)

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        covered = _covered(rule, x)
        if bad[covered].sum() < 5 or bad[covered].mean() < PRECISION:
            break
        rules.append(rule)
        x, bad, pruning = x[~covered], bad[~covered], pruning[~covered]
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The ordered list as one expression: the first rule that holds decides, otherwise keep."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with statistics, ``base_failed`` and ``kept``."""
    rules = learn(labelled_sample(docs, labels, sample_rows))
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text"), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged."""
    packed = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return judge(packed, labels).where("kept").select("_row.*")
