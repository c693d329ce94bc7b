"""Quality rules: statistics of whole texts as SQL functions, and an ordered list of learned threshold rules.

The rules come from sequential covering: a rule grows by the condition that
gains most information about bad documents, is cut back on rows it has not
seen, and what it covers is set aside before the next one.  Learning takes a
bounded sample of labelled statistics; the result is one conditional
expression over columns, so filtering stays in Spark's own functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that rules are learned from, at most; those of smallest identifier hash.
SAMPLE = 20_000
#: Words in a window of the repetition count.
WINDOW = 8

_SEPARATORS = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that it is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """How many words lie in a window of 8 words that the list holds twice or more."""
    def covered(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = lambda s: F.array_sort(F.transform(F.filter(s, lambda x, k: (
            (k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"]))
        gaps = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
        return _let(pairs, lambda s: _let(places(s), gaps))

    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW),
                              lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(WINDOW))))
        return _let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))

    return F.when(F.size(words) < WINDOW, 0).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


#: Names of the statistics, in order.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_echoes")


def with_stats(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """The input and one long column for each of ``STATS``; a null text counts as empty.

    Words are runs of characters other than space and tab to carriage return.
    ``prefix`` keeps the new names apart from columns of the input.
    """
    words, text = f"{prefix}__words", f"{prefix}__t"
    df = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(F.col(text), _SEPARATORS), ""))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeated(F.col(words)),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_marks": F.regexp_count(text, F.lit(r"[!?]")),
        "n_echoes": _let(F.col(words), lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (F.get(w, i - 1) == x)))),
    }
    df = df.withColumns({prefix + n: c.cast("long") for n, c in made.items()})
    return df.drop(words, text)


#: What conditions may speak of, as (name, numerator, denominator); shares are by word or by character of words.
MEASURES = (
    ("words", "n_words", None), ("chars_per_word", "word_chars", "n_words"), ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_lines_per_word", "n_dup_lines", "n_words"), ("repeated_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "word_chars"), ("marks_per_word", "n_marks", "n_words"),
    ("echo_share", "n_echoes", "n_words"),
)


def _measure(name: str, prefix: str) -> Column:
    top, bottom = next((t, b) for n, t, b in MEASURES if n == name)
    return F.col(prefix + top).cast("double") if bottom is None else (
        F.col(prefix + top) / F.greatest(F.col(prefix + bottom), F.lit(1)))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (measure, above, threshold); a document that meets all of it is bad."""

    conditions: tuple[tuple[str, bool, float], ...]
    precision: float = 1.0

    def column(self, prefix: str = "") -> Column:
        out = F.lit(True)
        for name, above, limit in self.conditions:
            value = _measure(name, prefix)
            out = out & ((value > limit) if above else (value <= limit))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {'>' if above else '<='} {limit:g}" for n, above, limit in self.conditions)


@dataclass
class RuleLearner:
    """Sequential covering over a matrix of measures.

    ``thresholds`` cut points for each measure, ``max_conditions`` and
    ``max_rules`` bound the list, a rule needs ``min_precision`` on all rows
    still uncovered and ``min_cover`` bad rows.
    """

    thresholds: int = 64
    max_conditions: int = 4
    max_rules: int = 12
    min_precision: float = 0.97
    min_cover: int = 8
    names: Sequence[str] = field(default_factory=lambda: [n for n, _, _ in MEASURES])

    def fit(self, values: np.ndarray, bad: np.ndarray, grow: np.ndarray) -> list[Rule]:
        """Rules in order; ``grow`` marks the rows rules grow on, the others prune them."""
        left = np.ones(len(bad), bool)
        rules: list[Rule] = []
        while len(rules) < self.max_rules and (bad & left & grow).sum() >= self.min_cover:
            conditions = self._prune(self._grow(values, bad, left & grow), values, bad, left & ~grow)
            hit = self._covers(conditions, values) & left
            share = (bad & hit).sum() / max(hit.sum(), 1)
            if not conditions or share < self.min_precision or (bad & hit).sum() < self.min_cover:
                break
            rules.append(Rule(tuple((self.names[m], above, limit) for m, above, limit in conditions), float(share)))
            left &= ~hit
        return rules

    def _covers(self, conditions, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        for m, above, limit in conditions:
            out &= (values[:, m] > limit) if above else (values[:, m] <= limit)
        return out

    def _grow(self, values: np.ndarray, bad: np.ndarray, rows: np.ndarray) -> list[tuple[int, bool, float]]:
        chosen: list[tuple[int, bool, float]] = []
        while len(chosen) < self.max_conditions:
            p0, n0 = int((rows & bad).sum()), int((rows & ~bad).sum())
            if not p0 or not n0:
                break
            now, best = math.log2(p0 / (p0 + n0)), (0.0, None)
            for m in range(values.shape[1]):
                for limit in np.unique(np.quantile(values[rows & bad, m], np.linspace(0, 1, self.thresholds))):
                    for above in (True, False):
                        hit = rows & ((values[:, m] > limit) if above else (values[:, m] <= limit))
                        p = int((hit & bad).sum())
                        if p >= self.min_cover / 2:
                            gain = p * (math.log2(p / hit.sum()) - now)
                            if gain > best[0] + 1e-9:
                                best = gain, (m, above, float(limit))
            if best[1] is None:
                break
            chosen.append(best[1])
            rows = rows & self._covers([best[1]], values)
        return chosen

    def _prune(self, chosen, values: np.ndarray, bad: np.ndarray, rows: np.ndarray):
        def worth(k: int) -> float:
            hit = self._covers(chosen[:k], values) & rows
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0
        return chosen[:max(range(1, len(chosen) + 1), key=lambda k: (worth(k), -k))] if chosen else chosen


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", sample: int = SAMPLE, learner: RuleLearner | None = None) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents (label 0: bad), chosen by the hash of their identifier.

    Rows without identifier or label are not used; no labelled rows give no rules.
    """
    picked = (labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label"))
              .where("__id IS NOT NULL AND __label IS NOT NULL")
              .orderBy(F.xxhash64("__id"), "__id").limit(sample))
    # The sample is bounded by its own limit.
    rows = (with_stats(docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
                       .join(F.broadcast(picked), F.col("__doc") == F.col("__id")), "__text", "__s_")
            .select("__label", F.pmod(F.xxhash64("__doc", F.lit("prune")), F.lit(3)).alias("fold"),
                    *(_measure(n, "__s_").alias(n) for n, _, _ in MEASURES)).collect())
    if not rows:
        return []
    table = np.array([tuple(r) for r in rows], float)
    table = table[np.lexsort(table.T)]  # the order of arrival must not matter
    return (learner or RuleLearner()).fit(table[:, 2:], table[:, 0] == 0, table[:, 1] != 0)


def base_failed(prefix: str = "") -> Column:
    """Under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))


def verdict(rules: Sequence[Rule], prefix: str = "") -> Column:
    """Number of the first rule that a document meets, from 1; null where it meets none."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule.column(prefix), k) if out is None else out.when(rule.column(prefix), k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judge(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", prefix: str = "") -> DataFrame:
    """The input, its statistics, ``base_failed``, ``rule`` (first met) and ``kept``, under ``prefix``."""
    df = with_stats(docs, text_col, prefix)
    return (df.withColumn(prefix + "base_failed", base_failed(prefix))
            .withColumn(prefix + "rule", F.when(~F.col(prefix + "base_failed"), verdict(rules, prefix)))
            .withColumn(prefix + "kept", ~F.col(prefix + "base_failed") & F.col(prefix + "rule").isNull()))
