"""Quality rules with risk-controlled cutoffs.

Each rule rejects a text whose measure lies beyond a cutoff. The rules are tightened together: rule set l takes the l-th least rejecting cutoff of
every rule's fixed grid, so the sets are nested and each rejects what the one before it does. Cutoffs come from labelled holdouts: for
every stratum (language) and rule set, the distinct texts that any of its rules rejects among those labelled good are counted over all labelled rows (copies are no further evidence). A set is
admissible if the exact (Clopper-Pearson) upper confidence bound of its false rejection rate stays within `risk`. The sets of a stratum are tested in their
fixed order up to the first that fails, which needs no correction within the sequence; the confidence level is divided by the number of
sequences (strata). So with probability 1 - delta the rules together reject at most `risk` of the good texts of every stratum at once. A stratum with too few
labels gets no cutoff.

Defined results: a null or empty text has no words and fails the base rule; a null language is a stratum of
its own; repeated ids and equal texts of a stratum count once as labels (the lowest label wins), so that repeating rows certifies nothing, and each row gets its own
verdict; without labels only the base rule acts; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import cut, enter, free_name, trim, with_ids
from graphloom.llm.textstats import NAMES, text_stats

RISK, DELTA = 0.05, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Rule -> (measure as SQL over the statistics, cutoffs from the most to the least rejecting). A text is rejected if its measure is above the cutoff.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.25)),
    "capitals": ("n_upper / greatest(n_upper + n_lower, 1)", (0.1, 0.2, 0.3, 0.5, 0.7)),
    "bangs": ("n_bangs / greatest(n_words, 1)", (0.05, 0.1, 0.2, 0.5)),
    "long_words": ("word_chars / greatest(n_words, 1)", (9.0, 11.0, 14.0, 20.0, 40.0)),
}
#: Rule sets, from the least rejecting: set l has a rule's l-th least rejecting cutoff (its most rejecting one once the grid ends).
SETS: tuple[dict[str, float], ...] = tuple({name: grid[max(0, len(grid) - 1 - l)] for name, (_, grid) in RULES.items()} for l in range(max(len(g) for _, g in RULES.values())))
STATS_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])


@F.arrow_udf(STATS_TYPE)
def stats_of(text: pa.Array) -> pa.Array:
    enter()
    s = text_stats(text)
    trim()
    return pa.StructArray.from_arrays([pa.array(s[n]) for n in NAMES], names=list(NAMES))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k), X ~ Binomial(n, p), summed downwards from k until the rest is negligible."""
    if k >= n:
        return 1.0
    total, i = 0.0, k
    log_q, log_p = math.log1p(-p), math.log(p)
    top = None
    while i >= 0:
        j = np.arange(i, max(-1, i - 4096), -1, dtype=float)
        # log terms by the ratio of neighbours, anchored at the first of the block
        first = math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q
        steps = np.concatenate([[0.0], np.cumsum(np.log(j[:-1]) - np.log(n - j[:-1] + 1) + log_q - log_p)])
        terms = np.exp(first + steps)
        total += float(terms.sum())
        top = float(terms[-1]) if top is None or terms[-1] <= top else top
        if terms[-1] < total * 1e-18 and steps[-1] <= steps[0]:
            break
        i -= 4096
    return min(1.0, total)


def certified(rejected: int, good: int, limit: float, level: float) -> bool:
    """Whether the exact upper bound at confidence 1 - level of the rate is at most limit."""
    return good > 0 and rejected < good * limit and binomial_cdf(rejected, good, limit) <= level


@dataclass(frozen=True)
class Cutoffs:
    """Stratum -> rule -> cutoff; evidence: stratum, rule set, good texts, those rejected, whether certified."""

    by_stratum: dict[str | None, dict[str, float]]
    evidence: list[tuple]

    def rejects(self, stratum: Column, stats: str) -> Column:
        """True for texts beyond a cutoff of their stratum."""
        out = F.lit(False)
        for name, (measure, _) in RULES.items():
            value = _measure(measure, stats)
            groups: dict[float, list] = {}
            for s, rules in self.by_stratum.items():
                if name in rules:
                    groups.setdefault(rules[name], []).append(s)
            for cutoff, strata in sorted(groups.items()):
                here = stratum.isin([s for s in strata if s is not None])
                here = F.coalesce(here, F.lit(False)) | (stratum.isNull() if None in strata else F.lit(False))
                out = out | (here & (value > F.lit(cutoff)))
        return out


def _measure(sql: str, stats: str) -> Column:
    for n in sorted(NAMES, key=len, reverse=True):
        sql = sql.replace(n, f"{stats}.{n}")
    return F.expr(sql)


def marks_of(labels: DataFrame) -> DataFrame:
    """doc_id, quality: one row a labelled id; the lowest label wins."""
    return labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """measured: doc_id, stratum, text_id, stats. Counts over every labelled row, equal texts of a stratum once; one row per stratum reaches the driver."""
    counts = [F.count(F.lit(1)).alias("good")]
    for i, cutoffs in enumerate(SETS):
        hit = F.lit(False)
        for name, c in cutoffs.items():
            hit = hit | (_measure(RULES[name][0], "stats") > F.lit(c))
        counts.append(F.count_if(hit).alias(f"set_{i}"))
    texts = measured.join(marks_of(labels), "doc_id").groupBy("stratum", "text_id").agg(F.min("quality").alias("quality"), F.min("stats").alias("stats"))
    rows = texts.where("quality = 1").groupBy("stratum").agg(*counts).collect()
    chosen: dict[str | None, dict[str, float]] = {}
    evidence = []
    for r in rows:
        chosen[r["stratum"]] = {}
        for i, cutoffs in enumerate(SETS):
            ok = certified(r[f"set_{i}"], r["good"], risk, delta / len(rows))
            evidence.append((r["stratum"], i, r["good"], r[f"set_{i}"], ok))
            if not ok:
                break
            chosen[r["stratum"]] = cutoffs
    return Cutoffs(chosen, evidence)


def base_failed(stats: str) -> Column:
    return (F.col(f"{stats}.n_words") < MIN_WORDS) | (100 * F.col(f"{stats}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{stats}.n_words"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, text_id, stats of each row; equal texts have equal text_id."""
    return docs.select("doc_id", F.col("lang").alias("stratum"), F.md5(F.coalesce("text", F.lit(""))).alias("text_id"), stats_of("text").alias("stats"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum: one row per document."""
    measured = cut(measure(docs))
    cutoffs = fit_cutoffs(measured, labels, risk, delta)
    failed = base_failed("stats")
    return measured.select("doc_id", *[F.col(f"stats.{n}").alias(n) for n in NAMES[:5]], failed.alias("base_failed"), (~failed & ~cutoffs.rejects(F.col("stratum"), "stats")).alias("kept"), "stratum")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs, with their columns, that pass; labelled texts are read once for the counts, and every text once for the verdicts."""
    cutoffs = fit_cutoffs(measure(with_ids(docs.select("doc_id", "lang", "text"), marks_of(labels))), labels, risk, delta)
    stats = free_name(docs, "__stats")
    return docs.withColumn(stats, stats_of("text")).where(~base_failed(stats) & ~cutoffs.rejects(F.col("lang"), stats)).drop(stats)
