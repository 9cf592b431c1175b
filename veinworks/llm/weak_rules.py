"""Quality rules by weak supervision, in native DataFrame functions.

Each rule votes for (1), against (-1) or abstains (0). Documents are counted by
their pattern of votes, which is all that expectation-maximisation needs: at
most 3 ** len(RULES) counts reach the driver, however many documents there are.
It estimates each rule's accuracy and the share of good documents, rules taken
as independent given the truth. A document's posterior probability of being good
then decides, in place of passing every rule; it is a sum of log-odds in SQL.

No Python code runs on executors: splitting, window hashes, sorting and counting
are built-in array functions within a row, so nothing is exploded or shuffled but
the pattern counts. Three-word windows are compared by xxhash64.

Defined cases: null text has no words; words are runs of anything but the six
ASCII separators; a window needs three words; rules whose measure has no base
(no words, no lines) abstain; documents that fail the base are not kept and do
not take part in the estimate; an empty table gives an empty result; repeated
rows are judged each; other columns pass by untouched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEPARATOR_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Working columns are prefixed, so that a table's own columns cannot clash.
P = "__q_"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_ended_lines", "n_distinct_words", "n_marked_words", "n_capitals", "n_chars_all"]
#: Estimates keep within these.
ON_GOOD, PRIOR = (0.55, 0.995), (0.05, 0.95)
#: First belief that a document is good: if a rule votes against it, if none does.
START = {False: 0.1, True: 0.98}


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with BASE and MORE counts (long, prefixed P)."""
    c = lambda name: F.col(P + name)
    others = [x for x in df.columns if x != text]
    zero = F.lit(0).cast("long")
    step = df.select(*others, F.coalesce(F.col(text).cast("string"), F.lit("")).alias(P + "text"))
    step = step.withColumns({P + "words": F.array_remove(F.split(c("text"), SEPARATOR_RUN), ""), P + "lines": F.filter(F.split(c("text"), "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")})
    n = F.size(c("words"))
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(c("words"), i), F.get(c("words"), i + 1), F.get(c("words"), i + 2)))).otherwise(F.array().cast("array<bigint>"))
    less = lambda chars: F.length(c("text")) - F.length(F.translate(c("text"), chars, ""))
    ended = F.filter(c("lines"), lambda x: F.rlike(x, F.lit(r"[.!?:;\"')\]»”…]\s*$")))
    step = step.select(
        *others,
        n.cast("long").alias(P + "n_words"),
        (F.length(c("text")) - less(" \t\n\x0b\x0c\r")).cast("long").alias(P + "word_chars"),
        less(SYMBOLS).cast("long").alias(P + "n_symbols"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias(P + "n_dup_lines"),
        F.size(c("lines")).cast("long").alias(P + "n_lines"),
        F.size(ended).cast("long").alias(P + "n_ended_lines"),
        F.size(F.array_distinct(c("words"))).cast("long").alias(P + "n_distinct_words"),
        F.size(F.filter(c("words"), lambda w: F.rlike(w, F.lit("[#*$%&|<>]")))).cast("long").alias(P + "n_marked_words"),
        less(CAPITALS).cast("long").alias(P + "n_capitals"),
        F.length(c("text")).cast("long").alias(P + "n_chars_all"),
        windows.alias(P + "windows"),
    )
    # Only texts with a repeated window are sorted: equal hashes become
    # neighbours, and the words of their windows are counted once.
    ordered = F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        hit = F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k + 1)["h"]) | (x["h"] == F.get(s, k - 1)["h"]), x["i"])), lambda i: i.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(hit, lambda i: F.array(i, i + 1, i + 2)))))

    repeated = F.get(F.transform(F.array(ordered), covered), F.lit(0))
    step = step.withColumn(P + "n_repeat_words", F.when(F.size(F.array_distinct(c("windows"))) == F.size(c("windows")), zero).otherwise(repeated.cast("long")))
    return step.drop(P + "windows")


def c(name: str) -> Column:
    return F.col(P + name)


def base_failed() -> Column:
    return (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))


def _share(name: str, part: str, whole: str, good: float, bad: float) -> tuple[str, object]:
    """Good up to a share of ``good``, bad over a share of ``bad``."""

    def rule() -> Column:
        return F.when(c(whole) <= 0, 0).when(c(part) <= good * c(whole), 1).when(c(part) > bad * c(whole), -1).otherwise(0)

    return name, rule


def _least(name: str, part: str, whole: str, good: float, bad: float) -> tuple[str, object]:
    """Good from a share of ``good`` on, bad under a share of ``bad``."""

    def rule() -> Column:
        return F.when(c(whole) <= 0, 0).when(c(part) >= good * c(whole), 1).when(c(part) < bad * c(whole), -1).otherwise(0)

    return name, rule


def _word_length() -> Column:
    mean = c("word_chars") / F.greatest(c("n_words"), F.lit(1))
    return F.when(c("n_words") <= 0, 0).when(mean.between(3, 10), 1).when((mean < 2) | (mean > 15), -1).otherwise(0)


RULES = [
    _share("symbols", "n_symbols", "n_words", 0.02, 0.10),
    _share("marked_words", "n_marked_words", "n_words", 0.05, 0.15),
    _share("dup_lines", "n_dup_lines", "n_lines", 0.10, 0.30),
    _share("repeats", "n_repeat_words", "n_words", 0.15, 0.35),
    _share("capitals", "n_capitals", "word_chars", 0.10, 0.30),
    _least("ended_lines", "n_ended_lines", "n_lines", 0.60, 0.20),
    _least("variety", "n_distinct_words", "n_words", 0.25, 0.10),
    ("word_length", _word_length),
]


@dataclass
class Estimate:
    """The share of good documents; each rule's accuracy on good documents (its
    votes for) and on bad ones (its votes against)."""

    prior: float
    on_good: list[float]
    on_bad: list[float]

    def log_odds(self) -> tuple[float, list[float], list[float]]:
        """Of the prior, and what each rule's vote for or against adds."""
        pairs = list(zip(self.on_good, self.on_bad, strict=True))
        return math.log(self.prior / (1 - self.prior)), [math.log(g / (1 - b)) for g, b in pairs], [math.log((1 - g) / b) for g, b in pairs]

    def posterior(self, votes: tuple[int, ...]) -> float:
        start, pro, contra = self.log_odds()
        odds = start + sum(pro[j] if v > 0 else contra[j] if v < 0 else 0.0 for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-odds))


def estimate(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 200) -> Estimate:
    """Expectation-maximisation over counts of vote patterns. It sets out from the
    filter that it replaces, in which every rule must pass, held with some doubt;
    two made-up votes of each class keep an accuracy off 0 and 1."""
    belief = {v: START[min(v, default=0) >= 0] for v in patterns}
    total = sum(patterns.values())
    now = Estimate(0.8, [0.9] * n_rules, [0.6] * n_rules)
    clip = lambda x, ends: min(max(x, ends[0]), ends[1])
    for _ in range(rounds if total else 0):
        good = sum(n * belief[v] for v, n in patterns.items())
        on_good, on_bad = [], []
        for j in range(n_rules):
            pro = sum(n * belief[v] for v, n in patterns.items() if v[j] > 0)
            cast = sum(n * belief[v] for v, n in patterns.items() if v[j])
            contra = sum(n * (1 - belief[v]) for v, n in patterns.items() if v[j] < 0)
            cast_bad = sum(n * (1 - belief[v]) for v, n in patterns.items() if v[j])
            g = clip((pro + 1.8) / (cast + 2), ON_GOOD)
            # A rule votes against bad documents more often than against good ones.
            on_good.append(g)
            on_bad.append(clip((contra + 1) / (cast_bad + 2), (1 - g, 0.99)))
        new = Estimate(clip(good / total, PRIOR), on_good, on_bad)
        moved = max(abs(x - y) for x, y in zip([new.prior, *new.on_good, *new.on_bad], [now.prior, *now.on_good, *now.on_bad], strict=True))
        now, belief = new, {v: new.posterior(v) for v in patterns}
        if moved < 1e-9:
            break
    return now


def judge(df: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` without ``text``, with BASE counts, base_failed, kept, posterior."""
    measured = materialise(features(df, text), "quality").withColumn(P + "failed", base_failed())
    measured = measured.withColumns({P + "v_" + name: rule() for name, rule in RULES})
    votes = [P + "v_" + name for name, _ in RULES]
    counted = measured.where(~c("failed")).groupBy(*votes).count().collect()
    found = estimate({tuple(r[v] for v in votes): r["count"] for r in counted}, len(RULES))
    start, pro, contra = found.log_odds()
    added = [F.when(F.col(v) > 0, p).when(F.col(v) < 0, q).otherwise(0.0) for v, p, q in zip(votes, pro, contra, strict=True)]
    odds = reduce(lambda a, b: a + b, added, F.lit(start))
    posterior = 1 / (1 + F.exp(-odds))
    own = [x for x in df.columns if x != text and x not in (*BASE, "base_failed", "kept", "posterior")]
    return measured.select(*own, *[c(b).alias(b) for b in BASE], c("failed").alias("base_failed"), (~c("failed") & (posterior >= threshold)).alias("kept"), posterior.alias("posterior"))
