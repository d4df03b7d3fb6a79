"""Host-level quality rules.

Every document is measured once and held against a few rules.  The failures are counted by
host; because the rate of a host with few documents says little, it is drawn towards the rate
of all hosts by a beta prior that is fitted to the spread between the hosts.  The verdicts on
hosts then go back to their documents.

Defined cases: a null or empty text has no words and fails the rule of length; a null host is a
host of its own; rows that repeat count as often as they occur; an empty table gives an empty
result.  Columns beside id, text and host are never looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, join_checked, per_row, stage, words_of

SYMBOLS = "#*$%&|<>"
LINE_BLANKS = BLANKS.encode()
MEASURES = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
            "n_repeat_words long")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that occurs twice or more in ``words``.

    Windows are numbered by joining the numbers of shorter ones, so equal numbers mean equal
    words; nothing is decided by a hash.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    one = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    label, size = one, 1
    while size < width:
        step = min(size, width - size)
        # the window starting `step` later overlaps or adjoins this one: together size + step words
        label = joined(label[:-step], label[step:])
        size += step
    counts = np.bincount(label)
    hit = counts[label] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += hit
    edges[width:width + n] -= hit
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = words_of(text)
    lines = [s for s in text.encode("utf-8", "surrogatepass").split(b"\n") if s.strip(LINE_BLANKS)]
    return (len(words), len(text) - sum(text.count(c) for c in BLANKS), sum(text.count(c) for c in SYMBOLS),
            len(lines), len(lines) - len(set(lines)), repeated_words(words))


def with_measures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Append the struct ``name`` with the measures of every text."""
    fields = MEASURES.replace(" long", ":bigint")
    return per_row(docs, lambda: lambda texts: [(measure(t),) for t in texts], [text], f"{name} struct<{fields}>")


class Rules(NamedTuple):
    """Limits of the rules; shares are of words or of lines."""

    min_words: int = 10
    repeat_percent: int = 20
    symbol_share: float = 0.5
    dup_line_share: float = 0.3
    host_rate: float = 0.8      # a host that fails more often loses all its documents
    suspect_rate: float = 0.25  # above it, doubtful documents of the host go as well


def failures(of: str, rules: Rules = Rules()) -> dict[str, Column]:
    """The rules as conditions on the struct ``of`` of measures.  ``short``, ``repeats`` and
    ``symbols`` condemn a document by themselves; ``dup_lines`` only makes it doubtful."""
    m = {f.split()[0]: F.col(f"{of}.{f.split()[0]}") for f in MEASURES.split(", ")}
    return {
        "short": m["n_words"] < rules.min_words,
        "repeats": 100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"],
        "symbols": m["n_symbols"] > rules.symbol_share * m["n_words"],
        "dup_lines": m["n_dup_lines"] > rules.dup_line_share * m["n_lines"],
    }


class Prior(NamedTuple):
    a: float
    b: float

    def rate(self, failed: Column, n: Column) -> Column:
        """Posterior mean of a host's rate."""
        return (failed + F.lit(self.a)) / (n + F.lit(self.a + self.b))


def fit_prior(hosts: DataFrame, failed: str, n: str) -> Prior:
    """Beta prior of the hosts' failure rates by the method of moments.

    The spread of the rates beyond what binomial chance explains gives the weight of the prior:
    the less the hosts differ, the heavier it is.  Six sums over the hosts reach the driver.
    """
    p, w = F.col(failed) / F.col(n), F.col(n).cast("double")
    total, fails, k, squares, s1 = hosts.agg(
        F.sum(w), F.sum(F.col(failed)), F.count(F.lit(1)), F.sum(w * w), F.sum(w * p * p)).first()
    if not total:
        return Prior(1.0, 1.0)
    m = min(max(fails / total, 0.5 / (total + 1)), 1 - 0.5 / (total + 1))
    spread = max(s1 / total - (fails / total) ** 2, 0.0)         # between hosts, weighted by size
    chance = m * (1 - m)
    apart = 1 - squares / total ** 2                              # sum of w (1 - w)
    noise = (k - 1) / total                                       # sum of (1 - w) / total
    share = (spread - chance * noise) / (chance * (apart - noise)) if apart > noise else 0.0
    weight = 1 / min(max(share, 1e-4), 0.5) - 1
    return Prior(m * weight, (1 - m) * weight)


def judge(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(),
          keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with a last column ``quality``: the measures, the host's rate, ``base_failed`` and
    ``kept`` (the column is named anew if ``docs`` has one of that name).

    The measured rows are written once, since the hosts' counts and the verdicts both read them.
    """
    name, key, none = fresh(docs, "quality"), fresh(docs, "_host"), fresh(docs, "_no_host")
    measured = stage(with_measures(docs, text, name)
                     .withColumns({key: F.coalesce(F.col(_quoted(host)).cast("string"), F.lit("")),
                                   none: F.col(_quoted(host)).isNull()})
                     .select(*map(_quoted, keep or docs.columns), name, key, none))
    rule = failures(name, rules)
    hosts = stage(measured.groupBy(key, none).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.greatest(*[c.cast("int") for c in rule.values()])).alias("n_any"),
        F.sum(rule["dup_lines"].cast("int")).alias("n_doubt")))
    rate = fit_prior(hosts, "n_any", "n").rate(F.col("n_any"), F.col("n"))
    doubt = fit_prior(hosts, "n_doubt", "n").rate(F.col("n_doubt"), F.col("n"))
    rate_at, doubt_at = fresh(docs, "_rate"), fresh(docs, "_doubt")
    verdicts = stage(hosts.select(key, none, rate.alias(rate_at), doubt.alias(doubt_at)))
    base = rule["short"] | rule["repeats"]
    kept = ~(base | rule["symbols"] | (F.col(rate_at) > rules.host_rate)
             | (rule["dup_lines"] & (F.col(doubt_at) > rules.suspect_rate)))
    joined = join_checked(measured, verdicts, [key, none], "left", row_bytes=128)
    result = F.struct(f"{name}.*", F.col(rate_at).alias("host_rate"), base.alias("base_failed"), kept.alias("kept"))
    return joined.select(*map(_quoted, keep or docs.columns), result.alias(name))


def _quoted(name: str) -> str:
    return f"`{name}`"


def quality_filter(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    judged = judge(docs, text, host, rules)
    return judged.where(F.col(f"{judged.columns[-1]}.kept")).select(*map(_quoted, docs.columns))
