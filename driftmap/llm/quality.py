"""Quality rules: document rules, pooled by host under an empirical beta prior.

Each document is tested by simple rules (too few words, too much repetition). Per host (the ``source`` column) the
failures are counted, and the host's failure rate is shrunk towards the corpus: the host rates' mean and variance give a
beta prior by the method of moments, so that hosts with few documents stay near the mean. A host whose shrunk rate
exceeds ``host_limit`` is rejected with all its documents.

Edge cases: null or empty text has no words and fails; a null host is never judged as a host, its documents stand for
themselves; repeated rows are judged row by row and each counts; an empty table gives an empty result; other columns
pass through, and columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, small, written

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]

ADDED = (*[n for n, _ in FIELDS], "base_failed", "kept", "host_rate")


def repeat_words(words: list[bytes], window: int = 3) -> int:
    """Words that lie in a window of ``window`` words found at least twice in the text."""
    if len(words) <= window:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[: len(ids) - window + 1]
    for k in range(1, window):
        key = key * len(seen) + ids[k : len(ids) - window + 1 + k]
        if k + 1 < window and len(seen) ** 3 >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key) + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    if not same.any():
        return 0
    covered = np.zeros(len(ids), bool)
    for k in range(window):
        covered[k : k + len(key)] |= twice[: len(key)]
    return int(covered.sum())


def document_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    text = text or ""
    words = text.encode().split()
    lines = text.split("\n")
    dup, seen = 0, set()
    for line in lines:
        if line in seen:
            dup += bool(line.strip(" \t\n\x0b\f\r"))
        else:
            seen.add(line)
    return len(words), len(b"".join(words).decode()), sum(map(text.count, "#*$%&|<>")), dup, repeat_words(words)


def scored(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the rule columns and base_failed."""
    docs = docs.drop(*ADDED)
    df = add_columns(docs, [text], FIELDS, lambda: lambda col: zip(*map(document_rules, col.to_pylist()), strict=True) if len(col) else [[]] * 5)
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(df: DataFrame, host: str = "source") -> DataFrame:
    """Per host: n, fails and host_rate, its failure rate under the empirical beta prior. One row per host."""
    by = written(df.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails")), "hosts")
    rate = F.col("fails") / F.col("n")
    total, hosts, fails, noise, spread = by.agg(F.sum("n"), F.count("*"), F.sum("fails"), F.avg(1 / F.col("n")), F.var_pop(rate)).first()
    if not total:
        return by.withColumn("host_rate", F.lit(0.0))
    mean = min(max(fails / total, 1e-6), 1 - 1e-6)
    # The variance of the observed rates holds the hosts' own spread and the noise of counting.
    own = max((spread or 0.0) - mean * (1 - mean) * noise, 1e-6)
    weight = min(max(mean * (1 - mean) / own - 1, 1.0), 1e6)
    return by.withColumn("host_rate", (F.col("fails") + mean * weight) / (F.col("n") + weight))


def judged(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = 0.8) -> DataFrame:
    """docs with the rule columns, base_failed, host_rate (null without a host) and kept."""
    df = written(scored(docs, text), "scored")
    rates = small(written(host_rates(df, host).select(F.col("host").alias("__host"), "host_rate"), "rates"))
    df = df.join(rates, df[host] == rates["__host"], "left").drop("__host")
    return df.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= host_limit))
