"""Quality rules judged by document and by host.

A document fails by itself when it has too few words or repeats itself.  Failures
are then summed per host.  Rates of small hosts say little, so each is shrunk
towards the corpus: failures are taken as beta-binomial, the prior's mean and
strength come from the moments of all hosts' rates, and a host's shrunken rate is the posterior mean
(failures + alpha) / (documents + alpha + beta).  A host is judged against the corpus: it is
rejected when even the lower limit of its rate, `DEVIATIONS` posterior standard deviations below
the mean, has `MULTIPLE` times the odds of the corpus rate.  Documents of rejected hosts go as
well.  Hosts that differ by chance only shrink to the corpus rate, and none is rejected.

Features are computed once and stored.  Host sums are a partial aggregate, so a
hot host costs nothing; verdicts return by a join with the rejected hosts only,
a stored table that is broadcast when small and split by AQE otherwise.

Cases: a NULL text has no words and fails, NULL is a host of its own, one host
alone is its own prior, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mendframe.llm.common import null_key
from mendframe.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MULTIPLE = 3
DEVIATIONS = 2
SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of words that the text has twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    code = ids[: n - window + 1]
    for k in range(1, window):
        # pairs of (code so far, next word), numbered anew so that they never overflow
        code = np.unique(code * len(number) + ids[k : n - window + 1 + k], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    edges = np.zeros(n + 1, dtype=np.int64)
    edges[: n - window + 1] += twice
    edges[window : n + 1] -= twice
    return int((edges.cumsum()[:n] > 0).sum())


def features_of(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANK)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def features(text: Column) -> Column:
    names = [x.partition(" ")[0] for x in FEATURES.split(", ")]

    @F.pandas_udf(FEATURES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([features_of(t) for t in texts], columns=names, dtype="int64")

    return run(text)


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


def host_rates(rows: DataFrame, multiple: float = MULTIPLE) -> DataFrame:
    """(host, n, failed, rate, low, limit): failures of (host, base_failed) rows, shrunk by the empirical prior.

    `low` is the lower limit of the rate, `limit` what it must not exceed.
    """
    hosts = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    # moments need only sums over hosts
    k, n, f, nn, ffn = hosts.agg(
        F.count(F.lit(1)), F.sum("n"), F.sum("failed"), F.sum(F.col("n").cast("double") * F.col("n")), F.sum(F.col("failed").cast("double") * F.col("failed") / F.col("n"))
    ).head()
    alpha, beta = prior(k, n or 0, f or 0, nn or 0.0, ffn or 0.0)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.lit(alpha + beta + 1)))
    mean = f / n if n else 0.0
    limit = multiple * mean / (1 - mean + multiple * mean)
    return hosts.withColumn("rate", rate).withColumn("low", F.col("rate") - DEVIATIONS * spread).withColumn("limit", F.lit(limit))


def prior(hosts: int, n: int, failed: int, n_squares: float, weighted_squares: float) -> tuple[float, float]:
    """Beta parameters from the sums of n, failures, n * n and failures * failures / n over the hosts."""
    if not n or failed in (0, n):
        return (0.0, 1.0) if not failed else (1.0, 0.0)
    mean = failed / n
    noise = mean * (1 - mean)
    spread = weighted_squares - n * mean * mean  # sum of n * (rate - mean) ** 2
    scale = n - n_squares / n
    between = (spread - (hosts - 1) * noise) / scale if scale > 0 else 0.0
    # hosts that differ by chance only are all alike: a prior as strong as the corpus
    strength = float(n) if between <= noise / (n + 1) else max(noise / between - 1, 1e-6)
    return mean * strength, (1 - mean) * strength


def rejected(rows: DataFrame, multiple: float = MULTIPLE) -> DataFrame:
    """(_host): the hosts whose rate is certainly too high, stored."""
    return materialize(host_rates(rows, multiple).where("low > limit").select(F.col("host").alias("_host")), "hosts-rejected")


def judge(stored: DataFrame, multiple: float = MULTIPLE) -> DataFrame:
    """Stored rows with `host` and `base_failed`, and `kept`."""
    marked = stored.join(rejected(stored, multiple).withColumn("_bad", F.lit(True)), F.col("host") == F.col("_host"), "left")
    return marked.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", multiple: float = MULTIPLE) -> DataFrame:
    """(doc_id, the features, base_failed, kept) for every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), null_key(host_col).alias("host"), features(F.col(text_col)).alias("f"))
    rows = rows.select("doc_id", "host", "f.*").withColumn("base_failed", base_failed())
    return judge(materialize(rows, "host-features"), multiple).drop("host")


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", multiple: float = MULTIPLE) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns.

    Features are computed for the host sums and again for the verdicts: cheaper than storing every text once more.
    """
    rows = docs.select(F.struct("*").alias("whole"), null_key(host_col).alias("host"), features(F.col(text_col)).alias("f"))
    rows = rows.select("whole", "host", "f.n_words", "f.n_repeat_words").withColumn("base_failed", base_failed())
    bad = rejected(rows.select("host", "base_failed"), multiple)
    return rows.where(~F.col("base_failed")).join(bad, F.col("host") == F.col("_host"), "left_anti").select("whole.*")
