"""Quality classifier by hierarchical empirical Bayes: what a text says, weighed against where it comes from.

1. Evidence: a logistic regression over word hashes and a few rates of the text, fitted on at
   most ``SAMPLE`` labelled rows (by hash order), gives each document a log likelihood ratio.
2. Site posteriors: labels are counted per path and per host by grouped aggregation.  Sites vary around the
   level above them by a beta distribution whose strength is estimated from all sites by the method
   of moments; a host with few labels is drawn to the global rate, a path with few to its host.
3. The posterior log odds of a document are those of its path plus the evidence.

Quality and toxicity are two such models on the same features.  The test documents have no url, so host is
``source`` and path is ``source`` and ``lang``; any two columns will do.

Defined results: null and empty texts have no words and are judged by their rates and site; a null
host or path is a site of its own; labels of one id count once (worst quality, any toxicity); null labels are ignored; a site
without labels has the posterior of the level above; without any labels all odds are even and all rows are kept;
equal rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgauge.llm import words as W
from demandgauge.llm.shared import write_once

SAMPLE = 20_000
BITS, SEEN, TELLING = 20, 5, 4.0
TASKS = ("quality", "toxic")
_SYMBOL = W.byte_class([(ord(c), ord(c)) for c in "#*$%&|<>{}[]\\^~_=+"])
_UPPER, _DIGIT, _LINE = W.byte_class([(0x41, 0x5A)]), W.byte_class([(0x30, 0x39)]), W.byte_class([(0x0A, 0x0A)])
N_RATES = 7


def describe(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word numbers of each text (and where they begin), and its rates."""
    words = W.Words(texts, W.NOT_ALNUM)
    h, first = words.hashes(), words.first
    number = (h >> np.uint64(64 - BITS)).astype(np.int64)
    n_words, n_bytes = np.diff(first), np.maximum(np.diff(words.offsets), 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[words.offsets[1:]] - sums[words.offsets[:-1]]

    def distinct(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = values.copy()
        for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            values[a:b].sort()
        fresh = np.ones(len(values), dtype=bool)
        fresh[1:] = values[1:] != values[:-1]
        fresh[begin[:-1][np.diff(begin) > 0]] = True
        return values[fresh], np.concatenate([[0], np.cumsum(fresh)])[begin]

    numbers, begin = distinct(number, first)
    pairs = W.grams(h, 2)[W.inside(first, len(h), 2)]
    pair_begin = np.concatenate([[0], np.cumsum(np.maximum(n_words - 1, 0))])
    n_pairs = np.diff(pair_begin)
    rates = np.stack([
        np.log1p(n_words), per_text(_SYMBOL[words.data]) / n_bytes * 10, per_text(_UPPER[words.data]) / n_bytes * 10, per_text(_DIGIT[words.data]) / n_bytes * 10,
        np.diff(begin) / np.maximum(n_words, 1), np.diff(distinct(pairs, pair_begin)[1]) / np.maximum(n_pairs, 1) * (n_pairs > 0), per_text(_LINE[words.data]) / n_bytes * 10], axis=1)
    return numbers, begin, rates


@dataclass
class Evidence:
    """Weights of one model; ``prior`` is the log odds among the rows it was fitted on."""

    words: np.ndarray
    rates: np.ndarray
    bias: float
    prior: float
    center: np.ndarray
    spread: np.ndarray

    def ratio(self, numbers: np.ndarray, begin: np.ndarray, rates: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.words[numbers], dtype=np.float64)])
        return sums[begin[1:]] - sums[begin[:-1]] + np.clip((rates - self.center) / self.spread, -6, 6) @ self.rates + self.bias - self.prior


def fit(numbers: np.ndarray, begin: np.ndarray, rates: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, l2: float = 2e-5) -> Evidence:
    """Logistic regression by Adam; words seen in fewer than ``SEEN`` texts, or about as often with either label, have no weight."""
    n = len(labels)
    center, spread = (rates.mean(axis=0), rates.std(axis=0) + 1e-3) if n else (np.zeros(N_RATES), np.ones(N_RATES))
    share = min(max(labels.mean() if n else 0.5, 1e-4), 1 - 1e-4)
    prior = float(np.log(share / (1 - share)))
    out = Evidence(np.zeros(1 << BITS, dtype=np.float32), np.zeros(N_RATES), prior, prior, center, spread)
    if not n or labels.min() == labels.max():
        return out
    row = np.repeat(np.arange(n), np.diff(begin))
    held = np.bincount(numbers, minlength=1 << BITS).astype(np.float64)
    hits = np.bincount(numbers, weights=labels[row], minlength=1 << BITS)
    score = np.abs(hits - held * share) / np.sqrt(np.maximum(held * share * (1 - share), 1e-9))
    seen = (held >= SEEN) & (score >= TELLING)
    slot = np.cumsum(seen) - 1
    on = seen[numbers]
    column, row = slot[numbers[on]], row[on]
    x = np.clip((rates - center) / spread, -6, 6)
    k = int(seen.sum())
    w, m, v = np.zeros(k + N_RATES + 1), np.zeros(k + N_RATES + 1), np.zeros(k + N_RATES + 1)
    w[-1] = prior
    for t in range(1, rounds + 1):
        z = np.bincount(row, weights=w[column], minlength=n) + x @ w[k:-1] + w[-1]
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        g = np.concatenate([np.bincount(column, weights=off[row], minlength=k), off @ x, [off.sum()]])
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-5)
    out.words[np.flatnonzero(seen)] = w[:k]
    out.rates, out.bias = w[k:-1], float(w[-1])
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, Evidence]:
    """Both models, from at most ``SAMPLE`` labelled rows; only their features come to the driver."""
    chosen = write_once(
        _clean(labels, doc_id).orderBy(F.xxhash64(doc_id), doc_id).limit(SAMPLE), "sample").withColumnRenamed(doc_id, "_labelled")

    @F.arrow_udf("struct<numbers:array<int>,rates:array<double>>")
    def features(texts: pa.Array) -> pa.Array:
        parts = []
        for part in W.slices(texts):
            numbers, begin, rates = describe(part)
            parts.append(pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(numbers.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * N_RATES), pa.array(rates.ravel()))], ["numbers", "rates"]))
        return pa.concat_arrays(parts)

    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(chosen, F.col("_id") == F.col("_labelled"))
        .select("_id", *TASKS, features("_text").alias("f")).select("_id", *TASKS, "f.numbers", "f.rates").toArrow().combine_chunks().sort_by("_id")
    )
    lists = rows["numbers"].combine_chunks()
    begin = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    rates = rows["rates"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, N_RATES)
    return {t: fit(numbers, begin, rates, rows[t].to_numpy().astype(np.float64)) for t in TASKS}


def _clean(labels: DataFrame, doc_id: str) -> DataFrame:
    return labels.filter(F.col(doc_id).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()).groupBy(doc_id).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def _shrunk(sites: DataFrame, keys: list[str], task: str) -> DataFrame:
    """``mean`` of each site: its successes ``s`` of ``n`` drawn to ``above`` by the strength that all sites show together."""
    even = F.greatest(F.col("above") * (1 - F.col("above")), F.lit(1e-6))
    moments = sites.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * even).alias("noise"),
        F.sum(F.pow(F.col("s") - F.col("n") * F.col("above"), 2) / F.col("n")).alias("found"))
    # Expected for sites that differ by nothing: one noise per site; the excess over that is their own spread.
    per_row = F.col("noise") / F.col("n")
    excess = (F.col("found") - F.col("m") * per_row) / F.greatest(per_row * (F.col("n") - F.col("m")), F.lit(1e-9))
    strength = moments.select((1 / F.least(F.greatest(F.coalesce(excess, F.lit(1e-3)), F.lit(1e-3)), F.lit(0.9)) - 1)).scalar()
    return sites.withColumn("k", strength).select(*keys, ((F.col("s") + F.col("k") * F.col("above")) / (F.col("n") + F.col("k"))).alias(f"{task}_mean"))


def site_posteriors(docs: DataFrame, labels: DataFrame, host: str, path: str, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hosts, paths, rates of all): posterior means per host, per path, and the global rates as one row."""
    where = docs.select(F.col(doc_id).alias("_id"), F.col(host).alias("host"), F.col(path).alias("path"))
    seen = _clean(labels, doc_id).join(where, F.col(doc_id) == F.col("_id"))
    counted = write_once(seen.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *(F.sum(t).alias(f"s_{t}") for t in TASKS)), "sites")
    # One success and one failure beside the counts, so that no rate is 0 or 1.
    everywhere = write_once(counted.agg(*((F.coalesce(F.sum(f"s_{t}"), F.lit(0)) + 1).cast("double").alias(t) for t in TASKS), (F.coalesce(F.sum("n"), F.lit(0)) + 2).alias("n")).select(
        *((F.col(t) / F.col("n")).alias(t) for t in TASKS)), "rates")
    by_host = counted.groupBy("host").agg(F.sum("n").alias("n"), *(F.sum(f"s_{t}").alias(f"s_{t}") for t in TASKS))
    hosts, paths = None, None
    for t in TASKS:
        own = _shrunk(by_host.select("host", "n", F.col(f"s_{t}").alias("s")).withColumn("above", everywhere.select(t).scalar()), ["host"], t)
        hosts = own if hosts is None else hosts.join(own.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    hosts = write_once(hosts, "hosts")
    above = hosts.withColumnRenamed("host", "_h")
    for t in TASKS:
        sites = counted.join(above, F.col("host").eqNullSafe(F.col("_h"))).select("host", "path", "n", F.col(f"s_{t}").alias("s"), F.col(f"{t}_mean").alias("above"))
        own = _shrunk(sites, ["host", "path"], t)
        paths = own if paths is None else paths.join(
            own.withColumnsRenamed({"host": "_h", "path": "_p"}), F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))).drop("_h", "_p")
    return hosts, write_once(paths, "paths"), everywhere


def judge(
    docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", doc_id: str = "doc_id", text: str = "text",
    models: dict[str, Evidence] | None = None,
) -> DataFrame:
    """``docs`` with p_quality, p_toxic and kept; input columns of these names are replaced."""
    models = models or train(docs, labels, doc_id, text)
    hosts, paths, everywhere = site_posteriors(docs, labels, host, path, doc_id)
    shared = docs.sparkSession.sparkContext.broadcast([models[t] for t in TASKS])

    @F.arrow_udf("array<double>")
    def evidence(texts: pa.Array) -> pa.Array:
        parts = []
        for part in W.slices(texts):
            d = describe(part)
            values = np.stack([m.ratio(*d) for m in shared.value], axis=1)
            parts.append(pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(TASKS)), pa.array(values.ravel())))
        return pa.concat_arrays(parts)

    given = docs.drop("p_quality", "p_toxic", "kept")
    scored = given.withColumn("_evidence", evidence(F.col(text))).withColumn("_all", everywhere.select(F.struct(*TASKS)).scalar())
    h = hosts.select(F.col("host").alias("_host"), *(F.col(f"{t}_mean").alias(f"_host_{t}") for t in TASKS))
    p = paths.select(F.col("host").alias("_path_host"), F.col("path").alias("_path"), *(F.col(f"{t}_mean").alias(f"_path_{t}") for t in TASKS))
    joined = scored.join(h, F.col(host).eqNullSafe(F.col("_host")), "left").join(
        p, F.col(host).eqNullSafe(F.col("_path_host")) & F.col(path).eqNullSafe(F.col("_path")), "left")
    for i, t in enumerate(TASKS):
        prior = F.coalesce(f"_path_{t}", f"_host_{t}", f"_all.{t}")
        odds = F.log(prior / (1 - prior)) + F.col("_evidence")[i]
        joined = joined.withColumn(f"p_{t}", F.round(1 / (1 + F.exp(-odds)), 6))
    return joined.withColumn("kept", (F.col("p_quality") >= 0.5) & ~(F.col("p_toxic") > 0.5)).select(*given.columns, "p_quality", "p_toxic", "kept")
