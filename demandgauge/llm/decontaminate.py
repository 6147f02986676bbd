"""Benchmark decontamination by winnowing: fingerprints of shared spans are joined, then extended.

A window is 13 consecutive words of a benchmark item.  Of every 5 consecutive 9-gram hashes the
least is kept as a fingerprint (the last one on ties), so each span of 13 shared words has a
fingerprint in common on both sides: nothing of that length is missed.  A hit is extended by up
to 4 words to each side, compared as text; together the hits of a long span cover all of it.
An item of fewer than 13 words is one window: its whole hash is looked up at every position, once
for each such length that occurs (12 at most).

Python only hashes: it emits the fingerprints of a document that a Bloom filter of the benchmark's
fingerprints lets through.  The filter has a fixed size (1 MB), so what is sent to the tasks
does not grow with the benchmark; what it lets through in error falls out in the join.  The join
is left to Spark, which broadcasts the written fingerprint table only below its own size limit.

Defined results: null and empty texts have no words and no hits; an item without words has no
window; repeated items count each by their id, items with a null id hit without being listed;
repeated document rows each get the same result; empty tables give no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from demandgauge.llm import words as W
from demandgauge.llm.shared import row_key, write_once

WINDOW, GRAM, REACH = 13, 9, 4  # GRAM + REACH = WINDOW: REACH + 1 grams per window
_BITS = 23
_SPACED = W.to_space(W.NOT_ALNUM)
_HIT = "array<struct<h:bigint,at:int,n:int,gram:string,before:array<string>,after:array<string>>>"
_FOUND = f"struct<n_words:bigint,hits:{_HIT}>"


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept 9-grams of all texts of at least 13 words."""
    if len(hashes) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    g = W.grams(hashes, GRAM)
    n = len(g) - REACH
    least = g[:n].copy()
    for j in range(1, REACH + 1):
        np.minimum(least, g[j:j + n], out=least)
    pick = np.zeros(n, dtype=np.int64)
    for j in range(1, REACH + 1):
        pick[g[j:j + n] == least] = j
    whole = W.inside(first, len(hashes), WINDOW)
    at = np.unique((np.arange(n) + pick)[whole])
    return at, g[at]


def _slots(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << _BITS) - 1)
    return [(h >> np.uint64(s)) & mask for s in (0, 20, 40)]


def _length_hash(h: np.ndarray, n: int) -> np.ndarray:
    return W.mix(h ^ np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _scan(texts: pa.Array, lengths: list[int], bloom: np.ndarray | None) -> pa.Array:
    """Per text: number of words, and the fingerprints that the filter lets through (all, without a filter).

    ``lengths``: lengths under 13 for which every position is looked up; without a filter an item of
    such a length gives its one whole window.
    """
    words = W.Words(texts, W.NOT_ALNUM)
    hashes, counts = words.hashes(), np.diff(words.first)
    at, h = fingerprints(hashes, words.first)
    found = [(at, h, np.full(len(at), GRAM))]
    for n in lengths:
        g = _length_hash(W.grams(hashes, n), n)
        ok = W.inside(words.first, len(hashes), n)
        if bloom is None:
            begins = words.first[:-1][counts == n]
            ok = np.zeros(len(g), dtype=bool)
            ok[begins] = True
        place = np.flatnonzero(ok)
        found.append((place, g[place], np.full(len(place), n)))
    at, h, n = (np.concatenate(x) for x in zip(*found, strict=True))
    if bloom is not None:
        through = np.ones(len(h), dtype=bool)
        for s in _slots(h):
            through &= (bloom[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
        at, h, n = at[through], h[through], n[through]
    doc = np.searchsorted(words.first, at, "right") - 1
    order = np.argsort(doc, kind="stable")
    at, h, n, doc = at[order], h[order], n[order], doc[order]
    gram, before, after = [], [], []
    for i, size, d in zip(at.tolist(), n.tolist(), doc.tolist(), strict=True):
        reach = REACH if size == GRAM and counts[d] >= WINDOW else 0
        low, high = max(words.first[d], i - reach), min(words.first[d + 1], i + size + reach)
        near = words.lowered(low, high, _SPACED)
        gram.append(" ".join(near[i - low:i - low + size]))
        before.append(near[:i - low][::-1])
        after.append(near[i - low + size:])
    hits = pa.StructArray.from_arrays(
        [pa.array(h.view(np.int64)), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)),
         pa.array(gram, pa.string()), pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string()))],
        ["h", "at", "n", "gram", "before", "after"])
    offsets = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays(
        [pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), hits)], ["n_words", "hits"])


def _scanner(lengths: list[int], bloom: np.ndarray | None):
    @F.arrow_udf(_FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_scan(part, lengths, bloom) for part in W.slices(texts)])
    return scan


def _bloom(prints: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over the fingerprints; its words are or-ed together by Spark."""
    mask = (1 << _BITS) - 1
    slots = F.array(*(F.shiftrightunsigned("h", s).bitwiseAND(F.lit(mask)) for s in (0, 20, 40)))
    parts = (
        prints.select(F.explode(slots).alias("slot"))
        .groupBy(F.shiftrightunsigned("slot", 5).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("slot").bitwiseAND(F.lit(31)).cast("int"))).alias("bits"))
        .collect()
    )
    out = np.zeros(1 << (_BITS - 5), dtype=np.uint32)
    for word, bits in parts:
        out[word] = bits
    return out.view(np.uint8)


def _same_run(a: str, b: str):
    """How many leading entries of two arrays are equal."""
    total, so_far = F.lit(0), F.lit(1)
    for i in range(REACH):
        equal = F.coalesce((F.get(F.col(a), F.lit(i)) == F.get(F.col(b), F.lit(i))).cast("int"), F.lit(0))
        so_far = so_far * equal
        total = total + so_far
    return total


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document row: ``_k1``, ``_k2`` (see ``row_key``), its id, n_words, n_hit, n_items, items, contaminated."""
    lengths = list(range(1, WINDOW))
    prints = write_once(
        items.select(F.col(item_id).cast("string").alias("item"), _scanner(lengths, None)(F.col(item_text)).alias("f"))
        .select("item", F.explode("f.hits").alias("p"))
        .select("item", "p.h", "p.n", "p.gram", F.col("p.before").alias("item_before"), F.col("p.after").alias("item_after")),
        "fingerprints")
    short = sorted(r[0] for r in prints.filter(f"n <> {GRAM} or size(item_before) + size(item_after) = 0").select("n").distinct().collect())
    bloom = _bloom(prints.select("h"))
    scanned = write_once(
        docs.select(*row_key(doc_id, text), F.col(doc_id), _scanner(short, bloom)(F.col(text)).alias("f"))
        .select("_k1", "_k2", doc_id, "f.n_words", "f.hits"), "scanned")
    hits = (
        scanned.filter("size(hits) > 0").select("_k1", "_k2", F.explode("hits").alias("p")).select("_k1", "_k2", "p.*")
        .join(prints, ["h", "n", "gram"])
        .withColumn("left", _same_run("before", "item_before")).withColumn("right", _same_run("after", "item_after"))
        .withColumn("short", F.size("item_before") + F.size("item_after") == 0)
        .filter(F.col("short") | (F.col("left") + F.col("right") + F.col("n") >= WINDOW))
        .select("_k1", "_k2", "item", (F.col("at") - F.col("left")).alias("begin"), (F.col("at") + F.col("n") + F.col("right")).alias("end"))
    )
    spans = hits.groupBy("_k1", "_k2", "begin").agg(F.max("end").alias("end"), F.collect_set("item").alias("items"))
    earlier = Window.partitionBy("_k1", "_k2").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce("reached", F.lit(0))))
    per_doc = (
        spans.withColumn("reached", F.max("end").over(earlier)).withColumn("fresh", fresh)
        .groupBy("_k1", "_k2").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    )
    return (
        scanned.select("_k1", "_k2", doc_id, "n_words").join(per_doc, ["_k1", "_k2"], "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("bigint"))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumn("n_items", F.size("items").cast("bigint"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns they came with."""
    bad = contamination(docs, items, doc_id, text).filter("contaminated").select("_k1", "_k2").distinct()
    keys = row_key(doc_id, text)
    return docs.join(
        bad.withColumnsRenamed({"_k1": "_bad1", "_k2": "_bad2"}), (keys[0] == F.col("_bad1")) & (keys[1] == F.col("_bad2")), "left_anti")
