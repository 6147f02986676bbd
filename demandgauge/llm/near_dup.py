"""Near-duplicate documents: an LSH forest proposes, full shingle sets decide.

1. Every text becomes the set of its distinct word shingles (64-bit hashes) and a MinHash signature
   of 64 values.  Texts with equal sets form one class at once, by a 128-bit digest of the set.
2. The forest is 16 orders of the signature: tree t starts at value 4t and goes round.  Texts that
   agree on the first 4 values of a tree share a region.  A pair at similarity 0.85 shares a region in
   at least one tree with probability 1 - (1 - 0.85^4)^16 > 0.99999, at 0.8 with 0.9998.
   Regions with the same members in several trees count once.
3. Depth adapts: a region of up to ``BLOCK`` texts stays whole, a larger one is taken apart by longer
   common prefixes (8, 16, 64 values), so that texts with the longest common prefix meet in a
   block.  What is larger still at full depth has equal signatures and is dealt out by hash.
4. Each block is compared exactly on full sets, in one sparse product, and gives one link per
   text at most (to the least text of its group within the block).  No pairs are listed.
5. The exact rest: what shares a region larger than a block, but is still in different components,
   is compared in pairs of blocks of ``WIDE`` texts of like size: those outside the main component of such a
   cluster against all of its texts.  So adaptive depth loses no link; memory stays at two blocks.

Defined results: null and empty texts have an empty set and are linked with nothing; texts shorter
than a shingle are one shingle as a whole; rows with a null id are kept, unlinked, with a null
component; rows that repeat an id count as one document with the links of all its texts, and are all kept if it is.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgauge.llm import words as W
from demandgauge.llm.components import components
from demandgauge.llm.shared import row_key, write_once

VALUES, TREES, BASE = 64, 16, 4
DEPTHS = (8, 16, 64)
BLOCK, WIDE = 128, 512
KEY = ["_k1", "_k2"]  # names one text of a node (its id); a node has several texts where rows repeat an id
_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "struct<n:bigint,d1:bigint,d2:bigint,signature:array<int>>"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and where each text's begin."""
    words = W.Words(texts, W.SPACE)
    hashes, first = words.hashes(), words.first
    counts = np.diff(first)
    g = W.grams(hashes, k)[W.inside(first, len(hashes), k)]
    sizes = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.empty(len(short), dtype=np.uint64)
        for n in range(1, k):
            here = counts[short] == n
            if here.any():
                whole[here] = W.mix(W.grams(hashes, n)[first[short[here]]] + np.uint64(n))
        g = np.insert(g, np.concatenate([[0], np.cumsum(sizes)])[short], whole)
        sizes[short] = 1
    start = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True):
        g[a:b].sort()
    fresh = np.ones(len(g), dtype=bool)
    fresh[1:] = g[1:] != g[:-1]
    fresh[start[:-1][sizes > 0]] = True
    return g[fresh], np.concatenate([[0], np.cumsum(fresh)])[start]


def _sign(texts: pa.Array, k: int) -> pa.Array:
    return pa.concat_arrays([_sign_some(part, k) for part in W.slices(texts)])


def _sign_some(texts: pa.Array, k: int) -> pa.Array:
    g, start = shingle_sets(texts, k)
    sizes = np.diff(start)
    some = np.flatnonzero(sizes)
    signature = np.zeros((len(sizes), VALUES), dtype=np.uint32)
    digest = np.zeros((2, len(sizes)), dtype=np.uint64)
    if len(some):
        at = start[:-1][some]
        with np.errstate(over="ignore"):
            for j, seed in enumerate(_SEEDS):
                signature[some, j] = np.minimum.reduceat(((g * seed) >> np.uint64(32)).astype(np.uint32), at)
            for j, salt in enumerate((np.uint64(0), np.uint64(0x5851F42D4C957F2D))):
                digest[j, some] = np.add.reduceat(W.mix(g ^ salt), at)
    per = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * VALUES)
    return pa.StructArray.from_arrays(
        [pa.array(sizes.astype(np.int64)), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)),
         pa.ListArray.from_arrays(per, pa.array(signature.view(np.int32).ravel()))],
        ["n", "d1", "d2", "signature"])


def _signer(k: int):
    @F.arrow_udf(_SIGNED)
    def sign(texts: pa.Array) -> pa.Array:
        return _sign(texts, k)
    return sign


def _setter(k: int):
    @F.arrow_udf("binary")
    def as_set(texts: pa.Array) -> pa.Array:
        out = []
        for part in W.slices(texts):
            g, start = shingle_sets(part, k)
            out += [g[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
        return pa.array(out, pa.binary())
    return as_set


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 matrices a few columns at a time."""
    n, m = len(left), len(right)
    values = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(n + m), [len(x) for x in [*left, *right]])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    column, owner = column[often], owner[often]
    if not len(column):
        return np.zeros((n, m), dtype=np.int64)
    column = np.cumsum(np.concatenate([[0], np.diff(column) > 0]))
    total = np.zeros((n, m), dtype=np.float64)
    width = 4096
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            dense = np.zeros((n + m, width), dtype=np.float32)
            dense[owner[a:b], column[a:b] - i * width] = 1
            total += dense[:n] @ dense[n:].T
    return np.rint(total).astype(np.int64)


def _groups(linked: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name reachable from each row of a symmetric link matrix."""
    out = names.copy()
    while True:
        least = np.minimum(out, np.where(linked, out[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (least == out).all():
            return out
        out = least


def _compare(left, right, share: tuple[int, int]) -> np.ndarray:
    both = _shared(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return share[1] * both >= share[0] * (sizes - both)


def _within(share: tuple[int, int]):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(KEY)
        names = rows["node"].to_numpy(dtype=np.int64)
        sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["shingles"]]
        to = _groups(_compare(sets, sets, share) | (names[:, None] == names[None, :]), names)
        moved = to != names
        return pd.DataFrame({"a": names[moved], "b": to[moved]})
    return block


def _between(share: tuple[int, int]):
    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        small, all_ = rows[rows["minor"]].drop_duplicates(KEY), rows[~rows["minor"]].drop_duplicates(KEY)
        if not len(small) or not len(all_):
            return pd.DataFrame({"a": np.zeros(0, dtype=np.int64), "b": np.zeros(0, dtype=np.int64)})
        sets = [[np.frombuffer(x, dtype=np.uint64) for x in part["shingles"]] for part in (small, all_)]
        i, j = np.nonzero(_compare(*sets, share))
        found = np.unique(np.stack([small["comp"].to_numpy()[i], all_["comp"].to_numpy()[j]], axis=1), axis=0)
        found = found[found[:, 0] != found[:, 1]]
        names, ends = np.unique(found, return_inverse=True)
        linked = np.zeros((len(names), len(names)), dtype=bool)
        ends = ends.reshape(found.shape)
        linked[ends[:, 0], ends[:, 1]] = linked[ends[:, 1], ends[:, 0]] = True
        to = _groups(linked, names) if len(names) else names
        return pd.DataFrame({"a": names[to != names], "b": to[to != names]})
    return pair


def near_duplicates(
    docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document row: ``_k1``, ``_k2`` (see ``row_key``), its id, n_shingles, component_id, kept.

    Linked: ``share[1] * intersection >= share[0] * union`` on sets of ``k``-word shingles.
    """
    signed = write_once(
        docs.select(*row_key(doc_id, text), F.col(doc_id).cast("bigint").alias("id"), _signer(k)(F.col(text)).alias("s"))
        .select("_k1", "_k2", "id", "s.*"), "signed")
    classes = write_once(
        signed.filter("n > 0 AND id IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min(F.struct("id", "_k1", "_k2")).alias("m"), F.first("signature").alias("signature"), F.max("n").alias("n"))
        .select("d1", "d2", "n", F.col("m.id").alias("node"), F.col("m._k1").alias("_k1"), F.col("m._k2").alias("_k2"), "signature"), "classes")
    blocks = _blocks(classes)
    sets = _sets(docs, blocks, k, doc_id, text)
    links = blocks.select("block", "node", *KEY).join(sets, KEY).groupBy("block").applyInPandas(_within(share), "a bigint, b bigint")
    links = write_once(links.unionByName(_same_id(signed, classes)), "links")
    found = components(links)
    large = blocks.filter(f"size > {BLOCK}")
    if large.limit(1).count():
        rest = write_once(_rest(large, classes, found, sets, share), "links")
        if rest.limit(1).count():
            found = components(links.unionByName(rest))
    named = classes.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("comp", "node").alias("component"))
    out = signed.select("_k1", "_k2", "id", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(
        "_k1", "_k2", F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between an id with several different texts and the least id of each of their classes."""
    digest = F.struct("d1", "d2")
    held = signed.filter("n > 0 AND id IS NOT NULL")
    several = held.groupBy("id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("low <> high").select("id")
    return (
        held.select("id", "d1", "d2").join(several, "id", "left_semi").distinct()
        .join(classes.select("d1", "d2", "node"), ["d1", "d2"]).select(F.col("id").alias("a"), F.col("node").alias("b")))


def _blocks(classes: DataFrame) -> DataFrame:
    """(region, size, block, node, _k1, _k2): members of regions of at least two, each in one block of its region."""
    keys = F.array(*(
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.slice("signature", BASE * t + 1, BASE)).alias("region")) for t in range(TREES)))
    forest = classes.select("node", *KEY, F.explode(keys).alias("f")).select("node", *KEY, "f.*")
    regions = (
        forest.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64(*KEY)).alias("who")).filter("size > 1")
        .groupBy("size", "who").agg(F.min("region").alias("region")).select("region", "size")
    )
    members = write_once(forest.join(regions, "region"), "members")
    done = [members.filter(f"size <= {BLOCK}").select("region", "size", F.col("region").alias("block"), "node", *KEY)]
    large = members.filter(f"size > {BLOCK}")
    if large.limit(1).count():
        turned = F.concat(F.expr(f"slice(signature, {BASE} * tree + 1, {VALUES})"), F.expr(f"slice(signature, 1, {BASE} * tree)"))
        left = large.join(classes.select(*KEY, "signature"), KEY).select(
            "region", "size", "node", *KEY, *(F.xxhash64("region", F.slice(turned, 1, d)).alias(f"p{d}") for d in DEPTHS))
        left = write_once(left, "deeper")
        for d in DEPTHS:
            held = left.groupBy(f"p{d}").agg(F.count(F.lit(1)).alias("held"))
            left = left.drop("held").join(held, f"p{d}")
            done.append(left.filter(f"held <= {BLOCK}").select("region", "size", F.col(f"p{d}").alias("block"), "node", *KEY))
            left = left.filter(f"held > {BLOCK}")
        dealt = F.xxhash64(f"p{DEPTHS[-1]}", F.pmod(F.xxhash64(*KEY), F.ceil(F.col("held") / BLOCK)))
        done.append(left.select("region", "size", dealt.alias("block"), "node", *KEY))
    return write_once(reduce(DataFrame.unionByName, done), "blocks")


def _sets(docs: DataFrame, blocks: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """(_k1, _k2, shingles) of the members of regions, from their whole texts.

    How many they are grows with the input, so they are never broadcast: the plan is the same at every size.
    """
    wanted = blocks.select(F.col("_k1").alias("_n1"), F.col("_k2").alias("_n2")).distinct()
    keys = row_key(doc_id, text)
    return write_once(
        docs.select(*keys, F.col(text).alias("_text")).join(wanted.hint("merge"), (F.col("_k1") == F.col("_n1")) & (F.col("_k2") == F.col("_n2")))
        .select(*KEY, _setter(k)(F.col("_text")).alias("shingles")), "sets")


def _rest(large: DataFrame, classes: DataFrame, found: DataFrame, sets: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Links between different components among texts that share a region larger than a block.

    Texts are compared within a band of set sizes and the two next to it: linked sets differ by less in size.
    """
    hubs = large.groupBy("region").agg(F.min("node").alias("hub"))
    clusters = components(
        large.join(hubs, "region").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    ).withColumnRenamed("comp", "cluster")
    band = F.floor(F.log("n") / (1.001 * math.log(share[1] / share[0]))).cast("int")
    placed = write_once(
        clusters.join(found, "node", "left").join(classes.select("node", *KEY, "n"), "node")
        .select("cluster", *KEY, F.coalesce("comp", "node").alias("comp"), band.alias("band")), "clusters")
    main = (
        placed.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("top")).select("cluster", F.col("top.comp").alias("main"))
    )
    minor = placed.join(main, "cluster").filter("comp <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    parts = (
        placed.withColumn("of", F.lit(1)).withColumn("less", F.lit(0))
        .unionByName(minor.select("cluster", *KEY, "comp", "band", F.lit(0).alias("of"), F.lit(1).alias("less")))
        .groupBy("cluster", "band").agg(F.ceil(F.sum("of") / WIDE).cast("int").alias("n_blocks"), F.ceil(F.sum("less") / WIDE).cast("int").alias("n_chunks"))
        .filter("n_blocks > 0 AND n_chunks > 0")
    )
    spread = lambda n: F.pmod(F.xxhash64(*KEY), F.col(n)).cast("int")
    counted = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["cluster", "band", "block", "chunk", *KEY, "comp"]
    every = placed.join(parts, ["cluster", "band"]).withColumn("block", spread("n_blocks")).withColumn("chunk", counted("n_chunks"))
    small = minor.join(parts, ["cluster", "band"]).withColumn("chunk", spread("n_chunks")).withColumn("block", counted("n_blocks"))
    rows = every.select(*columns, F.lit(False).alias("minor")).unionByName(small.select(*columns, F.lit(True).alias("minor")))
    return rows.join(sets, KEY).groupBy("cluster", "band", "block", "chunk").applyInPandas(_between(share), "a bigint, b bigint")


def drop_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with."""
    gone = near_duplicates(docs, k, share, doc_id, text).filter("NOT kept").select(
        F.col("_k1").alias("_gone1"), F.col("_k2").alias("_gone2")).distinct()
    keys = row_key(doc_id, text)
    return docs.join(gone, (keys[0] == F.col("_gone1")) & (keys[1] == F.col("_gone2")), "left_anti")
