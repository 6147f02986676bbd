"""Ranked lexical search on K2-treaps: a compressed quadtree over the term-document grid whose cells keep the largest impact.

Index: one row per block of documents, about ``POSTINGS`` (term, document) pairs each.  In a block the
terms are the rows of a grid (most frequent first, so that dense rows lie together), the documents its
columns, and a point is the impact of a term in a document.  The grid is cut into quadrants again and again;
a cell with a single point is not cut further.  Cells are stored level by level: a mask of the quadrants that hold
points, and the largest impact below.  Children follow each other, so their places are a running sum of the masks.
Columns of a block are compressed where they are made, and blocks are written, read and handed over one by one, so memory goes by the block,
not by how many of them a task has.

Search: the terms of an item walk down together.  A range of columns holds, for each term, the cell on its
row's path; weight times largest impact, summed, bounds the score of every document in the range.  Ranges with the largest
bounds are halved first, in batches that double once ``k`` documents are found; a single column's bound is its score.  Ranges below the ``k``-th
best score found so far are left.  Nothing else is: the result is exact.  A task carries the best ``k`` from block to block; all
that meets across tasks is at most ``k`` rows per item and task.

Impact and weight follow the contract of ``search``.  Terms are compared by 64-bit hashes of their lower-cased bytes.

Defined results: a null text has no terms; documents and items without terms find nothing; equal scores go by ascending
document id, a null id first; rows that repeat an id are documents, or items, of their own; an empty table on either side
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgauge.llm import words as W
from demandgauge.llm.shared import arrow_rows, write_once

#: Points per block; words of items per search job; ranges in the first batch.
POSTINGS, QUERY_WORDS, BATCH = 1 << 20, 1 << 20, 64
#: Documents handed to a worker at a time.
_TEXTS = 1000
_SALTS = 64
_NO_ID = np.iinfo(np.int64).min
_INDEX = ("columns binary, height int, terms binary, rows binary, held binary, masks binary, peaks binary, "
          "leaf_rows binary, leaf_columns binary")
_TYPES = {"columns": np.int64, "terms": np.uint64, "rows": np.uint32, "held": np.uint32, "masks": np.uint8, "peaks": np.uint32,
          "leaf_rows": np.uint32, "leaf_columns": np.uint32}
_ONES = np.array([bin(i).count("1") for i in range(16)], dtype=np.uint8)
#: Parquet: a block above this many bytes has row group and page to itself, and no reader needs two at once.
_ONE_BY_ONE = {"parquet.block.size": str(1 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1",
               "parquet.enable.dictionary": "false"}
_ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(x: np.ndarray, name: str) -> bytes:
    """A column of the index: its size, then its bytes, all first ones, all second ones and so on, compressed."""
    x = np.ascontiguousarray(x, dtype=_TYPES[name])
    return x.nbytes.to_bytes(8, "little") + _ZSTD.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T), asbytes=True)


def _unpacked(packed: pa.Buffer, name: str) -> np.ndarray:
    raw = _ZSTD.decompress(packed.slice(8), int.from_bytes(packed.slice(0, 8).to_pybytes(), "little"))
    kind = np.dtype(_TYPES[name])
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


# --- terms ------------------------------------------------------------------------------------------

@F.arrow_udf(T.LongType())
def _n_terms(texts: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.diff(W.Words(part, W.NOT_ALNUM).first) for part in W.slices(texts)]), pa.int64())


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats per text; then text, term and how often, of each different term of a text."""
    words = W.Words(texts, W.NOT_ALNUM)
    hashes, first = words.hashes(), words.first
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        hashes[a:b].sort()
    of = words.of_word()
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])])[:len(hashes)]
    at = np.flatnonzero(new)
    return np.diff(first), of[at], hashes[at], np.diff(np.append(at, len(hashes)))


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms."""
    row = docs.select(_n_terms(F.col(text)).alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n")).head()
    return row[0], row[1] or 0


# --- tree ------------------------------------------------------------------------------------------

def _spread(x: np.ndarray) -> np.ndarray:
    """Every bit moved to the even place of its number."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x |= x << np.uint64(shift)
        x &= np.uint64(mask)
    return x


def build_tree(rows: np.ndarray, columns: np.ndarray, impacts: np.ndarray) -> dict[str, np.ndarray | int]:
    """The compressed quadtree of distinct points, level by level; a mask of 0 is a cell with one point."""
    height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
    code = _spread(rows)
    code <<= np.uint64(1)
    code |= _spread(columns)
    points = np.argsort(code, kind="stable")
    code, impacts = code[points], impacts[points].astype(np.uint32)
    starts, sizes = np.zeros(1, dtype=np.int64), np.array([len(code)])
    masks, peaks, leaf_rows, leaf_columns = [], [], [], []
    for level in range(height + 1):
        peaks.append(np.maximum.reduceat(impacts, starts))
        single = sizes == 1
        at = points[starts[single]]
        leaf_rows.append(rows[at].astype(np.uint32))
        leaf_columns.append(columns[at].astype(np.uint32))
        mask = np.zeros(len(starts), dtype=np.uint8)
        if single.all():
            masks.append(mask)
            break
        stay = np.repeat(~single, sizes)
        code, impacts, points = code[stay], impacts[stay], points[stay]
        inner = code >> np.uint64(2 * (height - 1 - level))
        starts = np.flatnonzero(np.concatenate([[True], inner[1:] != inner[:-1]]))
        quadrant = (inner[starts] & np.uint64(3)).astype(np.uint8)
        del inner
        parent = np.flatnonzero(~single)[np.searchsorted(np.cumsum(sizes[~single]), starts, "right")]
        np.bitwise_or.at(mask, parent, np.left_shift(1, quadrant).astype(np.uint8))
        masks.append(mask)
        sizes = np.diff(np.append(starts, len(code)))
    joined = {"masks": masks, "peaks": peaks, "leaf_rows": leaf_rows, "leaf_columns": leaf_columns}
    return {"height": height, **{name: np.concatenate(x) for name, x in joined.items()}}


class _Block:
    """Collects documents until a block is full."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.clear()

    def clear(self) -> None:
        self.ids, self.columns, self.terms, self.impacts, self.n_columns, self.n_points = [], [], [], [], 0, 0

    def add(self, ids: np.ndarray, texts: pa.Array) -> None:
        n, of, term, tf = term_counts(texts)
        length = 100 - 25 + (25 * n.astype(np.int64) * self.n_docs) // max(1, self.n_terms)
        tf = tf.astype(np.int64)
        self.ids.append(ids)
        self.columns.append((of + self.n_columns).astype(np.uint32))
        self.terms.append(term)
        self.impacts.append((1_000_000_000 * tf // (1000 * tf + 12 * length[of])).astype(np.uint32))
        self.n_columns += len(ids)
        self.n_points += len(of)

    def finish(self) -> dict:
        ids, columns, terms, impacts = (np.concatenate(x) for x in (self.ids, self.columns, self.terms, self.impacts))
        self.clear()
        terms, rows, held = np.unique(terms, return_inverse=True, return_counts=True)
        row = np.empty(len(terms), dtype=np.uint32)
        row[np.argsort(-held, kind="stable")] = np.arange(len(terms))
        rows = row[rows]
        out = {"columns": ids, "terms": terms, "rows": row, "held": held, **build_tree(rows, columns, impacts)}
        return {name: _packed(x, name) if name in _TYPES else x for name, x in out.items()}


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", postings: int = POSTINGS) -> DataFrame:
    """The written index of all rows, one row per block; documents stay in the partition they are read in."""
    spark = docs.sparkSession
    with arrow_rows(spark, _TEXTS):
        n_docs, n_terms = totals(docs, text)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(n_docs, n_terms)
        for batch in batches:
            done = 0
            for part in W.slices(batch.column(1), 1 << 20):
                block.add(batch.column(0).slice(done, len(part)).to_numpy(zero_copy_only=False), part)
                done += len(part)
                if block.n_points >= postings:
                    yield pa.RecordBatch.from_pylist([block.finish()], schema)
        if block.n_points:
            yield pa.RecordBatch.from_pylist([block.finish()], schema)

    schema = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in _INDEX.split(", ")])
    ids = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(_NO_ID))
    built = docs.select(ids.alias("id"), F.col(text).alias("text")).mapInArrow(build, _INDEX)
    with arrow_rows(spark, _TEXTS):
        index = write_once(built, "treaps", "uncompressed", **_ONE_BY_ONE)
    return index.withColumn("n_docs", F.lit(n_docs))


# --- search ------------------------------------------------------------------------------------------

class Tree:
    """One block of the index, ready for searching."""

    def __init__(self, row: dict):
        for name, kind in _TYPES.items():
            setattr(self, name, np.frombuffer(row[name], dtype=kind))
        self.height = row["height"]
        ones = _ONES[self.masks]
        self.child = np.cumsum(ones, dtype=np.uint32)
        self.child -= ones
        self.child += np.uint32(1)
        self.leaf = self.masks == 0
        self.leaf_at = np.cumsum(self.leaf, dtype=np.uint32)
        self.leaf_at -= self.leaf

    def rows_of(self, terms: np.ndarray) -> np.ndarray:
        """The row of each term, -1 where no document has it."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.rows[at].astype(np.int64), -1)

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, found: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``k`` best of ``found`` and of this block's documents."""
        # Ranges: level, first column, bound.  Pairs: range, term, cell; sorted by range.
        level, column = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        term = np.arange(len(rows))
        cell = np.zeros(len(rows), dtype=np.int64)
        keep = self._on_row(cell, rows)
        term, cell = term[keep], cell[keep]
        of = np.zeros(len(term), dtype=np.int64)
        bound = np.array([int((weights[term] * self.peaks[cell]).sum())])
        least, batch = self._least(found, k), BATCH
        while True:
            alive = bound >= least
            if not alive.all():
                level, column, bound, of, term, cell = _select(alive, level, column, bound, of, term, cell)
            if not len(bound):
                return found
            chosen = np.ones(len(bound), dtype=bool)
            if len(bound) > batch:
                chosen[:] = False
                chosen[np.argpartition(-bound, batch)[:batch]] = True
            batch *= 2 if least > 1 else 1
            now = _select(chosen, level, column, bound, of, term, cell)
            level, column, bound, of, term, cell = _select(~chosen, level, column, bound, of, term, cell)
            new = self._halved(now, rows, weights)
            done, at = self._settled(new)
            if done.any():
                found = _best_of(k, np.concatenate([found[0], new[2][done]]), np.concatenate([found[1], self.columns[at]]))
                least = self._least(found, k)
                new = _select(~done, *new)
            shift = len(level)
            level, column, bound = (np.concatenate(x) for x in zip((level, column, bound), new[:3], strict=True))
            of, term, cell = np.concatenate([of, new[3] + shift]), np.concatenate([term, new[4]]), np.concatenate([cell, new[5]])

    @staticmethod
    def _least(found: tuple[np.ndarray, np.ndarray], k: int) -> int:
        return int(found[0][-1]) if len(found[0]) == k else 1

    def _on_row(self, cell: np.ndarray, row: np.ndarray) -> np.ndarray:
        """A cell with one point is of use only to the term of that point."""
        return ~self.leaf[cell] | (self.leaf_rows[np.where(self.leaf[cell], self.leaf_at[cell], 0)] == row)

    def _halved(self, ranges, rows: np.ndarray, weights: np.ndarray):
        level, column, _, of, term, cell = ranges
        shift = self.height - 1 - level[of]
        leaf = self.leaf[cell]
        mask, row_bit = self.masks[cell], (rows[term] >> shift) & 1
        parts = []
        for half in (0, 1):
            quadrant = 2 * row_bit + half
            inner = ~leaf & (mask >> quadrant & 1 == 1)
            here = np.where(leaf, (self.leaf_columns[np.where(leaf, self.leaf_at[cell], 0)] >> shift & 1) == half, inner)
            below = np.where(leaf, cell, self.child[cell] + _ONES[mask & ((1 << quadrant) - 1)])
            i = np.flatnonzero(here)
            i = i[leaf[i] | self._on_row(below[i], rows[term[i]])]
            parts.append((2 * of[i] + half, term[i], below[i]))
        key, term, cell = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        key, term, cell = key[order], term[order], cell[order]
        names, of = np.unique(key, return_inverse=True)
        bound = np.zeros(len(names), dtype=np.int64)
        np.add.at(bound, of, weights[term] * self.peaks[cell])
        old, half = names >> 1, names & 1
        return level[old] + 1, column[old] | half << (self.height - 1 - level[old]), bound, of, term, cell

    def _settled(self, ranges) -> tuple[np.ndarray, np.ndarray]:
        """Ranges that are one document: by depth, or as one term with one point is all that is left; and the documents."""
        level, column, _, of, _, cell = ranges
        alone = np.bincount(of, minlength=len(level)) == 1
        only = np.zeros(len(level), dtype=np.int64)
        only[of] = cell
        alone &= self.leaf[only]
        column = np.where(alone, self.leaf_columns[np.where(alone, self.leaf_at[only], 0)], column)
        done = alone | (level == self.height)
        return done, column[done]


def _select(chosen: np.ndarray, level, column, bound, of, term, cell):
    """The chosen ranges and their pairs."""
    place, pairs = np.cumsum(chosen) - 1, chosen[of]
    return level[chosen], column[chosen], bound[chosen], place[of[pairs]], term[pairs], cell[pairs]


def _best_of(k: int, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


@F.arrow_udf(T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in ("terms", "times")]))
def _item_terms(texts: pa.Array) -> pa.Array:
    out = []
    for part in W.slices(texts):
        _, of, term, times = term_counts(part)
        borders = np.searchsorted(of, np.arange(len(part) + 1))
        out += [{"terms": term[a:b].view(np.int64), "times": times[a:b]} for a, b in zip(borders[:-1], borders[1:], strict=True)]
    return pa.array(out, pa.struct([("terms", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]))


def search(index: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text", query_words: int = QUERY_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest score above 0 for each row of ``items``.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), its impact (10^9 tf) div (1000 tf + 12 m) with
    m = 75 + (25 n N) div L; a score sums weight times impact over an item's terms, repeats included.  Items are a
    stated query set: they are sent to the index in blocks of about ``query_words`` words, as many jobs as it takes.
    """
    spark = index.sparkSession
    asked = write_once(items.select(F.col(item_id).alias("item_id"), _item_terms(F.col(text)).alias("t")).select(
        "item_id", "t.*").filter("size(terms) > 0"), "asked")
    n_words = asked.agg(F.sum(F.size("terms"))).head()[0] or 0
    n_blocks = n_words // query_words + 1
    block = F.pmod(F.xxhash64(F.col("item_id").cast("string"), "terms"), F.lit(n_blocks))
    found = [_search_block(spark, index, asked.filter(block == i), k) for i in range(n_blocks)]
    return reduce(DataFrame.unionByName, found)


def _search_block(spark: SparkSession, index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    kind = asked.schema["item_id"].dataType.simpleString()
    queries = asked.toArrow()
    sizes = np.array([len(x) for x in queries["terms"]], dtype=np.int64)
    flat = [np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in queries[c]] or [np.zeros(0, np.int64)]) for c in ("terms", "times")]
    terms, of = np.unique(flat[0].astype(np.int64).view(np.uint64), return_inverse=True)
    # A number per term of these items.
    counted = spark.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(counted.value), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own, held = (_unpacked(batch.column(name)[row].as_buffer(), name) for name in ("terms", "held"))
                at = np.minimum(np.searchsorted(own, counted.value), len(own) - 1)
                total += np.where(own[at] == counted.value, held[at].astype(np.int64), 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["term", "n"])

    df = np.zeros(len(terms), dtype=np.int64)
    with arrow_rows(spark, 1):
        counts = index.select("terms", "held").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    for term, n in counts:
        df[term] = n
    head = index.select("n_docs").head()
    n_docs = head[0] if head else 0
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], dtype=np.int64)
    shared = spark.sparkContext.broadcast((queries["item_id"].combine_chunks(), np.concatenate([[0], np.cumsum(sizes)]), terms, of, flat[1], weight))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, borders, terms, of, times, weight = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * (len(borders) - 1)
        for batch in batches:
            for row in range(batch.num_rows):
                tree = Tree({name: _unpacked(batch.column(name)[row].as_buffer(), name) for name in _TYPES} | {"height": batch.column("height")[row].as_py()})
                rows = tree.rows_of(terms)
                for i, (a, b) in enumerate(zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)):
                    mine = of[a:b]
                    use = (rows[mine] >= 0) & (weight[mine] > 0)
                    if use.any():
                        best[i] = tree.best(rows[mine[use]], (weight[mine] * times[a:b])[use], k, best[i])
        item = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(item):
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int32()), names.take(pa.array(item)), pa.array(np.concatenate([ids for _, ids in best]), pa.int64()),
                 pa.array(np.concatenate([s for s, _ in best]), pa.int64())], ["item", "item_id", "doc_id", "score"])

    # Written here, as the rows of a batch are set for what runs now.
    with arrow_rows(spark, 1):
        near = write_once(index.drop("n_docs").mapInArrow(walk, f"item int, item_id {kind}, doc_id bigint, score bigint"), "near")
    order = [F.desc("score"), F.asc("doc_id")]
    for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))], ["item"]):
        near = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return near.select("item_id", "rank", F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "score")
