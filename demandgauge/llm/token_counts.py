"""Token counts of a sentencepiece BPE model, huge documents in overlapping chunks that are spliced where they agree.

A text of up to ``CHUNK`` characters is encoded whole.  A longer one is cut into chunks of ``CHUNK``
characters that reach ``OVERLAP`` characters into the next; chunks are spread over the cluster, encoded
with offsets, and two neighbours are spliced after a token that both have at the same place.

Why one common token is enough: BPE merges pairs in a fixed order (score, then place), so if no
merge crosses a place, the merges on each side are those of that side by itself.  Hence every border in the
encoding of a string splits it into two encodings, and two encodings may be put next to each other if their
last and first token, encoded together, stay these two.  Let a token span [p, q) in the chunks A and B.  Then A up
to q and B from p on are encodings; the token is followed in B by a token it can stand next to; so A up to q
and B from q on together are the encoding of both.  Where B begins, or the blank that the library puts there, does not
matter for this.  Seams are chained in order, since overlaps do not touch.

Texts with a seam where nothing agrees (long runs of one character out of step) are cut again, chunk and overlap
``WIDER`` times as long, until they agree or one chunk holds the whole text.  So every count is exact.

Defined results: a null or empty text has 0 bytes and 0 tokens; rows that repeat an id or a text all stay, ties cannot
occur; an empty table gives no rows; columns of the input named ``n_bytes`` or ``n_tokens`` are replaced, all others stay.
The model must not change characters (identity normalisation) nor have unused or user-defined pieces; else an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgauge.llm import words as W
from demandgauge.llm.shared import write_once

CHUNK, OVERLAP, WIDER = 1 << 15, 1 << 9, 4
#: Bytes of texts that the library is given at once.
BATCH = 1 << 19
_KEY = ["_text1", "_text2"]
_ENCODED = "struct<n:bigint,head:array<bigint>,head_rank:array<int>,tail:array<bigint>,tail_rank:array<int>>"


class Pieces:
    """The library with the number of characters that each id stands for."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        probe = "ﬁ  Å　\t "
        size = self.library.get_piece_size()
        if self.library.normalize(probe) != "▁" + probe.replace(" ", "▁") or any(map(self.library.is_unused, range(size))):
            raise ValueError("the model changes characters or has unused pieces")
        self.characters = np.array([self._characters(i) for i in range(size)], dtype=np.int64)

    def _characters(self, i: int) -> int:
        """A byte counts as a character unless it continues one."""
        piece = self.library.id_to_piece(i)
        return len(piece) if not self.library.is_byte(i) else int(not 0x80 <= int(piece[3:5], 16) < 0xC0)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.library.encode(texts, num_threads=1)]

    def ends(self, text: str) -> np.ndarray:
        """Where each token ends in ``text``; the blank put in front ends at 0."""
        return np.cumsum(self.characters[np.array(self.library.encode(text), dtype=np.int64)]) - 1


_loaded: dict[int, Pieces] = {}


def _pieces(model: Broadcast) -> Pieces:
    """Loaded once per worker process."""
    key = hash(model.value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model.value)
    return _loaded[key]


def _zone(ends: np.ndarray, start: int, stop: int) -> tuple[list[int], list[int]]:
    """Tokens within [start, stop): their place as one number, and how many tokens there are up to each."""
    begins = np.concatenate([[-1], ends[:-1]])
    at = np.flatnonzero((begins >= start) & (ends <= stop) & (ends > begins))
    return ((begins[at] - start << 31) + ends[at] - start).tolist(), (at + 1).tolist()


def _chunks(huge: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """(key, i, last, chunk): cut in one pass over each text."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, text in zip(*(batch.column(j) for j in range(3)), strict=True):
                text = text.as_py()
                n = max(1, -(-(len(text) - overlap) // size))
                for i in range(n):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([one.as_py()], pa.int64()), pa.array([two.as_py()], pa.int64()), pa.array([i], pa.int32()),
                         pa.array([i == n - 1]), pa.array([text[i * size:(i + 1) * size + overlap]], pa.string())], names)
    names = [*_KEY, "_i", "_last", "_chunk"]
    return huge.select(*_KEY, text).mapInArrow(cut, "_text1 bigint, _text2 bigint, _i int, _last boolean, _chunk string")


def _encoder(model: Broadcast, size: int, overlap: int):
    @F.arrow_udf(_ENCODED)
    def encode(chunks: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        pieces, out = _pieces(model), []
        for chunk, is_first, is_last in zip(chunks, first, last, strict=True):
            ends = pieces.ends(chunk.as_py())
            head, head_rank = ([], []) if is_first.as_py() else _zone(ends, 0, overlap)
            tail, tail_rank = ([], []) if is_last.as_py() else _zone(ends, size, size + overlap)
            out.append({"n": len(ends), "head": head, "head_rank": head_rank, "tail": tail, "tail_rank": tail_rank})
        return pa.array(out, kind)
    kind = pa.struct([("n", pa.int64()), ("head", pa.list_(pa.int64())), ("head_rank", pa.list_(pa.int32())),
                      ("tail", pa.list_(pa.int64())), ("tail_rank", pa.list_(pa.int32()))])
    return encode


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): null where two neighbours have no token in common."""
    left = encoded.filter("NOT _last").select(*_KEY, (F.col("_i") + 1).alias("_i"), "n", "tail", "tail_rank")
    right = encoded.filter("_i > 0").select(*_KEY, "_i", "head", "head_rank")
    common = F.array_min(F.array_intersect("tail", "head"))
    seams = left.join(right, [*_KEY, "_i"]).select(*_KEY, "n", "tail", "tail_rank", "head", "head_rank", common.alias("common")).select(
        *_KEY, F.when(F.col("common").isNotNull(), F.expr(
            "tail_rank[int(array_position(tail, common)) - 1] - n - head_rank[int(array_position(head, common)) - 1]")).alias("n"))
    summed = encoded.select(*_KEY, "n").unionByName(seams).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.count_if(F.col("n").isNull()).alias("open"))
    return summed.select(*_KEY, F.when(F.col("open") == 0, F.col("n")).alias("n_tokens"))


def _huge_counts(huge: DataFrame, model: Broadcast, text: str, size: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of each different text."""
    settled = []
    while True:
        encode = _encoder(model, size, overlap)
        # Dealt out by chunk, so one huge text is work for many tasks.
        dealt = _chunks(huge, text, size, overlap).repartition(*_KEY, "_i")
        encoded = write_once(
            dealt.select(*_KEY, "_i", "_last", encode("_chunk", F.col("_i") == 0, F.col("_last")).alias("e"))
            .select(*_KEY, "_i", "_last", "e.*"), "chunks").dropDuplicates([*_KEY, "_i"])
        counted = write_once(_spliced(encoded), "spliced")
        settled.append(counted.filter("n_tokens IS NOT NULL"))
        open_ = counted.filter("n_tokens IS NULL").select(*_KEY)
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, settled)
        huge, size, overlap = huge.join(open_, _KEY, "left_semi"), size * WIDER, overlap * WIDER


def count_tokens(docs: DataFrame, model_file: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes`` (UTF-8) and ``n_tokens`` of their whole text."""
    if not 0 < overlap <= chunk:
        raise ValueError("an overlap is at least one character and at most a chunk")
    with open(model_file, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        pieces = _pieces(model)
        return pa.array([n for part in W.slices(texts, BATCH) for n in pieces.counts([t or "" for t in part.to_pylist()])], pa.int64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes")
    is_huge = F.coalesce(F.length(text) > chunk, F.lit(False))
    small = docs.filter(~is_huge).select(*kept, n_bytes, count(F.col(text)).alias("n_tokens"))
    huge = docs.filter(is_huge).withColumns({
        "_text1": F.xxhash64(text), "_text2": F.xxhash64(F.lit("\u0001"), F.col(text), F.length(text))})
    counted = _huge_counts(huge, model, text, chunk, overlap)
    return small.unionByName(huge.join(counted.withColumnRenamed("n_tokens", "_n"), _KEY).select(
        *kept, n_bytes, F.col("_n").alias("n_tokens")))
