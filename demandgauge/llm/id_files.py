"""Token-id files: canonical, length-limited Huffman codes over independent blocks.

Layout of a folder, both parts written and committed by Spark, so any shared store will do:

- ``code``: one row with the code length of every id (a byte each).  Codes follow from the lengths.
- ``blocks``: part, block, start (ids before it in its part), doc_ids, sizes, n, payload (bits, most
  significant first), checkpoints (bit offset of every 256th id).  Parts and blocks ascend by doc_id.

Counts of ids are one aggregate over the corpus; the driver sees one number per id of the vocabulary and
finds the lengths by package-merge.  A block holds whole documents, about ``BLOCK`` ids, or a single
longer one, and is read without any other block.  Decoding walks all checkpoints of a block
side by side, one table look-up per id.

Defined results: a null text counts as empty; documents without ids keep their row; rows with a null
doc_id come first; rows that repeat a doc_id are ordered by their ids; an empty table gives
files without blocks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgauge.llm import words as W
from demandgauge.llm.bpe import WINDOW, WORDS_PATTERN, Pieces

BLOCK, STEP = 1 << 16, 256
#: Blocks (of ``BLOCK`` ids or one document) decoded together: until they have this many ids.
TOGETHER = 1 << 20
_BLOCKS = ("part int, block int, start bigint, doc_ids array<bigint>, sizes array<int>, n bigint, payload binary, "
           "checkpoints array<bigint>")


# --- tokens -------------------------------------------------------------------------------------

_loaded: dict[tuple[int, str], tuple[int, Pieces]] = {}


def tokenizer_ids(spark: SparkSession, tokenizer_file: str, end_id: int, pattern: str):
    """A column function: text -> ids as packed little-endian numbers (see ``number``), ``end_id`` last.

    ``pattern`` is the one by which the tokenizer cuts texts; no token goes beyond a piece, so the library
    encodes each different piece once per worker (see ``Pieces``).  Texts that hold the string of an added token are given
    to the library whole, which makes that token of it.
    """
    with open(tokenizer_file, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("binary")
    def encode(texts: pa.Array) -> pa.Array:
        size, pieces = _tokenizer(content, pattern)
        kind, out = number(max(size, end_id + 1)), []
        end = np.array([end_id], dtype=kind).tobytes()
        for part in W.slices(texts, WINDOW):
            ids, borders = pieces.encode_batch([t or "" for t in part.to_pylist()])
            ids = ids.astype(kind)
            out += [ids[a:b].tobytes() + end for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]
        return pa.array(out, pa.binary())
    return encode


def _tokenizer(content: Broadcast, pattern: str) -> tuple[int, Pieces]:
    """Built once per worker process."""
    key = (hash(content.value), pattern)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        described = json.loads(content.value)
        tokenizer = Tokenizer.from_str(content.value.decode())
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
        before = described["pre_tokenizer"] or {}
        by_bytes = described["normalizer"] is None and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)

        def special(text: str) -> bool:
            return any(token in text for token in added)

        def whole(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            return _flat([x.ids for x in tokenizer.encode_batch([text.decode() for text in texts], add_special_tokens=False)])

        def words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            # Matches of the tokenizer's own pattern: its model is all that is left to apply.
            ids, sizes = [], []
            for tokens in map(model.tokenize, _shown(pieces)):
                ids += [token.id for token in tokens]
                sizes.append(len(tokens))
            return np.array(ids, dtype=np.int32), np.array(sizes, dtype=np.int64)

        def mixed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            if not special(_APART.join(texts).decode(errors="replace")):
                return words(texts)
            found = [(whole if special(text.decode()) else words)([text]) for text in texts]
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))

        model = tokenizer.model
        known = by_bytes and pattern == WORDS_PATTERN
        _loaded.clear()
        _loaded[key] = (tokenizer.get_vocab_size(), Pieces(pattern, mixed, special) if known else Pieces(pattern, whole, lambda text: True))
    return _loaded[key]


def _flat(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(found), dtype=np.int32), np.array([len(x) for x in found], dtype=np.int64)


#: A byte that no UTF-8 has.
_APART = b"\xff"


def _shown_bytes() -> np.ndarray:
    """Byte-level vocabularies write each byte as a character: visible ones as they are, the others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    shown = np.arange(256, dtype="<u4")
    shown[hidden] = 0x100 + np.arange(len(hidden))
    shown[ord(_APART)] = ord("\n")  # a line break itself is written otherwise
    return shown


_SHOWN = _shown_bytes()


def _shown(pieces: list[bytes]) -> list[str]:
    """The pieces as a byte-level vocabulary writes them."""
    return _SHOWN[np.frombuffer(_APART.join(pieces), dtype=np.uint8)].tobytes().decode("utf-32-le").split("\n")


def vocabulary_size(tokenizer_file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file).get_vocab_size()


def number(vocabulary: int) -> str:
    """The least number type that holds all ids."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


# --- code ---------------------------------------------------------------------------------------

def code_lengths(counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code with no length above ``most``, by package-merge; 0 for ids that do not occur."""
    lengths = np.zeros(len(counts), dtype=np.uint8)
    ids = np.flatnonzero(counts)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    most = most or max(16, int(len(ids) - 1).bit_length() + 2)
    if len(ids) > 1 << most:
        raise ValueError("too many ids for this length")
    ids = ids[np.argsort(counts[ids], kind="stable")]
    leaves = counts[ids].astype(np.float64)
    levels, packed = [], np.zeros(0)
    for _ in range(most):
        together = np.concatenate([leaves, packed])
        order = np.argsort(together, kind="stable")
        levels.append(order < len(leaves))
        together = together[order]
        packed = together[:len(together) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(ids) - 2
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:take].sum())
        lengths[ids[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, among equals by id."""
    out = np.zeros(len(lengths), dtype=np.uint64)
    code = 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        ids = np.flatnonzero(lengths == n)
        out[ids] = code + np.arange(len(ids), dtype=np.uint64)
        code += len(ids)
    return out


def pack(ids: np.ndarray, code: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of all ids, and the bit offset of every ``STEP``-th."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    if not len(ids):
        return b"", at
    word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
    value = code[ids] << shift
    first = np.flatnonzero(np.concatenate([[True], np.diff(word) > 0]))
    out = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
    out[word[first]] |= np.bitwise_or.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[:(int(ends[-1]) + 7) // 8], at[::STEP]


class Table:
    """Decoding table: the next ``width`` bits give an id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.width = max(1, int(lengths.max(initial=1)))
        self.id, self.size = np.zeros(1 << self.width, dtype=np.uint32), np.zeros(1 << self.width, dtype=np.int64)
        ids = np.flatnonzero(lengths)
        free = (self.width - lengths[ids].astype(np.int64)).astype(np.uint64)
        begin = (codes(lengths)[ids] << free).astype(np.int64)
        order = np.argsort(begin)
        span = (1 << free.astype(np.int64))[order]
        filled = int(span.sum())
        self.id[:filled] = np.repeat(ids[order], span)
        self.size[:filled] = np.repeat(lengths[ids][order], span)

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        return self.unpack_all([payload], [checkpoints], [n])[0]

    def unpack_all(self, payloads: list[bytes], checkpoints: list[np.ndarray], n: list[int]) -> list[np.ndarray]:
        """The ids of several blocks, walked through together: a step costs hardly more for many checkpoints than for few."""
        if not any(n):
            return [np.zeros(0, dtype=np.uint32) for _ in n]
        room = STEP * self.width // 8 + 16  # the last lane may read on past its end
        padded = [payload + b"\0" * (-len(payload) % 4) for payload in payloads]
        raw = np.frombuffer(b"".join([*padded, b"\0" * (room + -room % 4)]), dtype=">u4").astype(np.uint64)
        first = np.cumsum([0, *map(len, padded)]) * 8
        at = np.concatenate([np.asarray(own, dtype=np.int64) + begin for own, begin in zip(checkpoints, first[:-1], strict=True)])
        # Lanes of earlier blocks may read on into the next one; what they find there is cut off below.
        steps = min(STEP, max(n))
        out = np.empty((steps, len(at)), dtype=np.uint32)
        mask, width = np.uint64((1 << self.width) - 1), 64 - self.width
        for i in range(steps):
            word = at >> 5
            bits = ((raw[word] << np.uint64(32) | raw[word + 1]) >> (width - (at & 31)).astype(np.uint64)) & mask
            out[i] = self.id[bits]
            at = at + self.size[bits]
        lanes = np.cumsum([0, *map(len, checkpoints)])
        return [out[:, a:b].T.ravel()[:size] for a, b, size in zip(lanes[:-1], lanes[1:], n, strict=True)]


# --- files --------------------------------------------------------------------------------------

def _packed(rows: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all rows of a binary array, one after another; null rows have none."""
    rows = rows.drop_null()
    if not len(rows):
        return np.zeros(0, dtype=kind)
    ends = np.frombuffer(rows.buffers()[1], dtype=np.int32 if pa.types.is_binary(rows.type) else np.int64)[rows.offset:rows.offset + len(rows) + 1]
    return np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]].view(kind)


def id_counts(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: counted per batch in the tasks, summed by Spark; one number per id comes back."""
    kind = number(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            numbers = _packed(batch.column(0), kind)
            for at in range(0, len(numbers), TOGETHER):
                total += np.bincount(numbers[at:at + TOGETHER], minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["id", "n"])

    out = np.zeros(vocabulary, dtype=np.int64)
    for i, n in ids.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n")).collect():
        out[i] = n
    return out


def write_ids(ids: DataFrame, path: str, vocabulary: int, doc_id: str = "doc_id") -> None:
    """Write packed ``ids`` in ascending order of ``doc_id``."""
    spark, kind = ids.sparkSession, number(vocabulary)
    lengths = code_lengths(id_counts(ids, vocabulary))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast((codes(lengths), lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        names, held, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, names, held, size
            every = np.concatenate(held)
            payload, checkpoints = pack(every, *code.value)
            row = {"part": part, "block": block, "start": start, "doc_ids": names, "sizes": [len(x) for x in held], "n": size,
                   "payload": payload, "checkpoints": checkpoints.tolist()}
            block, start, names, held, size = block + 1, start + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for name, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(row.as_buffer(), dtype=kind) if row.is_valid else np.zeros(0, dtype=kind)
                if size and size + len(own) > BLOCK:
                    yield flush()
                names.append(name)
                held.append(own)
                size += len(own)
        if names:
            yield flush()

    schema = pa.schema([
        ("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
        ("n", pa.int64()), ("payload", pa.binary()), ("checkpoints", pa.list_(pa.int64()))])
    ordered = ids.select(F.col(doc_id).cast("bigint").alias("doc_id"), "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(blocks, _BLOCKS).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): ``start`` counts the ids of all documents before, ``ids`` are packed unsigned 32-bit numbers."""
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").head()["lengths"], dtype=np.uint8)
    # One number per part, as many as the writing job had partitions.
    sums = sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    before = dict(zip((p for p, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False))
    shared = spark.sparkContext.broadcast((lengths, before))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = shared.value
        table = Table(lengths)
        for batch in batches:
            sizes, at = batch.column("n").to_numpy(), 0
            while at < batch.num_rows:
                # As many blocks as stay within TOGETHER, one at least.
                some = batch.slice(at, max(1, int(np.searchsorted(np.cumsum(sizes[at:]), TOGETHER, side="right"))))
                at += some.num_rows
                rows = some.to_pylist()
                found = table.unpack_all([r["payload"] for r in rows], [np.array(r["checkpoints"], dtype=np.int64) for r in rows], [r["n"] for r in rows])
                for row, ids in zip(rows, found, strict=True):
                    ends = np.cumsum(row["sizes"])
                    data = ids.astype("<u4").tobytes()
                    borders = [0, *(4 * ends).tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"], pa.int64()), pa.array(before[row["part"]] + row["start"] + ends - row["sizes"], pa.int64()),
                         pa.array([data[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)], pa.binary())], ["doc_id", "start", "ids"])

    return blocks.mapInArrow(documents, "doc_id bigint, start bigint, ids binary")
