"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``, found by divide and conquer in linear space.

Every row of a conversation is kept, given another role, or deleted; rows with empty text may be inserted before
any row and at the end.  What is repaired so far is one of four states (nothing, system, user, assistant last).  A row is
an edge table between states: cost and edits for each pair.  Costs up to a row are a vector of four, forward from
the start and backward from the end.  Both meet in the middle of a conversation; of the crossing states whose
sum is least, the one whose edits so far come first in ASCII order is chosen, and both halves are solved alike until
single rows remain.  To know which comes first without keeping any edits, the forward vector carries with each cost the
place of its edits among those of the four states: edits up to a row end in that row's own edit, so none is the
beginning of another.  All conversations of a batch are worked through side by side in numpy.

Distribution: rows are range-partitioned by conversation and order within it, so a conversation of any size
spreads over tasks.  A conversation inside one task is solved there.  One that crosses a border, or is longer than
a block, is cut into blocks; a block is again an edge table (4 x 4 costs and places), so the same procedure finds
the states at the borders from these tables alone, and the blocks are then solved independently.  The digest of a whole
conversation is by its definition one chain; blocks pass through it in order, one at a time.

Faults (the first that holds counts): blank, duplicate (role and text seen earlier in the conversation), truncated.

Defined results: null roles and texts count as one space; rows with a null turn come first; rows of one turn are ordered
by role, then the first 64 characters of the text, then its hash; equal rows are duplicates of the first of them; rows with a
null conversation are one conversation; an empty text is blank; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgauge.llm.shared import write_once

#: A block ends after so many rows or bytes of text (a single longer text is a block by itself).
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 22
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_SPACE = " \t\n\u000b\f\r"
_FAR = 1 << 40
_NEXT = {_NOTHING: _USER, _SYSTEM: _USER, _USER: _ASSISTANT, _ASSISTANT: _USER}
_NAME = {_USER: "user", _ASSISTANT: "assistant"}


@dataclass
class Edges:
    """Edge tables: cost and place of the edits for each (table, state before, state after)."""

    cost: np.ndarray
    place: np.ndarray


def _row_edits(initial: str, must_go: bool, truncated: bool) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, after) -> (cost, edits) of one row with the insertions before it."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        at = before
        for inserted in range(3):
            steps = [(DELETE, "D", at)]
            if not must_go:
                more = TRUNCATED if truncated else 0
                steps.append((REROLE + more, "R", _NEXT[at]))
                if initial == "s" and at == _NOTHING:
                    steps.append((KEEP + more, "K", _SYSTEM))
                if (initial == "u" and _NEXT[at] == _USER) or (initial == "a" and _NEXT[at] == _ASSISTANT):
                    steps.append((KEEP + more, "K", _NEXT[at]))
            for cost, edit, after in steps:
                found = (INSERT * inserted + cost, "I" * inserted + edit)
                best[before, after] = min(best.get((before, after), found), found)
            at = _NEXT[at]
    return best


_INITIALS = ("s", "u", "a", "")
#: Row tables by 3 * initial + fault kind (0 sound, 1 to be deleted, 2 truncated), then the end of a conversation, then a step that changes nothing.
EDITS = [_row_edits(i, fault == 1, fault == 2) for i in _INITIALS for fault in range(3)]
END, STAY = len(EDITS), len(EDITS) + 1
EDITS += [{(s, _ASSISTANT): (INSERT * n, "I" * n) for s, n in ((_NOTHING, 0), (_SYSTEM, 2), (_USER, 1), (_ASSISTANT, 0))},
          {(s, s): (0, "") for s in range(4)}]


def _edges() -> Edges:
    words = sorted({w for table in EDITS for _, w in table.values()})
    cost, place = np.full((len(EDITS), 4, 4), _FAR), np.zeros((len(EDITS), 4, 4), dtype=np.int64)
    for i, table in enumerate(EDITS):
        for (before, after), (c, w) in table.items():
            cost[i, before, after], place[i, before, after] = c, words.index(w)
    return Edges(cost, place)


ROWS = _edges()


def _forward(edges: Edges, tables: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``tables`` (runs x steps) from state ``start`` of each run: least costs, and the places of their edits."""
    cost = np.full((len(start), 4), _FAR)
    cost[np.arange(len(start)), start] = 0
    place = np.zeros((len(start), 4), dtype=np.int64)
    for step in tables.T:
        # One number orders by cost, then by earlier edits, then by this row's.
        key = (np.minimum(cost[:, :, None] + edges.cost[step], _FAR) << 10 | place[:, :, None] << 6 | edges.place[step]).min(axis=1)
        cost, edits = key >> 10, key & 1023
        place = (edits[:, None, :] < edits[:, :, None]).sum(axis=2)
    return cost, place


def _backward(edges: Edges, tables: np.ndarray, end: np.ndarray) -> np.ndarray:
    cost = np.full((len(end), 4), _FAR)
    cost[np.arange(len(end)), end] = 0
    for step in tables.T[::-1]:
        cost = np.minimum((edges.cost[step] + cost[:, None, :]).min(axis=2), _FAR)
    return cost


def _rectangle(tables: np.ndarray, low: np.ndarray, high: np.ndarray, stay: int) -> np.ndarray:
    """The runs low..high of ``tables`` side by side, shorter ones filled up."""
    at = low[:, None] + np.arange(int((high - low).max()))
    return np.where(at < high[:, None], tables[np.minimum(at, len(tables) - 1)], stay)


def solve(edges: Edges, stay: int, tables: np.ndarray, borders: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state after each step: run i is ``tables[borders[i]:borders[i + 1]]``, from ``start[i]`` to ``end[i]``."""
    after = np.zeros(len(tables), dtype=np.int64)
    some = np.flatnonzero(np.diff(borders))
    low, high, start, end = borders[:-1][some], borders[1:][some], start[some], end[some]
    after[high - 1] = end
    while (long := high - low > 1).any():
        low, high, start, end = low[long], high[long], start[long], end[long]
        middle, crossing = (low + high) // 2, np.zeros(len(low), dtype=np.int64)
        size = np.ceil(np.log2(high - low)).astype(int)
        for n in np.unique(size):  # runs of like length together
            i = np.flatnonzero(size == n)
            cost, place = _forward(edges, _rectangle(tables, low[i], middle[i], stay), start[i])
            total = cost + _backward(edges, _rectangle(tables, middle[i], high[i], stay), end[i])
            crossing[i] = np.where(total == total.min(axis=1, keepdims=True), place, 4).argmin(axis=1)
        after[middle - 1] = crossing
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
        start, end = np.concatenate([start, crossing]), np.concatenate([crossing, end])
    return after


def block_edges(tables: np.ndarray) -> tuple[list[int], list[int]]:
    """Costs and places of a block of rows as one step, 16 each."""
    cost, place = _forward(ROWS, np.tile(tables, (4, 1)), np.arange(4))
    return cost.ravel().tolist(), place.ravel().tolist()


def before(after: np.ndarray, borders: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state before each step."""
    out = np.concatenate([[0], after[:-1]]) if len(after) else after
    some = np.flatnonzero(np.diff(borders))
    out[borders[:-1][some]] = start[some]
    return out


def repaired_lines(table: int, before: int, after: int, role: str, text: str) -> tuple[str, list[str]]:
    """Edits of one row (or of the end) and the lines they give."""
    edits, at, lines = EDITS[table][before, after][1], before, []
    for edit in edits:
        if edit == "I":
            at = _NEXT[at]
            lines.append(f"{_NAME[at]}:")
        elif edit == "K":
            lines.append(f"{role}:{text}")
        elif edit == "R":
            lines.append(f"{_NAME[_NEXT[at]]}:{text}")
    return edits, lines


# --- one partition of ordered rows -----------------------------------------------------------------

_BLOCK = [
    ("part", pa.int32(), "int"), ("seq", pa.int32(), "int"), ("whole", pa.bool_(), "boolean"), ("n_turns", pa.int64(), "bigint"),
    ("first_turn", pa.int64(), "bigint"), ("last_turn", pa.int64(), "bigint"), ("blank", pa.int64(), "bigint"),
    ("duplicate", pa.int64(), "bigint"), ("truncated", pa.int64(), "bigint"), ("illegal", pa.int64(), "bigint"),
    ("first_role", pa.int32(), "int"), ("last_role", pa.int32(), "int"), ("cost", pa.int64(), "bigint"), ("audit", pa.string(), "string"),
    ("sha", pa.string(), "string"), ("costs", pa.list_(pa.int64()), "array<bigint>"), ("places", pa.list_(pa.int64()), "array<bigint>"),
    ("tables", pa.list_(pa.int32()), "array<int>"), ("roles", pa.list_(pa.string()), "array<string>"), ("texts", pa.list_(pa.string()), "array<string>")]
_COLUMNS = ["conv", "turn", "role", "text", "is_row", "initial", "blank", "truncated"]


def _legal(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Roles by number: s 0, u 1, a 2, another 3."""
    return ((first == 0) & (second == 1)) | ((first == 1) & (second == 2)) | ((first == 2) & (second == 1))


class _Partition:
    """Turns a stream of ordered rows into finished conversations and blocks of unfinished ones."""

    def __init__(self, part: int, block_rows: int, block_bytes: int):
        self.part, self.rows, self.bytes, self.seq, self.opened, self.schema = part, block_rows, block_bytes, 0, True, None

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marked = None, False
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            is_row = rows["is_row"].to_numpy()
            # A marker stands right before the first of equal rows.
            first = np.concatenate([[not marked], is_row[:-1]]) == 0
            marked = not is_row[-1] if len(is_row) else marked
            rows = rows.append_column("first", pa.array(first)).filter(rows["is_row"])
            held = rows if held is None else pa.concat_tables([held, rows])
            starts = self._starts(held)
            if len(starts):
                yield from self._finish(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
            while held.num_rows > self.rows or held["text"].nbytes > self.bytes and held.num_rows > 1:
                n = self._fitting(held)
                if n >= held.num_rows:
                    break
                yield self._batch([self._open(held.slice(0, n))])
                self.opened, held = True, held.slice(n)
        if held is not None and held.num_rows:
            yield self._batch([self._open(held)])

    @staticmethod
    def _starts(rows: pa.Table) -> np.ndarray:
        """Where a conversation begins that is not the first one."""
        if not rows.num_rows:
            return np.zeros(0, dtype=np.int64)
        codes = rows["conv"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1])

    def _fitting(self, rows: pa.Table) -> int:
        sizes = np.cumsum(pc.binary_length(rows["text"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64))
        return max(1, min(self.rows, int(np.searchsorted(sizes, self.bytes, "right"))))

    def _finish(self, rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Conversations that end within this partition; the first may have begun before it or be in blocks already."""
        if len(starts) and self.opened:
            end = starts[1] if len(starts) > 1 else rows.num_rows
            yield self._batch([self._open(rows.slice(0, end))])
            rows, starts, self.opened = rows.slice(end), starts[1:] - end, False
        if rows.num_rows:
            yield self._batch(self._solved(rows, np.concatenate([starts, [rows.num_rows]])))

    def _measures(self, rows: pa.Table, borders: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        """Tables of the rows, and what is counted of each run of them."""
        initial, blank, truncated = (rows[c].to_numpy() for c in ("initial", "blank", "truncated"))
        again = ~rows["first"].to_numpy() & ~blank
        cut = truncated & ~blank & ~again
        tables = 3 * initial + np.where(blank | again, 1, np.where(cut, 2, 0))
        turn = pc.fill_null(rows["turn"], 0).to_numpy()
        known = rows["turn"].is_valid().to_numpy()
        new = np.concatenate([[True], (turn[1:] != turn[:-1]) | ~known[:-1]])[:len(turn)]
        wrong = np.concatenate([~_legal(initial[:-1], initial[1:]), [False]])[:len(turn)]
        out = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            turns = turn[a:b][known[a:b]]
            n_turns = int((new[a:b] & known[a:b]).sum()) + int(len(turns) > 0 and bool(known[a]) and not new[a])
            out.append({
                "conv": rows["conv"][a].as_py(), "part": self.part, "n_turns": n_turns,
                "first_turn": int(turns[0]) if len(turns) else None, "last_turn": int(turns[-1]) if len(turns) else None,
                "blank": int(blank[a:b].sum()), "duplicate": int(again[a:b].sum()), "truncated": int(cut[a:b].sum()),
                "illegal": int(wrong[a:b - 1].sum()), "first_role": int(initial[a]), "last_role": int(initial[b - 1])})
        return tables, out

    def _open(self, rows: pa.Table) -> dict:
        tables, (row,) = self._measures(rows, np.array([0, rows.num_rows]))
        costs, places = block_edges(tables)
        self.seq += 1
        return row | {"seq": self.seq, "whole": False, "costs": costs, "places": places, "tables": tables.tolist(),
                      "roles": rows["role"].to_pylist(), "texts": rows["text"].to_pylist()}

    def _solved(self, rows: pa.Table, borders: np.ndarray) -> list[dict]:
        tables, out = self._measures(rows, borders)
        n = len(borders) - 1
        steps = np.insert(tables, borders[1:], END)
        ends = borders + np.arange(n + 1)
        after = solve(ROWS, STAY, steps, ends, np.full(n, _NOTHING), np.full(n, _ASSISTANT))
        prior = before(after, ends, np.full(n, _NOTHING))
        cost = ROWS.cost[steps, prior, after]
        roles, texts = rows["role"].to_pylist(), rows["text"].to_pylist()
        for i, row in enumerate(out):
            audit, lines = [], []
            for k in range(ends[i], ends[i + 1]):
                j = k - i if k + 1 < ends[i + 1] else None
                edits, more = repaired_lines(
                    int(steps[k]), int(prior[k]), int(after[k]), roles[j] if j is not None else "", texts[j] if j is not None else "")
                audit.append(edits)
                lines += more
            row |= {"whole": True, "cost": int(cost[ends[i]:ends[i + 1]].sum()), "audit": "".join(audit),
                    "sha": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
        return out

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, self.schema)


# --- the whole table --------------------------------------------------------------------------------

def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``gaps``: turns missing between the first and the last; ``illegal``: neighbouring roles that may not follow each other;
    ``audit``: one letter per edit, in order; the digest is of the repaired lines ``role:text``.
    """
    kind = rows.schema[conv_id].dataType
    blocks = write_once(_blocks(rows, conv_id, turn, role, text, block_rows, block_bytes), "dialogue")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("bigint").alias("gaps")
    columns = [F.col("conv").cast(kind).alias(conv_id), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha").alias("repaired_sha256")]
    return blocks.filter("whole").unionByName(_joined(blocks.filter("NOT whole"), blocks), allowMissingColumns=True).select(*columns)


def _blocks(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, block_rows: int, block_bytes: int) -> DataFrame:
    said, saying = F.coalesce(F.col(role).cast("string"), F.lit(" ")), F.coalesce(F.col(text).cast("string"), F.lit(" "))
    plain = rows.select(F.col(conv_id).alias("conv"), F.col(turn).cast("bigint").alias("turn"), said.alias("role"), saying.alias("text"))
    # The input partition splits equal rows further, so even those need not meet in one task.
    keyed = plain.select(
        "*", F.substring("text", 1, 64).alias("begin"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64("text", F.lit("\u0001"), "role", F.length("text")).alias("h2"), F.spark_partition_id().alias("origin"))
    markers = keyed.groupBy("conv", "role", "begin", "h1", "h2").agg(F.min(F.struct("turn", "origin")).alias("m")).select(
        "conv", "m.turn", "role", F.lit("").alias("text"), "begin", "h1", "h2", "m.origin", F.lit(False).alias("is_row"))
    trimmed = F.rtrim("text", F.lit(_SPACE))
    initial = F.expr("coalesce(cast(array_position(array('s', 'u', 'a'), substring(role, 1, 1)) as int), 0)")
    order = ["conv", "turn", "role", "begin", "h1", "h2", "origin"]
    ordered = keyed.withColumn("is_row", F.lit(True)).unionByName(markers).repartitionByRange(*order).sortWithinPartitions(*order, "is_row").select(
        "conv", "turn", "role", "text", "is_row", F.when(initial > 0, initial - 1).otherwise(3).alias("initial"),
        (trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def noted():
            for batch in batches:
                if not known:
                    known.append(pa.schema([("conv", batch.schema.field("conv").type), *((n, t) for n, t, _ in _BLOCK)]))
                    partition.schema = known[0]
                yield batch
        known: list[pa.Schema] = []
        partition = _Partition(TaskContext.get().partitionId(), block_rows, block_bytes)
        yield from partition.run(noted())

    return ordered.mapInArrow(scan, f"conv {plain.schema['conv'].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, _, k in _BLOCK))


def _in_order(df: DataFrame, fold, schema: str) -> DataFrame:
    """``fold`` sees the rows of each conversation in order, one after another."""
    return df.repartition("conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(fold, schema)


def _joined(open_: DataFrame, blocks: DataFrame) -> DataFrame:
    """Results of the conversations in blocks."""
    kind = blocks.schema["conv"].dataType.simpleString()

    def crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _conversations(batches):
            stay, n = len(rows) + 1, len(rows)
            shape = (n, 4, 4)
            edges = Edges(
                np.concatenate([np.array([r["costs"] for r in rows]).reshape(shape), ROWS.cost[[END, STAY]]]),
                np.concatenate([np.array([r["places"] for r in rows]).reshape(shape), ROWS.place[[END, STAY]]]))
            ends, begin = np.array([0, n + 1]), np.array([_NOTHING])
            after = solve(edges, stay, np.arange(n + 1), ends, begin, np.array([_ASSISTANT]))
            prior = before(after, ends, begin)
            yield pa.RecordBatch.from_pydict({
                "conv": pa.array([r["conv"] for r in rows], batch_type[0]), "part": pa.array([r["part"] for r in rows], pa.int32()),
                "seq": pa.array([r["seq"] for r in rows], pa.int32()), "before": pa.array(prior[:n], pa.int32()), "after": pa.array(after[:n], pa.int32()),
                "last": pa.array([i == n - 1 for i in range(n)])})

    batch_type: list[pa.DataType] = []

    def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        rows: list[dict] = []
        for batch in batches:
            batch_type[:] = [batch.schema.field("conv").type]
            for row in batch.to_pylist():
                if rows and row["conv"] != rows[0]["conv"]:
                    yield rows
                    rows = []
                rows.append(row)
        if rows:
            yield rows

    states = _in_order(open_.select("conv", "part", "seq", "costs", "places"), crossings,
                       f"conv {kind}, part int, seq int, before int, after int, last boolean").select(
        F.col("conv").alias("of"), F.col("part").alias("p"), F.col("seq").alias("s"), "before", "after", "last")
    # Part and number of a block name it; the conversation need not be compared.
    placed = open_.join(states, (F.col("part") == F.col("p")) & (F.col("seq") == F.col("s")))
    small = ["part", "seq", "n_turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal", "first_role", "last_role"]

    def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                tables, ends = np.array(row["tables"]), np.array([0, len(row["tables"])])
                begin = np.array([row["before"]])
                after = solve(ROWS, STAY, tables, ends, begin, np.array([row["after"]]))
                prior = before(after, ends, begin)
                done = [repaired_lines(*x) for x in zip(tables.tolist(), prior.tolist(), after.tolist(), row["roles"], row["texts"], strict=True)]
                cost = int(ROWS.cost[tables, prior, after].sum())
                if row["last"]:
                    done.append(repaired_lines(END, row["after"], _ASSISTANT, "", ""))
                    cost += int(ROWS.cost[END, row["after"], _ASSISTANT])
                lines = [line for _, more in done for line in more]
                out.append("\n".join(lines) if lines else None)
                costs.append(cost)
                audits.append("".join(edits for edits, _ in done))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), *(batch.column(c) for c in small), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(out, pa.string())],
                ["conv", *small, "cost", "audit", "lines"])
            costs.clear()
            audits.clear()

    costs: list[int] = []
    audits: list[str] = []
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = f"conv {kind}, " + ", ".join(f"{c} {types[c]}" for c in small) + ", cost bigint, audit string, lines string"
    written = placed.select("conv", *small, "tables", "roles", "texts", "before", "after", "last").mapInArrow(write_out, schema)
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]
    final = ["n_turns", "first_turn", "last_turn", *sums]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if now is not None and row["conv"] != now["conv"]:
                    yield finished(now, digest, batch.schema.field("conv").type)
                    now = None
                if now is None:
                    now, digest = row | {"audit": [row["audit"]], "some": row["lines"] is not None}, hashlib.sha256((row["lines"] or "").encode())
                else:
                    now["n_turns"] += row["n_turns"] - (row["first_turn"] is not None and row["first_turn"] == now["last_turn"])
                    now["illegal"] += int(not _legal(np.array(now["last_role"]), np.array(row["first_role"])))
                    for c in sums:
                        now[c] += row[c]
                    now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                    now["last_turn"] = now["last_turn"] if row["last_turn"] is None else row["last_turn"]
                    now["last_role"] = row["last_role"]
                    now["audit"].append(row["audit"])
                    if row["lines"] is not None:
                        digest.update((("\n" if now["some"] else "") + row["lines"]).encode())
                        now["some"] = True
            last_type = batch.schema.field("conv").type
        if now is not None:
            yield finished(now, digest, last_type)

    def finished(now: dict, digest, conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{"conv": now["conv"], **{c: now[c] for c in final}, "audit": "".join(now["audit"]), "sha": digest.hexdigest()}],
            pa.schema([("conv", conv_type), *((c, pa.int64()) for c in final), ("audit", pa.string()), ("sha", pa.string())]))

    return _in_order(written, chain, f"conv {kind}, " + ", ".join(f"{c} bigint" for c in final) + ", audit string, sha string")
