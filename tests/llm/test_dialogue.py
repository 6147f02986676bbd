"""Conversation repair against a plain search over all edits that keeps every audit as text."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgauge.llm import dialogue as D
from demandgauge.llm.queries import op12_dialogue

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of one conversation's ordered rows (turn, role, text)."""
    faults, seen = [], set()
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    # State: the initials so far, as "", "s", "u", "a"; value: least (cost, audit, lines).
    def inserts(states):
        states = dict(states)
        for _ in range(4):
            for at, (cost, audit, lines) in list(states.items()):
                to, name = ("a", "assistant") if at == "u" else ("u", "user")
                found = (cost + 5, audit + "I", (*lines, name + ":"))
                states[to] = min(states.get(to, found), found)
        return states

    def better(states, to, found):
        states[to] = min(states.get(to, found), found)

    # All audits of like cost matter until their row is done: compare complete prefixes only.
    states = {"": (0, "", ())}
    for (_, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for at, begun in states.items():
            for n in range(4):
                cost, audit, lines, here = *begun, at
                for _ in range(n):
                    here = "a" if here == "u" else "u"
                    cost, audit, lines = cost + 5, audit + "I", (*lines, ("user:" if here == "u" else "assistant:"))
                better(after, here, (cost + 2, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault == "truncated" else 0
                to, name = ("a", "assistant") if here == "u" else ("u", "user")
                better(after, to, (cost + 1 + more, audit + "R", (*lines, f"{name}:{text}")))
                if role[:1] == to or (role[:1] == "s" and here == ""):
                    better(after, role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
        states = after
    final = inserts(states)
    cost, audit, lines = min(final[s] for s in ("", "a") if s in final)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
            faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_rows(rng, n):
    texts = ["Yes.", "No?", "cut off", "", " \t", "Why! ", "é.", "long " * 5 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", " "]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) + rng.choice(["", f"{rng.randrange(9)}.", "x"])) for _ in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def compare(spark, conversations, **limits):
    data = [(c, *r) for c, rows in conversations.items() for r in rows]
    random.Random(4).shuffle(data)
    got = {r.conv_id: tuple(r)[1:] for r in D.repair(spark.createDataFrame(data, SCHEMA), **limits).collect()}
    assert got == {c: plain(in_order(rows)) for c, rows in conversations.items()}


def test_equals_plain_search(spark):
    rng = random.Random(1)
    compare(spark, {c if c else None: random_rows(rng, rng.randrange(1, 14)) for c in range(400)})


@pytest.mark.parametrize(("rows", "size"), [(3, 1 << 22), (7, 40)])
def test_blocks_and_one_hot_conversation(spark, rows, size):
    rng = random.Random(2)
    compare(spark, {**{c: random_rows(rng, rng.randrange(1, 6)) for c in range(60)}, 100: random_rows(rng, 400), 101: random_rows(rng, 50)},
            block_rows=rows, block_bytes=size)


def test_many_equal_rows_spread(spark):
    compare(spark, {1: [(1, "user", "Same.")] * 300 + [(2, "assistant", "Well.")], 2: [(None, "user", "Hi.")] * 2})


def test_crossing_prefers_the_least_audit():
    """Divide and conquer gives the edits that a forward search with whole texts gives, for all short conversations."""
    rng = np.random.Generator(np.random.PCG64(5))
    for n in range(1, 9):
        tables = np.append(rng.integers(0, D.END, n), D.END)
        begin, borders = np.array([0]), np.array([0, n + 1])
        after = D.solve(D.ROWS, D.STAY, tables, borders, begin, np.array([3]))
        prior = D.before(after, borders, begin)
        audit = "".join(D.EDITS[t][a, b][1] for t, a, b in zip(tables, prior, after, strict=True))
        states = {0: (0, "")}
        for t in tables:
            step = {}
            for s, (cost, words) in states.items():
                for (a, b), (more, edits) in D.EDITS[t].items():
                    if a == s:
                        step[b] = min(step.get(b, (1 << 60, "")), (cost + more, words + edits))
            states = step
        assert audit == states[3][1]


def test_nulls_empty_table_and_other_columns(spark):
    data = [(1, None, None, None), (1, 2, "user", "Hi."), (None, 1, "user", None)]
    got = {r.conv_id: r for r in D.repair(spark.createDataFrame(data, SCHEMA).withColumns({"conv": F.lit(1), "part": F.lit("x")})).collect()}
    assert (got[1].blank, got[1].gaps, got[1].audit) == (1, 0, "DD") and got[None].audit == "D"
    assert D.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    rows, every = {}, set()
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        every.add(r.conv_id)
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text
        rows.setdefault(r.conv_id, []).extend([(r.turn, "user" if kind == 4 else r.role, text)] * (kind == 3 or 1) * (2 if kind == 3 else 1) if kind else [])
    got = {r.conv_id: tuple(r)[1:] for r in op12_dialogue(spark, FOLDER).collect()}
    assert got == {c: plain(in_order(rows[c])) if rows[c] else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in every}
