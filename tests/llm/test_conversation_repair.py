"""Conversation repair against SQL on random turns, and against all edit sequences of short ones."""

import re
from itertools import product

import duckdb
import numpy as np
import pandas as pd
import pytest

from shardflow.llm import conversation_repair as R
from shardflow.llm.repair_sql import SQL

TURNS = "conv_id long, turn long, role string, text string, first boolean, kind int, part string, copies string"
PATTERN = re.compile("(s?(ua)+)?")


def by_sql(rows):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": "string", "text": "string"}))
    return sorted(con.execute(SQL).fetchall(), key=repr)


def by_spark(spark, rows, partitions=4):
    df = spark.createDataFrame([(*r, None, 3, "x", "y") for r in rows], TURNS).repartition(partitions)
    out = R.repair(R.damaged(df), df)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def turns(seed, conversations, longest):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(conversations):
        for k in range(int(rng.integers(1, longest))):
            role = ["system", "user", "assistant", "user", "assistant", "tool", "", None][int(rng.integers(0, 8))]
            text = [None, "", "Yes.", "No", "Why? ", "Really!\n", "\x1c", "Ünd.", "so on..", f"t{k}."][int(rng.integers(0, 10))]
            out.append((c, None if rng.random() < 0.1 else int(k + rng.integers(0, 3)), role, text))
    return out


def test_against_sql(spark):
    rows = turns(1, 150, 12) + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (None, None, None, None)]
    assert by_spark(spark, rows) == by_sql(rows)


def test_a_conversation_cut_into_blocks(spark, monkeypatch):
    """A third and more of all rows in one conversation, in many ranges and blocks."""
    rows = turns(2, 40, 6) + [(7, t, *x) for t, (_, _, *x) in enumerate(turns(3, 30, 12))]
    want = by_sql(rows)
    monkeypatch.setattr(R, "BLOCK_ROWS", 5)
    assert by_spark(spark, rows, 9) == want
    monkeypatch.setattr(R, "BLOCK_BYTES", 1)
    assert by_spark(spark, rows, 3) == want


def test_many_equal_rows(spark):
    rows = [(1, 0, "user", "same.")] * 700 + [(1, None, "assistant", "x")] * 300 + [(1, k, "user", "same.") for k in range(200)]
    assert by_spark(spark, rows) == by_sql(rows)


def test_very_long_texts(spark):
    rows = [(1, 1, "user", "word " * 300_000 + "."), (1, 2, "assistant", "x" * 2_000_000), (2, 1, "user", "!")]
    assert by_spark(spark, rows) == by_sql(rows)


def test_no_rows_after_damage_and_no_rows(spark):
    dropped = [(c, 1, "user", "a.") for c in range(60)]
    got = by_spark(spark, dropped)
    assert got == by_sql(dropped)
    assert any(r[7] == "" and r[6] == 0 for r in got)
    assert by_spark(spark, []) == []


def every_way(rows, begin, ends, inserts):
    """The cheapest of all edit sequences with at most so many inserts before each row and at the end."""
    best = None
    for counts in product(range(inserts + 1), repeat=len(rows) + 1):
        for picks in product("KRD", repeat=len(rows)):
            state, cost, audit = begin, 0, ""
            for row, pick, before in zip([*rows, None], [*picks, None], counts):
                for _ in range(before):
                    state, cost, audit = R.MADE[state][1], cost + 3, audit + "I"
                if pick == "D":
                    cost, audit = cost + 4, audit + "D"
                elif pick:
                    legal = row.fault not in ("blank", "duplicate")
                    cost, audit = cost + 3 * (row.fault == "truncated") + 3 * (pick == "R"), audit + pick
                    state = (R.MADE[state][1] if pick == "R" else R.STEP[state].get(row.role[:1])) if legal else None
                if state is None:
                    break
            if state in ends and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_is_the_least_of_all(seed):
    rng = np.random.default_rng(seed)
    rows = [
        R.Row(1, ["user", "assistant", "system", "tool"][int(rng.integers(0, 4))], ["", "a.", "b", "c!"][int(rng.integers(0, 4))], 1, bool(rng.random() < 0.8))
        for _ in range(3)
    ]
    for begin in range(4):
        for ends in ([0], [1], [2], [3], R.ENDS):
            assert R.cheapest(rows, begin, ends) == every_way(rows, begin, ends, 2)


def test_repaired_roles_follow_the_pattern():
    rng = np.random.default_rng(0)
    for _ in range(200):
        rows = [R.Row(1, str(rng.choice(["user", "assistant", "system", "x"])), str(rng.choice(["", "a.", "b"])), 1, True) for _ in range(int(rng.integers(0, 9)))]
        _, audit = R.cheapest(rows, R.START, R.ENDS)
        out, _ = R.repaired(rows, audit, R.START)
        assert PATTERN.fullmatch("".join(role[0] for role, _ in out))
