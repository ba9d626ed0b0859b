"""Conversation repair against a search over all edits, and the new queries against their SQL."""

import hashlib
import math
import os
import random

import duckdb
import pytest

from loomfact.llm import chat_repair, queries

FOLDER = "/root/testdata/sf0.001"


def plain_rows(df):
    return sorted(tuple("-" if v is None or isinstance(v, float) and math.isnan(v) else v for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["op11_top_k", "op12_chat_repair"])
@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
def test_equals_sql(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    want, got = con.execute(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, folder).toPandas()
    assert len(got) and plain_rows(got) == plain_rows(want)


def least(initials, must, broken):
    """Least (cost, audit) by trying all edits, state by state."""
    state, step = {"": (0, "")}, {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def put_in(state):
        for _ in range(3):
            for q, (c, x) in list(state.items()):
                for r in "ua":
                    if (q, r) in step:
                        state[r] = min(state.get(r, (math.inf, "")), (c + 5, x + "I"))
        return state

    for x, m, b in zip(initials, must, broken, strict=True):
        new = {}
        for q, (c, audit) in put_in(dict(state)).items():
            options = [(q, c + 2, "D")]
            if not m:
                options += [(x, c + 5 * b, "K")] if (q, x) in step else []
                options += [(r, c + 1 + 5 * b, "R") for r in "ua" if (q, r) in step]
            for r, cost, letter in options:
                new[r] = min(new.get(r, (math.inf, "")), (cost, audit + letter))
        state = new
    return min(v for q, v in put_in(dict(state)).items() if q in ("", "a"))


def test_stays_equal_all_edits():
    rng = random.Random(7)
    for _ in range(6000):
        n = rng.randrange(9)
        initials, must, broken = [rng.choice("suax") for _ in range(n)], [rng.random() < 0.2 for _ in range(n)], [rng.random() < 0.3 for _ in range(n)]
        broken = [b and not m for b, m in zip(broken, must, strict=True)]
        got = chat_repair.Stays([chat_repair.INITIALS.get(x) for x in initials], must, broken)
        assert (got.cost, got.audit()) == least(initials, must, broken)


def test_long_conversation_is_linear():
    n = 200_000
    got = chat_repair.Stays([1 + i % 2 for i in range(n)], [i % 7 == 0 for i in range(n)], [False] * n)
    assert len(got.audit()) >= n and got.cost > 0


def test_repaired_turns_and_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be."), (1, 1, "assistant", "Hi."), (1, 2, "user", "So?"), (1, 2, "user", "So?"), (1, 5, "assistant", "cut off"),
        (2, None, None, None), (2, None, "user", "x"), (None, 1, "user", "Ok!"), (None, 2, "assistant", "Fine.\n "),
        (3, 1, "user", ""), (4, 7, "tool", "Yes."), (4, 8, "assistant", "x. " * 50000),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, audit string").repartition(3)
    got = {r.conv_id: r for r in chat_repair.repairs(df).collect()}
    assert (got[1].gaps, got[1].duplicate, got[1].truncated, got[1].illegal) == (2, 1, 1, 2)
    assert got[1].audit == "KRRDD" and got[1].cost == 6
    assert (got[2].gaps, got[2].blank, got[2].truncated) == (0, 1, 1) and got[2].audit == "DD"
    assert got[None].audit == "KK" and got[None].cost == 0
    assert got[3].audit == "D" and got[3].repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[4].audit == "RK"
    turns = {}
    for r in chat_repair.repaired(df).orderBy("place").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for conv, r in got.items():
        assert hashlib.sha256("\n".join(turns.get(conv, [])).encode()).hexdigest() == r.repaired_sha256
    assert chat_repair.repairs(df.limit(0)).count() == 0
