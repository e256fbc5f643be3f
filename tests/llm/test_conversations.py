"""Conversation repair against a plain program over whole strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from lodeworks.llm import conversations as C


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        act = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if act:
            text = "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text
            out += [(conv, turn, "user" if act == 4 else role, text)] * (2 if act == 3 else 1)
    return out


def repaired(rows: list[tuple]) -> tuple:
    """Cheapest edits of (role, text, must go, extra) by all ways over a string, the least audit first."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def insert(best: dict) -> dict:
        for _ in range(3):
            for q, (c, e, out) in list(best.items()):
                for r in ("user", "assistant"):
                    if r[0] in follows[q] and (r[0] not in best or best[r[0]][:2] > (c + 3, e + "I")):
                        best[r[0]] = (c + 3, e + "I", (*out, f"{r}:"))
        return best

    for role, text, gone, extra in rows:
        new: dict = {}
        for q, (c, e, out) in insert(best).items():
            ways = [(q, (c + 4, e + "D", out))]
            if not gone:
                ways += [(r[0], (c + 3 + extra, e + "R", (*out, f"{r}:{text}"))) for r in ("user", "assistant") if r[0] in follows[q]]
                if role[:1] and role[0] in follows[q]:
                    ways.append((role[0], (c + extra, e + "K", (*out, f"{role}:{text}"))))
            for to, way in ways:
                if to not in new or way[:2] < new[to][:2]:
                    new[to] = way
        best = new
    return min(v for q, v in insert(best).items() if q in ("", "a"))


def brute(rows: list[tuple]) -> list[tuple]:
    out = []
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        # Of one turn, by role and then as the operator's digests go; the made rows have no ties but equal rows.
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, edits = set(), [], []
        for _, _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            edits.append((role, text, fault in ("blank", "duplicate"), 3 if fault == "truncated" else 0))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, lines = repaired(edits)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.randint(1, 14)):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "", "tool", "uncle", "Ünder"] + [None])
            rows.append((conv, turn * rnd.choice([1, 1, 3]), role, rnd.choice(["Fine.", "Good!", "cut", " \t", "", "Ends? \n", "日本。", None, f"Own {turn}.", f"own {turn}"])))
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())
    rows += [(7, None, "user", "No turn."), (8, 3, "user", "x." * 50_000), (500, None, None, None), (501, -5, "assistant", "Below zero.")]
    rows += [(900, t, rnd.choice(["user", "assistant", "assistant", "system"]), f"Long {t % 40}{rnd.choice('. ')}") for t in range(700)]
    return rows


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_equals_brute_force(spark, partitions):
    rows = made(partitions)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS conv", "'y' AS part", "1 AS cost", "2 AS id")
    found = C.repair_digests(df, partitions=partitions)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows)


def test_conversations_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert sorted((tuple(r) for r in C.repair_digests(df, partitions=7).collect()), key=repr) == brute(rows)


def test_repeated_rows(spark):
    """Equal rows of one turn are neighbours whatever lies between in the table; all but the first are duplicates."""
    df = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "assistant", "Yes."), ("c", 1, "user", "Hi.")] * 3, "conv string, turn int, role string, text string")
    summary, rows = C.repair_conversations(df)
    assert [tuple(r) for r in summary.collect()] == [("c", 0, 0, 7, 0, 7, 28, "KDDDDDKDD")]
    assert [(r["role"], r["text"]) for r in rows.orderBy("part", "pos").collect()] == [("user", "Hi."), ("assistant", "Yes.")]


def test_states_are_few():
    """However long the scan, few cost vectors arise; each state's costs are those of the matrix."""
    rnd, repairs = random.Random(3), C.Repairs()
    for _ in range(50):
        symbols = [rnd.randrange(16) for _ in range(200)]
        m, (_, costs) = repairs.matrix(symbols), repairs.scan(symbols, C._FINAL)
        assert costs == [min(m[4 * p + q] + C._FINAL[q] for q in range(4)) for p in range(4)]
    assert len(repairs.vectors) < 200


def test_string_keys_and_nulls(spark):
    df = spark.createDataFrame([(None, 1, None, "Hi."), ("a", None, "user", None)], "conv string, turn int, role string, text string").withColumn("x", F.lit(1))
    summary, _ = C.repair_conversations(df.select("conv", "turn", "role", "text"))
    assert sorted((tuple(r) for r in summary.collect()), key=repr) == [("a", 0, 1, 0, 0, 0, 4, "D"), (None, 0, 0, 0, 0, 0, 4, "D")]


def test_ties_as_in_sql(spark, tmp_path):
    """Rows of one turn, nulls and texts that repeat: the query's SQL agrees on the order."""
    import duckdb

    from lodeworks.llm import queries

    rnd = random.Random(9)
    rows = [(rnd.choice([1, 2, None]), rnd.choice([None, 1, 2, 3]), rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice(["Fine.", "Good!", "cut", " ", None])) for _ in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    with duckdb.connect() as duck:
        duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
        expected = sorted(duck.sql(queries.OP12_SQL).fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()), key=repr) == expected
