"""Repair of conversations against the enumeration of all edits, and against a plain reading of the rules."""

import hashlib
import random
import re
import zlib
from itertools import groupby

from conftest import SMALL
from pyspark.sql import functions as F

from sigloft.llm import conversations as cv

LETTERS = {"s": 1, "u": 2, "a": 3}


def all_edits(rows):
    """Every edit sequence of least cost, as (cost, audit, [(row or None, role)]), by trying all of them."""
    best = [3 * len(rows), []]

    def go(i, made, cost, audit, out):
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            if cost < best[0]:
                best[:] = [cost, []]
            best[1].append((cost, audit, out))
        for role in ("user", "assistant"):
            go(i, made + role[0], cost + 2, audit + "I", [*out, (None, role)]) if re.fullmatch("s?(ua)*u?", made + role[0]) else None
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, made, cost + 3, audit + "D", out)
            if fault != "gone":
                more = fault == "truncated"
                for letter, role, paid in (("K", initial, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if re.fullmatch("s?(ua)*u?", made + role[:1] if role else made + "-"):
                        go(i + 1, made + role[0], cost + paid + more, audit + letter, [*out, (i, role)])

    go(0, "", 0, "", [])
    return min(best[1], key=lambda b: b[1])


def runs_of(rows):
    symbols = [cv.GONE if f == "gone" else (i if i in cv.KEPT else cv.OTHER).upper() if f == "truncated" else i if i in cv.KEPT else cv.OTHER for i, f in rows]
    return [(s, len(list(g))) for s, g in groupby(symbols)]


def test_least_cost_and_audit():
    pick = random.Random(7)
    for _ in range(400):
        rows = [(pick.choice("suuaaat"), pick.choice(["fine", "fine", "truncated", "gone"])) for _ in range(pick.randint(0, 5))]
        assert cv.repaired(runs_of(rows)) == all_edits(rows)[:2], rows


def row_by_row(symbols):
    """The same program without runs: costs behind every row, then the first letter that keeps to them."""
    costs = [cv.END]
    for s in reversed(symbols):
        costs.append(cv.before(cv.transition(s), costs[-1]))
    costs.reverse()
    state, audit = 0, ""
    for i, s in enumerate(symbols):
        letter = "I"
        while letter == "I":
            options = sorted([*((n, t, c + costs[i + 1][t]) for n, t, c in cv.row_moves(s, state)), ("I", cv.INSERTED[state], 2 + costs[i][cv.INSERTED[state]])])
            letter, state = next((n, t) for n, t, c in options if c == costs[i][state])
            audit += letter
    return int(costs[0][0]), audit + "I" * cv.last_inserts(state)


def test_long_runs():
    pick = random.Random(8)
    for _ in range(60):
        runs = [(pick.choice("suaoSUAOx"), pick.choice([1, 2, 3, 37, 64, 700])) for _ in range(pick.randint(1, 6))]
        symbols = "".join(s * n for s, n in runs)
        assert cv.repaired(cv.collapsed(runs)) == row_by_row(symbols)
    cost, audit = cv.repaired([("u", 1 << 20)])
    assert cost == 2 * (1 << 19) and len(audit) == 1 << 20


BLANK = set(" \t\n\x0b\f\r")


def plain_result(rows):
    """The contract read row by row over Python lists."""
    kept, ids = [], {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv in ids:
        own = [r[1:] for r in kept if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            shown = [c for c in text if c not in BLANK]
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        symbols = [cv.GONE if f in ("blank", "duplicate") else (r[:1] if r[:1] in cv.KEPT else cv.OTHER) for f, (_, r, _) in zip(faults, own)]
        cost, audit = row_by_row([s.upper() if f == "truncated" else s for s, f in zip(symbols, faults)])
        lines, made, at = [], "", 0
        for letter in audit:
            should = "assistant" if made[-1:] == "u" else "user"
            if letter == "I":
                lines.append(f"{should}:")
                made += should[0]
            else:
                _, role, text = own[at]
                at += 1
                if letter != "D":
                    lines.append(f"{role if letter == 'K' else should}:{text}")
                    made += lines[-1][0]
        assert re.fullmatch("(s?(ua)+)?", made) and at == len(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal,
                     cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def spark_result(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def test_given_conversations(spark):
    rows = spark.read.parquet(f"{SMALL}/../sf0.01/conversations.parquet")
    expected = plain_result([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert spark_result(cv.structure_repairs(cv.damaged(rows), rows)) == expected


def test_odd_rows(spark):
    pick = random.Random(9)
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "Why? \n", "a ", "x" * 300_000 + ".", None, "　", "\x1f"]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    rows = [(pick.choice([*range(40), None]), pick.choice([*range(9), None, -5]), pick.choice(roles), pick.choice(texts[:-4] + texts[-3:])) for _ in range(500)]
    rows += [(77, 1, "user", texts[7]), (77, 2, "assistant", texts[7]), (78, 0, "user", "Hi."), (78, 0, "user", "Hi."), (79, None, "user", "Hi."), (79, None, "assistant", "Ho.")]
    lone = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows.append((lone, 0, "user", "Dropped."))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, cost string, digest int")
    found = spark_result(cv.structure_repairs(cv.damaged(df), df))
    assert found == plain_result(rows)
    assert found[lone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cv.structure_repairs(cv.damaged(df.limit(0)), df.limit(0)).count() == 0


def test_one_conversation_with_most_rows(spark):
    pick = random.Random(10)
    rows = [(1, t, pick.choice(["user", "assistant", "assistant", "system"]), pick.choice(["Fine.", f"Row {t}.", f"cut {t}"])) for t in range(20_000)]
    rows += [(2 + t % 500, t, pick.choice(["user", "assistant"]), "Short.") for t in range(2_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)
    bad = cv.damaged(df)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = cv._stretches(cv.judged(bad)).where("conv_id = 1").count()
        found = spark_result(cv.structure_repairs(bad, df))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert spread > 1 and found == plain_result(rows)


def test_copies_are_counted_before_they_are_ordered(spark):
    rows = spark.range(50_000).select(F.lit(1).alias("conv_id"), F.lit(3).alias("turn"), F.lit("user").alias("role"), F.lit("Again.").alias("text"))
    assert cv.judged(rows).count() == 1
    out = cv.structure_repairs(rows).first()
    assert (out.duplicate, out.illegal, out.cost, len(out.audit)) == (49_999, 49_999, 3 * 49_999 + 2, 50_001)
