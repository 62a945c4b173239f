"""Repair of conversations against an exhaustive search of audits; long ones against short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from evispark.llm import repair, sequence_queries

SF = "/root/testdata/sf0.001"
ORDER = re.compile(r"(s?(ua)+)?")


def plain(codes):
    """Least cost, then least audit, by trying all ways: rows from the last to the first, all inserts."""
    from functools import cache

    @cache
    def best(i, state, inserts):
        options = []
        if i == len(codes):
            if state in (0, 3):
                options.append((0, ""))
        else:
            c = codes[i]
            extra = 3 if c.isupper() else 0
            cost, audit = best(i + 1, state, 0)
            options.append((cost + 4, "D" + audit))
            if c != "d":
                to = repair.KEPT.get((state, c.lower()))
                if to is not None:
                    cost, audit = best(i + 1, to, 0)
                    options.append((cost + extra, "K" + audit))
                cost, audit = best(i + 1, repair.WANTED[state], 0)
                options.append((cost + 3 + extra, "R" + audit))
        if inserts < 3:
            cost, audit = best(i, repair.WANTED[state], inserts + 1)
            options.append((cost + 3, "I" + audit))
        return min(options, default=(1 << 40, ""))
    return best(0, 0, 0)


def by_hand(codes, longest):
    """All strings of edits over a few rows, checked by the pattern of roles: knows no lattice."""
    found = []
    for n in range(longest + 1):
        for edits in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in edits) != len(codes):
                continue
            for choice in itertools.product("ua", repeat=sum(e in "IR" for e in edits)):
                roles, cost, at, pick = "", 0, 0, iter(choice)
                for e in edits:
                    if e == "I":
                        roles, cost = roles + next(pick), cost + 3
                        continue
                    c, at = codes[at], at + 1
                    if e == "D":
                        cost += 4
                        continue
                    if c == "d":
                        break
                    roles += c.lower() if e == "K" else next(pick)
                    cost += (3 if e == "R" else 0) + (3 if c.isupper() else 0)
                else:
                    if ORDER.fullmatch(roles):
                        found.append((cost, "".join(edits)))
    return min(found)


def test_all_short_sequences():
    for n in range(4):
        for codes in itertools.product("suaxUAd", repeat=n):
            codes = "".join(codes)
            cost, audit = plain(codes)
            assert (cost, audit) == by_hand(codes, n + 2) if n < 3 else True
            got, state, total = repair.walk(codes)
            assert (total, got + repair.FINISH[state]) == (cost, audit), codes


def test_long_sequences():
    rng = random.Random(3)
    for _ in range(600):
        codes = "".join(rng.choice("suaxSUAXd" if rng.random() < .4 else "ua") for _ in range(rng.randrange(4, 60)))
        got, state, total = repair.walk(codes)
        assert (total, got + repair.FINISH[state]) == plain(codes), codes


def test_distances_add_up():
    rng = random.Random(4)
    for _ in range(80):
        a, b = ("".join(rng.choice("suaxUAd") for _ in range(rng.randrange(0, 9))) for _ in range(2))
        table, ends = repair.distances(b), repair.ENDING
        ends = tuple(min(repair.FAR, min(table[4 * s + t] + ends[t] for t in range(4))) for s in range(4))
        first, state, total = repair.walk(a, 0, ends)
        second, last, _ = repair.walk(b, state)
        assert (total, first + second + repair.FINISH[last]) == plain(a + b)


def plain_repair(rows):
    """Counts, cost, audit and digest of the rows of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    codes, counts, seen = "", [0, 0, 0], set()
    for _, role, text in rows:
        code, end = role[:1] if role[:1] in ("s", "u", "a") else "x", re.findall(r"[^\x20\x09-\x0D]", text)
        if not end:
            counts[0] += 1
            code = "d"
        elif (role, text) in seen:
            counts[1] += 1
            code = "d"
        elif end[-1] not in ".!?":
            counts[2] += 1
            code = code.upper()
        seen.add((role, text))
        codes += code
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain(codes)
    out, at, roles = [], 0, ""
    for e in audit:
        if e != "I":
            _, role, text = rows[at]
            at += 1
        if e == "K":
            out.append(f"{role}:{text}")
            roles += role[0]
        elif e != "D":
            new = "assistant" if roles.endswith("u") else "user"
            out.append(f"{new}:{'' if e == 'I' else text}")
            roles += new[0]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversations(seed=5, n=60, longest=40):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "no", "", "  \n", "And?", "wait ", "é. \t", "Hi.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            rows.append((c if c else None, rng.choice([t, t, t, 2 * t, None]), rng.choice(roles), rng.choice(texts) if rng.random() < .5 else f"t{t}.", "x"))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_repair(spark, monkeypatch, block):
    """Blocks of three rows: nearly every conversation takes the way of the long ones."""
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rows = conversations()
    frame = spark.createDataFrame(rows, "c long, t int, r string, x string, audit string").repartition(3)
    parts = repair.repair(frame, "c", "t", "r", "x")
    got = {r["id"]: r for r in repair.summaries(parts).collect()}
    gaps = {r["id"]: r["gaps"] for r in repair.gaps(frame, "c", "t").collect()}
    by_id = {}
    for c, t, r, x, _ in rows:
        by_id.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    assert set(got) == set(by_id) == set(gaps)
    for c, own in by_id.items():
        r = got[c]
        assert (gaps[c], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == plain_repair(own)
    if block == 3:
        assert parts.where("not alone").count() > 60 and parts.agg({"n_rows": "max"}).first()[0] <= 3


def test_nothing_to_repair(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.summaries(repair.repair(frame)).collect() == [] and repair.gaps(frame).collect() == []


def test_texts_over_a_block(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK_BYTES", 50)
    rows = [(1, 0, "user", "u" * 200 + "."), (1, 1, "assistant", "a."), (1, 2, "user", "u" * 200 + "."), (2, 0, "user", "Hi.")]
    out = {r["id"]: r for r in repair.summaries(repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (out[1]["audit"], out[1]["duplicate"], out[1]["cost"]) == ("KKD", 1, 4) and (out[2]["audit"], out[2]["cost"]) == ("KI", 3)


def test_query_on_hard_rows(spark, tmp_path):
    """Dropped conversations and null ids; the table of the query itself is compared with SQL elsewhere."""
    rows = [(c, t, r, x) for c, t, r, x, _ in conversations(9, 80, 9)] + [(c, 0, "user", "gone.") for c in range(900, 990)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in sequence_queries.op11_conversations(spark, str(tmp_path)).collect()}
    by_id = {}
    for c, t, r, x in rows:
        own = by_id.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            own += [(t, "user" if h == 4 else r, "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x)] * (2 if h == 3 else 1)
    empty = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    assert got == {c: plain_repair(own) if own else empty for c, own in by_id.items()}
    assert empty in got.values()
