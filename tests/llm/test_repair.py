"""Conversation repair against a brute-force search over edits, in one range and in many."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from terrane.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, n string, range int, id long, kind string"
SPACE = r"[\x20\x09-\x0D]"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """The least (cost, edits) by trying all edits: each place tries what the contract allows, at most two inserts in a row."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(k, state, inserts):
        options = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        if inserts < 3:
            options.append((3, "I", (k, due[state], inserts + 1)))
        if k < len(rows):
            fault, initial = rows[k]
            options.append((4, "D", (k + 1, state, 0)))
            more = 3 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                if initial == due[state] or initial == "s" and state == "":
                    options.append((more, "K", (k + 1, initial, 0)))
                options.append((3 + more, "R", (k + 1, due[state], 0)))
        found = []
        for cost, letter, rest in options:
            more = best(*rest) if letter else (0, "")
            if more:
                found.append((cost + more[0], letter + more[1]))
        return min(found, default=None)

    return best(0, "", 0)


def brute(original):
    out = {}
    rows = damage(original)
    for conv in {r[0] for r in original}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        if not mine:
            out[conv] = (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            continue
        seen, faults = set(), []
        for _, role, text in mine:
            core = re.sub(f"{SPACE}+$", "", text)
            core = "" if re.fullmatch(f"{SPACE}*", text) else core
            faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(tuple((f, r[1][:1]) for f, r in zip(faults, mine)))
        state, k, kept = "", 0, []
        for e in audit:
            due = "assistant" if state == "u" else "user"
            if e == "I":
                kept.append((due, ""))
            elif e != "D":
                kept.append((mine[k][1] if e == "K" else due, mine[k][2]))
            k += e != "I"
            state = kept[-1][0][:1] if e != "D" else state
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return sorted(map(repr, out.values()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["Yes.", "No", "Why?", "", " \t\n", "ok!", "ends here. \n", "Ü 日本.", None, "said twice."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "sudo", "User"]
    out = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(0, 9))]
    out += [(c, t, ("user", "assistant")[t % 2], f"turn {t}.") for c in range(60, 90) for t in range(rng.randint(0, 8))]
    out += [(500, t if t % 7 else None, rng.choice(roles), rng.choice(texts)) for t in range(40)] + [(None, t, "user", "no id.") for t in range(3)]
    out += [(501, 4, "user", "again.")] * 5 + [(502, t, "system", "rules.") for t in range(4)] + [(503, -5, "user", "far."), (503, 10**12, "assistant", "away.")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def test_equals_brute_force(spark, rows):
    got = sorted(repr(tuple(r)) for r in repair.repair_damaged(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_long_conversation_over_many_ranges(spark):
    """One conversation in many ranges gives what it gives in one."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", f"turn {t}."])) for t in range(400)] + [(2, t, "user", f"{t}.") for t in range(30)]
    frames = frame(spark, rows)
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = sorted(repr(tuple(r)) for r in repair.repair_damaged(frames).collect())
        turns = repair.repaired_turns(repair.damaged(frames)).where("conv_id = 1").orderBy("range", "k").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert many == brute(rows)
    assert len({r.range for r in turns}) > 5
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns))


def test_parts_are_joined_in_order(monkeypatch):
    monkeypatch.setattr(repair, "_PART", 1)
    assert b"\n".join(repair._parts(iter([b"a", b"", b"c"]))) == b"a\n\nc"
    assert list(repair._parts(iter([]))) == []


def test_repeats_and_extreme_turns(spark):
    rows = [(1, 0, "user", "Hi.")] * 3 + [(2, -(2**63), "user", "a."), (2, 2**63 - 1, "assistant", "b.")]
    got = {r.conv_id: r for r in repair.repair(frame(spark, rows)).collect()}
    assert (got[1].audit, got[1].cost, got[1].duplicate, got[1].illegal) == ("KDDI", 11, 2, 2)
    assert got[2].gaps == 2**63 - 1


def test_empty_table(spark):
    assert repair.repair_damaged(frame(spark, [])).collect() == []
