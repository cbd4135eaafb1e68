"""Conversation repair against enumeration of all edits."""

import hashlib
import random
import re
import zlib

import pytest

from tabrisk.llm.conversations import BLANK, CLEAN, CUT_OFF, DUPLICATE, Lattice, damage, repair, repair_digest, replay

PATTERN = re.compile(r"(s?(ua)+)?")


def cheapest(initials, faults, inserts=3):
    """All edit sequences with some insertions between turns, by exhaustion."""
    found, most = [], 3 * len(initials)

    def go(i, roles, cost, audit, run):
        if cost > most or not re.fullmatch(r"s?(ua)*u?", roles):  # deleting all costs `most`
            return
        if i == len(initials) and PATTERN.fullmatch(roles):
            found.append((cost, audit))
        if run < inserts:
            for r in "ua":
                go(i, roles + r, cost + 2, audit + "I", run + 1)
        if i == len(initials):
            return
        go(i + 1, roles, cost + 3, audit + "D", 0)
        if faults[i] not in (BLANK, DUPLICATE):
            extra = faults[i] == CUT_OFF
            go(i + 1, roles + (initials[i] or "?"), cost + extra, audit + "K", 0)
            for r in "ua":
                go(i + 1, roles + r, cost + 2 + extra, audit + "R", 0)

    go(0, "", 0, "", 0)
    return min(found)


@pytest.mark.parametrize("seed", range(60))
def test_lattice_against_enumeration(seed):
    draw = random.Random(seed)
    n = draw.randint(0, 4)
    initials = [draw.choice("ssuuaax") if draw.random() < 0.95 else "" for _ in range(n)]
    faults = [draw.choice([CLEAN] * 3 + [BLANK, DUPLICATE, CUT_OFF, CUT_OFF]) for _ in range(n)]
    assert Lattice(initials, faults).solve() == cheapest(initials, faults)


def plain(initials, faults):
    """Least (cost, audit) by a table from the end, state by state."""
    lattice = Lattice(initials, faults)
    n = len(initials)
    least = {4 * n: (0, ""), 4 * n + 3: (0, "")}
    for i in range(n, -1, -1):
        row = {}
        for state in range(4):
            node = 4 * i + state
            options = [least[node]] if node in least else []
            for label, to, cost in lattice.ahead(node):
                if to // 4 == i + 1 and to in least:
                    options.append((cost + least[to][0], label + least[to][1]))
            if options:
                row[node] = min(options)
        for _ in range(4):  # insertions at this turn
            for state in range(4):
                node = 4 * i + state
                for label, to, cost in lattice.ahead(node):
                    if to // 4 == i and to in row:
                        option = cost + row[to][0], label + row[to][1]
                        row[node] = min(row.get(node, option), option)
        least.update(row)
    return least[0]


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_against_a_table(seed):
    draw = random.Random(1000 + seed)
    n = draw.randint(20, 300)
    initials = [draw.choice("uuaasx") for _ in range(n)] if seed % 2 else list("s" + "ua" * n)[:n]
    faults = [draw.choice([CLEAN] * draw.choice([2, 9]) + [BLANK, DUPLICATE, CUT_OFF]) for _ in range(n)]
    assert Lattice(initials, faults).solve() == plain(initials, faults)


def test_a_very_long_conversation():
    n = 20_000
    initials, faults = list("ua" * (n // 2)), [CLEAN] * n
    faults[777] = BLANK
    cost, audit = Lattice(initials, faults).solve()
    assert cost == 5 and len(audit) == n + 1 and audit.count("K") == n - 1


# ---- the whole operator ----

def brute(rows, ids):
    out = {}
    for conv in ids:
        mine = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
            m = zlib.crc32(key.encode()) % 20
            if m == 0:
                continue
            text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
            role = "user" if m == 4 else role
            mine += [(turn, role, text)] * (2 if m == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(),
                                 hashlib.md5(f"{r[1]}\0{r[2]}".encode()).digest()))
        faults, seen = [], set()
        for _, role, text in mine:
            ink = re.sub("[\x20\x09-\x0D]", "", text)
            faults.append(BLANK if not ink else DUPLICATE if (role, text) in seen else CUT_OFF if ink[-1] not in ".!?" else CLEAN)
            seen.add((role, text))
        initials = [r[1][:1] for r in mine]
        turns = {r[0] for r in mine if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = plain(initials, faults) if mine else (0, "")
        lines = [f"{role or mine[i][1]}:{'' if i is None else mine[i][2]}" for i, role in replay(initials, audit)]
        out[conv] = (gaps, *[faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit int, _conv string, place string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def made(seed, conversations):
    draw = random.Random(seed)
    words = ["yes.", "no", "why?", "", " \t", "a longer answer.", "x" * 50_000, "é!", "\n.\n"]
    rows = []
    for c in range(conversations):
        for t in range(draw.randint(1, 9)):
            rows.append((c if c else None, None if draw.random() < 0.1 else t + draw.choice([0, 0, 0, 2]),
                         draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]),
                         None if draw.random() < 0.05 else draw.choice(words) if draw.random() < 0.5 else f"turn {t} of {c}."))
    return rows + rows[:3]


def test_repair_digest_against_brute_force(spark):
    rows = made(7, 60)
    convs = frame(spark, rows)
    got = {r[0]: tuple(r[1:]) for r in repair_digest(damage(convs), convs).collect()}
    assert got == brute(rows, {r[0] for r in rows})


def test_repaired_turns_have_the_digest(spark):
    rows = made(8, 20)
    convs = frame(spark, rows)
    lines = {}
    for r in sorted(repair(damage(convs)).collect(), key=lambda r: (r.conv_id is not None, r.conv_id, r.place)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
        assert r.edit in "KRI" and (r.edit == "I") <= (r.text == "")
    for conv, (*_, digest) in brute(rows, {r[0] for r in rows}).items():
        assert hashlib.sha256("\n".join(lines.get(conv, [])).encode()).hexdigest() == digest


def test_no_rows(spark):
    empty = frame(spark, [])
    assert repair_digest(damage(empty), empty).count() == 0 and repair(empty).count() == 0


def test_query_on_the_table(spark, sf_dir):
    from tabrisk.llm.queries import QUERIES

    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in convs.select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows, {r[0] for r in rows})
