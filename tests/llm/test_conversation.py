"""Conversation repair against trying edits one by one."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from staylens.llm import conversation, queries

GOAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, times long, cost string"


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def play(rows, kinds, audit):
    """Cost and lines of an audit, or None if it breaks a rule or its roles can't be told or made right."""
    best = None
    for writes in itertools.product(("user", "assistant"), repeat=sum(c in "IR" for c in audit)):
        role, at, cost, lines, initials = iter(writes), 0, 0, [], ""
        for c in audit:
            if c == "I":
                r = next(role)
                cost, lines, initials = cost + 2, [*lines, r + ":"], initials + r[0]
                continue
            if at == len(rows):
                return None
            (was, text), kind = rows[at], kinds[at]
            at += 1
            if c == "D":
                cost += 3
                continue
            if kind in ("blank", "duplicate"):
                return None
            r = was if c == "K" else next(role)
            cost += (0 if c == "K" else 2) + (kind == "truncated")
            lines, initials = [*lines, f"{r}:{text}"], initials + (r[:1] or "-")
        if at == len(rows) and GOAL.fullmatch(initials):
            best = (cost, lines)
    return best


def tried(rows):
    """Cheapest, then ASCII-least, of all audits."""
    kinds, found = faults(rows), []
    for inserts in range(4):
        for places in itertools.combinations(range(len(rows) + inserts), inserts):
            for edits in itertools.product("DKR", repeat=len(rows)):
                edit = iter(edits)
                audit = "".join("I" if i in places else next(edit) for i in range(len(rows) + inserts))
                done = play(rows, kinds, audit)
                if done:
                    found.append((done[0], audit, done[1]))
    return min(found)


def planned(rows):
    """The same by cheapest (cost, audit) from the back, for long conversations."""
    kinds, following = faults(rows), {"": "us", "s": "u", "u": "a", "a": "u"}

    tails = {q: (_NONE if q in ("s", "u") else (0, "")) for q in following}
    tails = settle(tails)
    for (role, _), kind in zip(reversed(rows), reversed(kinds)):
        now = {}
        for q, allowed in following.items():
            ways = [(tails[q][0] + 3, "D" + tails[q][1])]
            if kind in ("", "truncated"):
                more = kind == "truncated"
                to = next(c for c in allowed if c in "ua")
                ways.append((tails[to][0] + 2 + more, "R" + tails[to][1]))
                if role[:1] and role[:1] in allowed:
                    ways.append((tails[role[0]][0] + more, "K" + tails[role[0]][1]))
            now[q] = min(ways)
        tails = settle(now)
    return tails[""]


_NONE = (10**9, "~")


def settle(tails):
    for _ in range(5):
        for q, to in {"": "u", "s": "u", "a": "u", "u": "a"}.items():
            tails[q] = min(tails[q], (tails[to][0] + 2, "I" + tails[to][1]))
    return tails


def lines_of(rows, audit):
    """Lines of a right audit: what is written is told by the initial before it."""
    last, at, lines = "", 0, []
    for c in audit:
        if c == "D":
            at += 1
            continue
        role = "assistant" if last == "u" else "user"
        text = ""
        if c != "I":
            role = rows[at][0] if c == "K" else role
            text, at = rows[at][1], at + 1
        lines.append(f"{role}:{text}")
        last = role[:1]
    assert at == len(rows)
    return lines


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if kind:
            row = (turn is not None, turn or 0, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            mine += [row] * (2 if kind == 3 else 1)
    return {c: sorted(x) for c, x in out.items()}


def expected(rows):
    out = []
    for conv, mine in damage(rows).items():
        pairs = [(r, t) for _, _, r, t in mine]
        kinds, turns = faults(pairs), {t for known, t, _, _ in mine if known}
        cost, audit = planned(pairs)
        sha = hashlib.sha256("\n".join(lines_of(pairs, audit)).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + "|" + b[0][:1] not in ("s|u", "u|a", "a|u") for a, b in zip(pairs, pairs[1:]))
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def talk(r, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "ux"]
    texts = ["yes.", "no!", "why?", "cut", "", " \t", "é \n", "a. ", "x.\x0b"]
    return [(r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"t{r.random()}{r.choice(['.', ''])}") for _ in range(n)]


def test_the_plan_of_these_tests_is_the_least_of_all_audits():
    r = random.Random(1)
    for _ in range(60):
        rows = talk(r, r.randrange(4))
        cost, audit, lines = tried(rows)
        assert planned(rows) == (cost, audit) and lines_of(rows, audit) == lines


@pytest.mark.parametrize("block", [1, 2, 4])
def test_tables_match_the_plan(block):
    r, tables = random.Random(block), conversation.Tables(block)
    for n in [*range(12), 57, 200]:
        for _ in range(20):
            rows = talk(r, n)
            roles, texts = [x[0] for x in rows], [x[1] for x in rows]
            f = conversation.Faults(roles, texts, set(conversation.first_places(roles, texts)))
            vectors, before, cost = tables.cost(f.symbols)
            audit, lines = conversation.repaired(tables, f, roles, texts, conversation.START, vectors, True)
            assert (cost + tables.vectors[before][0], audit) == planned(rows)
            assert lines == lines_of(rows, audit)
            every = tables.every(f.symbols)
            assert (every[0][0], every[1][0]) == (before, cost)


def conversations(spark):
    r, rows = random.Random(9), []
    for conv in [None, *range(40)]:
        turns = sorted(r.sample(range(60), r.randrange(1, 9)))
        rows += [(conv, t if r.random() < 0.95 else None, *x) for t, x in zip(turns, talk(r, len(turns)))]
    rows += [(500, t, *x) for t, x in enumerate(talk(r, 700))]  # most of all rows
    rows += [(501, 7, "user", "the same.")] * 300
    rows += [(502, None, None, None), (502, None, "user", None), (502, None, None, "Hi.")]
    rows += [(i, 0, "user", "alone.") for i in range(600, 900) if zlib.crc32(f"{i}:0".encode()) % 20 in (0, 3)]
    return rows, spark.createDataFrame([(*x, i, "clash") for i, x in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("segment_rows", [3, 64, 4096])
def test_repair_matches_plain_python(spark, segment_rows):
    rows, table = conversations(spark)
    got = sorted((tuple(x) for x in conversation.repair_conversations(table, segment_rows).collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    want = expected(rows)
    assert [x[:8] for x in got] == [x[:8] for x in want]
    assert got == want
    assert any(x[1:7] == (0,) * 6 and x[7] == "" and x[8] == hashlib.sha256(b"").hexdigest() for x in got)  # every row dropped


def test_sql_twin_matches_plain_python(spark):
    import duckdb

    rows, _ = conversations(spark)
    rows = [r for r in rows if r[0] not in (500, 501)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    got = con.sql(queries.SQL["op12_conversation_repair"]).fetchall()
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0)) == expected(rows)


def test_query_and_empty_table(spark, tmp_path):
    rows, _ = conversations(spark)
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=lambda x: (x[0] is not None, x[0] or 0)) == expected(rows)
    assert conversation.repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
