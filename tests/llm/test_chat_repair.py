"""Conversation repair: every edit sequence by brute force, whole tables by a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from callrisk.llm import chat_repair, queries
from callrisk.sources.tables import read_table

SF = "/root/testdata/sf0.01"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_repair(rows):
    """rows: (role, text, must go, open).  Least (cost, audit, lines) over the prefixes, row by row."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def widened(table):
        for _ in range(2):  # a third insertion in a row only repeats a state
            for last, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    if role[0] in follows[last]:
                        new = (cost + 2, audit + "I", lines + [f"{role}:"])
                        table[role[0]] = min(table.get(role[0], new), new, key=lambda x: x[:2])
        return table

    table = widened({"": (0, "", [])})
    for role, text, gone, opened in rows:
        new = {}
        for last, (cost, audit, lines) in table.items():
            options = [(last, cost + 3, "D", lines)]
            if not gone:
                if role[:1] and role[:1] in follows[last]:
                    options.append((role[:1], cost + opened, "K", lines + [f"{role}:{text}"]))
                options += [(r[0], cost + 2 + opened, "R", lines + [f"{r}:{text}"]) for r in ("user", "assistant")
                            if r[0] in follows[last]]
            for to, c, letter, li in options:
                x = (c, audit + letter, li)
                new[to] = min(new.get(to, x), x, key=lambda y: y[:2])
        table = widened(new)
    return min((table[q] for q in ("", "a") if q in table), key=lambda x: x[:2])


def plain(table):
    """{id: the contract's columns} for (id, turn, role, text) rows."""
    space, blanks = (lambda x: " " if x is None else str(x)), " \t\n\x0b\x0c\r"
    out = {}
    for i, group in itertools.groupby(sorted(table, key=lambda r: (r[0] is not None, r[0])), key=lambda r: r[0]):
        rows = []
        for _, turn, role, text in group:
            role, text = space(role), space(text)
            kind = zlib.crc32(f"{space(i)}:{space(turn)}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
        turns = [r[0] for r in rows if r[0] is not None]
        seen, marked, count = set(), [], [0, 0, 0]
        for _, role, text in rows:
            bare = text.rstrip(blanks)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                count[fault] += 1
            marked.append((role, text, fault < 2, int(fault == 2)))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = plain_repair(marked)
        out[i] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    assert len(found) == len(rows)
    return found


def test_search_equals_all_edit_sequences():
    """Every audit of bounded length is tried on every short conversation."""
    def cost_of(codes, audit):
        total, state, i = 0, 0, 0
        for letter in audit:
            if letter == "I":
                total, state = total + 2, chat_repair.INSERTED[state]
                continue
            if i == len(codes):
                return None
            step = [(to, c) for x, to, c in chat_repair.ROW_EDITS[state, codes[i]] if x == letter]
            if not step:
                return None
            state, total, i = step[0][0], total + step[0][1], i + 1
        return total if i == len(codes) and state in chat_repair.ACCEPTING else None

    audits = ["".join(a) for n in range(6) for a in itertools.product("DIKR", repeat=n)]
    for n in (0, 1, 2, 3):
        for codes in itertools.product(range(12), repeat=n):
            if n == 3 and random.Random(str(codes)).random() > 0.02:
                continue
            want = min((c, a) for a in audits if (c := cost_of(codes, a)) is not None)
            assert chat_repair.solve(bytes(codes)) == want, codes


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_the_plain_programme(seed):
    rng = random.Random(seed)
    names = {0: "system", 1: "user", 2: "assistant", 3: "x"}
    for _ in range(400):
        codes = bytes(rng.choice([rng.randrange(12), rng.randrange(1, 3)]) for _ in range(rng.randrange(40)))
        rows = [(names[c % 4], "t", c // 4 == 2, int(c // 4 == 1)) for c in codes]
        cost, audit, lines = plain_repair(rows)
        assert chat_repair.solve(codes) == (cost, audit)
        assert GOOD.fullmatch("".join(x[0] for x in lines))


def test_long_conversation():
    rng = random.Random(7)
    codes = bytes(rng.choice((1, 2, 1, 2, 1, 2, 5, 6, 0, 3, 9)) for _ in range(20_000))
    cost, audit = chat_repair.solve(codes)
    assert cost > 0 and len(audit.replace("I", "")) == len(codes)


def test_table_equals_plain(spark):
    table = read_table(spark, SF, "conversations")
    want = plain([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert got(queries.QUERIES["op12_chat_repair"](spark, SF)) == want
    assert len({w[6] for w in want.values()}) > 20


def test_defined_cases(spark):
    roles = ["user", "assistant", "system", None, "", "tool", "ass", "Übung"]
    texts = ["Yes.", "No", None, "", " \t", "é?\u2028", "Why?  ", "long " * 30_000 + ".", "a\nb!\n", "."]
    rng = random.Random(3)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts))
            for _ in range(500)]
    rows += [(99, t, "user", "again.") for t in range(300)] + [(98, None, "user", None)]
    rows += [(97, -2 ** 63, "user", "a."), (97, 2 ** 63 - 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("id", "kind", "initial", "audit", "place", "dropped", "of"):
        df = df.withColumn(name, F.lit("clash"))
    want = {i: (min(w[0], 2 ** 63 - 1), *w[1:]) for i, w in plain(rows).items()}
    assert got(queries.repair_digest(chat_repair.damaged(df))) == want
    assert want[99][2] > 250 and want[98][6] == "D"
    assert queries.repair_digest(chat_repair.damaged(df.limit(0))).count() == 0


def test_repaired_rows_follow_the_pattern(spark):
    rows = chat_repair.damaged(read_table(spark, SF, "conversations"))
    found, fixed = chat_repair.repair(rows)
    per = fixed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "edit", "role"))).alias("rows")).collect()
    audits = {r.id: r.audit for r in found.collect()}
    for r in per:
        assert GOOD.fullmatch("".join(x.role[0] for x in r.rows))
        assert "".join(x.edit for x in r.rows) == audits[r.id].replace("D", "")
        assert [x.place for x in r.rows] == list(range(len(r.rows)))
