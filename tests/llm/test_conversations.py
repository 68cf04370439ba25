"""Conversation repair against a search over all edits, and against its SQL."""

import hashlib
import heapq
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

from sentrylake.llm import conversations

LEGAL = re.compile("(s?(ua)+)?")


def damaged(rows):
    shown = lambda x: " " if x is None else str(x)
    out = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (shown(r[0]), r[1] is not None, r[1] or 0, shown(r[2]), shown(r[3]))):
        role, text = shown(role), shown(text)
        k = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            out += [row] * (2 if k == 3 else 1)
    return out


def search(rows, insert=5):
    """The least (cost, audit) of rows (role, text, fault), by trying edits in order of cost; what was put out is kept as a string of initials."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        # what may follow depends on the last initial only; whether one is there, on the string being empty
        if (at, roles[-1:], bool(roles)) in done:
            continue
        done.add((at, roles[-1:], bool(roles)))
        if at == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, roles
        ok = lambda r: LEGAL.fullmatch(r) or LEGAL.fullmatch(r + "a") or LEGAL.fullmatch(r + "ua")
        for x in "ua":
            if ok(roles + x):
                heapq.heappush(heap, (cost + insert, audit + "I", at, roles + x))
        if at < len(rows):
            role, _, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if role[:1] and ok(roles + role[:1]):
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + role[:1]))
                for x in "ua":
                    if ok(roles + x):
                        heapq.heappush(heap, (cost + more + 1, audit + "R", at + 1, roles + x))


def by_force(rows):
    out, after = [], damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == conv]
        seen, faults = set(), []
        for _, _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit, roles = search([(r[2], r[3], f) for r, f in zip(mine, faults)])
        lines, left, put = [], iter(mine), iter(roles)
        for e in audit:
            row = None if e == "I" else next(left)
            if e != "D":
                name = {"u": "user", "a": "assistant"}.get(next(put))
                lines.append((row[2] if e == "K" else name) + ":" + ("" if e == "I" else row[3]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    texts = ["One.", "Two!", "Three?", "cut", " \t", "", None, "é.\x85", "a.b", "Yes. \n", " "]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
    out = []
    for conv in range(160):
        turn = 0
        for _ in range(int(rng.integers(1, 9))):
            turn += int(rng.integers(0, 3))
            out.append((conv, None if rng.random() < 0.05 else turn, str(roles[rng.integers(0, 5 if rng.random() < 0.7 else 9)] or "") if rng.random() < 0.95 else None, texts[rng.integers(0, len(texts))]))
    # a long one, one of nulls, one of one turn, a repeated row, a very long text
    out += [(500, k, roles[int(rng.integers(0, 5))], texts[int(rng.integers(0, 4))] if rng.random() < 0.2 else f"text {k}" + ".!x"[int(rng.integers(0, 3))]) for k in range(300)]
    out += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (600, 0, "assistant", "x." * 40000), *[(601, 4, "user", "Same.")] * 5]
    return out


@pytest.fixture(scope="module")
def want(rows):
    return by_force(rows)


@pytest.mark.parametrize("block,fan,parts", [(2048, 32, 4), (3, 2, 4), (1, 3, 2), (7, 4, 1)])
def test_against_search(spark, rows, want, block, fan, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, task int").repartition(5)
        assert got(conversations.repair(df, block, fan)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_edits_that_occur(want):
    """Deleting a row mends an odd number for less than inserting one, so that insertions don't pay at these costs."""
    assert set("".join(r[7] for r in want)) == set("DKR") and any(r[7] == "" for r in want)


def test_insertions_where_they_pay(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(conversations, "INSERT", 1)
    conversations.row_cell.cache_clear()
    audits = ""
    try:
        for _ in range(300):
            rows = [(str(rng.choice(["system", "user", "assistant", "tool"])), "", str(rng.choice(["", "", "blank", "truncated"]))) for _ in range(int(rng.integers(1, 9)))]
            cells = [conversations.row_cell(conversations.symbol(role, {"": "k", "blank": "b", "truncated": "t"}[fault])) for role, _, fault in rows]
            got = conversations.best(conversations.merge(cells))
            assert got == search(rows, 1)[:2]
            audits += got[1]
        assert "I" in audits
    finally:
        conversations.row_cell.cache_clear()


def test_names_of_conversations_may_be_text(spark, rows):
    df = spark.createDataFrame([(None if r[0] is None else str(r[0]), *r[1:]) for r in rows], "conv_id string, turn int, role string, text string")
    named = [(None if r[0] is None else str(r[0]), *r[1:]) for r in by_force([(None if r[0] is None else str(r[0]), *r[1:]) for r in rows])]
    assert got(conversations.repair(df)) == sorted(named, key=str)


def test_empty(spark):
    assert got(conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == []


def test_sql(spark, rows, want, tmp_path):
    """The SQL agrees with the search too."""
    path = os.path.join(tmp_path, "c.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(path)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}'")
    r = con.execute(conversations.SQL)
    columns = [d[0] for d in r.description]
    assert columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((tuple(x) for x in r.fetchall()), key=str) == want
