"""Repair of conversations: the cheapest edits that make their roles ``(system? (user assistant)+)?``, by interval parsing.

The roles' language is regular, so the grammar in Chomsky normal form has a symbol for each pair of its automaton's states
(before and after a span): ``[p, r] -> [p, q] [q, r]``, and ``[p, q]`` derives one row by keeping, rerolling or deleting it
after any insertions (the insertion closure). A cell of a span holds for each symbol the least (cost, audit). Since symbols
name their states, every split of a span gives the same cell, and one even split is enough: spans are combined bottom-up by
their length. Equal costs with one audit a prefix of the other don't occur within a span (each row gives one letter, and what is
inserted costs more), so the least pair of a span is made of least pairs.

Rows are dealt by ranges of (conversation, turn, role) and sorted. A conversation that lies within one task is finished there.
Those at a task's ends, which may go on in the next, are written, and so are conversations of any length: their rows are
parsed in blocks of BLOCK, the blocks' cells are combined FAN at a time, and the texts are joined by block before the digest is
taken over the blocks in order. A digest over one conversation is sequential by its nature: one task reads its joined
blocks as a stream. Its audit is one string in the result, so it must fit into one.

Nulls count as one space in every column: such a text is blank, such a role is neither of the three, such a turn is left out of
gaps and comes first; rows of a null conversation are one conversation. Rows of equal turn come in order of role and text.
Repeated rows are rows of their own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, partitions
from .spelling import CRC_SQL

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block, and blocks or cells combined by one group.
BLOCK, FAN = 2048, 32
#: Bytes of texts joined into one row for the digest.
CHUNK = 1 << 20

STATES = range(4)
#: Role initials that lead from a state to another: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
#: How many insertions lead from a state to another.
INSERTED = {(p, p): 0 for p in STATES} | {(0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}


def _closed(cell: dict) -> dict:
    """A cell with insertions before it."""
    out: dict = {}
    for (p, q), n in INSERTED.items():
        for (a, b), (cost, audit) in cell.items():
            if a == q:
                new = (cost + INSERT * n, "I" * n + audit)
                if (p, b) not in out or new < out[p, b]:
                    out[p, b] = new
    return out


@lru_cache(maxsize=4096)
def row_cell(symbol: str) -> dict:
    """Cell of one row: its role's initial, and d (must go), t (truncated) or k."""
    initial, fault = symbol[:-1], symbol[-1]
    cell = {(p, p): (DELETE, "D") for p in STATES}
    if fault != "d":
        more = TRUNCATED if fault == "t" else 0
        for p in STATES:
            for to, q in NEXT[p].items():
                options = [(more, "K")] if to == initial else []
                options += [(REROLE + more, "R")] if to != "s" else []
                for x in options:
                    if (p, q) not in cell or x < cell[p, q]:
                        cell[p, q] = x
    return _closed(cell)


def combine(left: dict, right: dict) -> dict:
    """Cell of two spans, one after the other."""
    out: dict = {}
    for (p, q), (cost, audit) in left.items():
        for r in STATES:
            x = right.get((q, r))
            if x is not None:
                total = cost + x[0]
                old = out.get((p, r))
                if old is None or total < old[0] or total == old[0] and audit + x[1] < old[1]:
                    out[p, r] = (total, audit + x[1])
    return out


def merge(cells: list[dict]) -> dict:
    """Cell of a run of spans, bottom-up by length."""
    while len(cells) > 1:
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0]


def best(cell: dict) -> tuple[int, str]:
    """The least (cost, audit) from nothing to an accepted state, with insertions at the end."""
    found = []
    for (p, q), (cost, audit) in cell.items():
        if p == 0:
            found += [(cost + INSERT * n, audit + "I" * n) for (a, b), n in INSERTED.items() if a == q and b in ACCEPTED]
    return min(found)


@lru_cache(maxsize=1 << 16)
def parse(symbols: tuple[str, ...]) -> tuple[int, str]:
    """(cost, audit) of a short conversation; few sequences of symbols occur, so they are remembered."""
    return best(merge([row_cell(s) for s in symbols])) if symbols else (0, "")


def fault(role: str, text: str, seen: set) -> str:
    """The first fault of a row: b (blank), d (duplicate), t (truncated), or k. seen: digests of the rows before, which this adds to."""
    end = text.rstrip(SPACE)
    key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
    again = key in seen
    seen.add(key)
    return "b" if not end else "d" if again else "k" if end[-1] in ".!?" else "t"


def symbol(role: str, kind: str) -> str:
    """What parsing sees of a row: a role's initial only where the grammar has it."""
    return (role[:1] if role[:1] in ("s", "u", "a") else "-") + ("d" if kind in "bd" else kind)


def legal(before: str, after: str) -> bool:
    return before[:1] + after[:1] in ("su", "ua", "au")


def apply(audit: str, rows, made: int, system: bool) -> list[str]:
    """Lines of the repaired rows. made: rows that were put out before these; system: whether the first of all is a system row."""
    out, left = [], iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit != "D":
            if edit != "K":
                role = "assistant" if (made - system) % 2 else "user"
            out.append(f"{role}:{text}")
            made += 1
    return out


def has_system(audit: str) -> bool:
    """Pairs of user and assistant are even in number, so an odd count has a system row before them."""
    return (len(audit) - audit.count("D")) % 2 == 1


RESULT = "conv_id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _whole(conv, rows: list[tuple]) -> tuple:
    """The result of a conversation whose rows (turn, role, text, or None in place of a dropped one) are all here, in order."""
    turns, symbols, kept, counts, illegal, last, seen = [], [], [], {"b": 0, "d": 0, "t": 0, "k": 0}, 0, None, set()
    for row in rows:
        if row is None:
            continue
        turn, role, text = row
        if turn is not None:
            turns.append(turn)
        kind = fault(role, text, seen)
        counts[kind] += 1
        symbols.append(symbol(role, kind))
        kept.append((role, text))
        illegal += last is not None and not legal(last, role)
        last = role
    cost, audit = parse(tuple(symbols)) if len(symbols) <= 32 else best(merge([row_cell(s) for s in symbols]))
    lines = apply(audit, kept, 0, has_system(audit))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return conv, gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage; dropped rows stay, marked, so that their conversation is known. copy: 1 for a repetition."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20).cast("int")
    r = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind"))
    # rows of one turn share their kind, so that the order of equal turns is that of the rows before the damage
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.col("role").alias("was"), F.col("text").alias("read"), F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), "kind")
    return r.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind")


#: Of rows whose conversation may go on in another task: where they stand, and their fields.
_LOOSE = "task int, block long, at long, turn {turn}, role string, text string, dropped boolean"


def _sorted(rows: DataFrame) -> DataFrame:
    """Ranges of the conversations in order. Rows of equal turn and role stay in one task by their text's hash only, so that they part by range too."""
    n = partitions(rows.sparkSession)
    # whole texts aren't sampled for the ranges: a prefix orders ranges, and rows alike in it stay together
    dealt = rows.withColumn("lead", F.substring("read", 1, 40)).repartitionByRange(n, F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "was", "lead")
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "was", "read", "copy")


def _first_pass(rows: DataFrame, kinds: dict, most: int) -> DataFrame:
    """Results of the conversations within a task, and the rows of those at its ends and of long ones, by block."""
    schema = f"{RESULT.format(id=kinds['conv_id'])}, {_LOOSE.format(turn=kinds['turn'])}"
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        task, block, size, conv, whole = TaskContext.get().partitionId(), 0, 0, None, None
        held: list[tuple] = []
        out: list[tuple] = []
        types = None

        def put():
            columns = list(zip(*out)) if out else [[]] * len(fields)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields)
            out.clear()
            return batch

        def write():
            """The rows that are held become a block."""
            nonlocal block
            out.extend((conv, *[None] * 8, task, block, at, *row) for at, row in enumerate(held))
            held.clear()
            block += 1

        for b in batches:
            if types is None:
                types = [b.schema.field("conv_id").type, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), b.schema.field("turn").type, pa.string(), pa.string(), pa.bool_()]
            for c, *row in zip(*(b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "dropped"))):
                if whole is None or c != conv:
                    if whole:
                        out.append((*_whole(conv, [None if x[3] else x[:3] for x in held]), *[None] * 7))
                        held.clear()
                    elif held:
                        write()
                    # only the first conversation of a task may have begun before it
                    whole, conv, size = whole is not None, c, 0
                held.append(tuple(row))
                size += len(row[2])
                if len(held) >= most or size > 8 * CHUNK:
                    whole, size = False, 0
                    write()
                    yield put()
            if len(out) > 500:
                yield put()
        if held:
            write()
        if types is not None:
            yield put()

    return rows.select("conv_id", "turn", "role", "text", "dropped").mapInArrow(run, schema)


def _to_columns(cell: dict) -> list:
    return [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in sorted(cell.items())]


_CELL = "array<struct<p:int,q:int,cost:long,audit:string>>"


_KEY = "conv string, void boolean"
_COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal")
_FACTS = "first string, last string, " + ", ".join(f"{c} long" for c in _COUNTS) + f", cell {_CELL}"
_SPAN = f"{_KEY}, task int, block long, {_FACTS}"
_RANKED = f"{_KEY}, rank long, {_FACTS}"
_SAID = f"{_KEY}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PART = f"{_KEY}, task int, block long, part string, made long, system boolean"
_TEXT = f"{_KEY}, task int, block long, piece long, lines string"
_DIGEST = f"{_KEY}, repaired_sha256 string"


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), _CELL: pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))}


def _table(rows: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([(n, _ARROW[t]) for n, t in (x.split(" ") for x in schema.split(", "))]))


def _from_columns(cell: list) -> dict:
    return {(x["p"], x["q"]): (x["cost"], x["audit"]) for x in cell}


def _block_cell(table: pa.Table) -> pa.Table:
    """A block's rows to its cell and counts."""
    t = table.sort_by("at").to_pydict()
    counts, symbols = {"b": 0, "d": 0, "t": 0, "k": 0}, []
    for role, text, new in zip(t["role"], t["text"], t["new"]):
        end = text.rstrip(SPACE)
        kind = "b" if not end else "d" if not new else "k" if end[-1] in ".!?" else "t"
        counts[kind] += 1
        symbols.append(symbol(role, kind))
    illegal = sum(not legal(a, b) for a, b in zip(t["role"], t["role"][1:]))
    one = {c: t[c][0] for c in ("conv", "void", "task", "block")} | {"first": t["role"][0][:1], "last": t["role"][-1][:1], "rows": len(symbols), "blank": counts["b"], "duplicate": counts["d"], "truncated": counts["t"], "illegal": illegal}
    return _table([one | {"cell": _to_columns(merge([row_cell(s) for s in symbols]))}], _SPAN)


def _join_spans(table: pa.Table) -> pa.Table:
    """Spans that follow each other to one."""
    t = table.sort_by("rank").to_pylist()
    total = {c: sum(r[c] for r in t) for c in _COUNTS}
    total["illegal"] += sum(not legal(a["last"], b["first"]) for a, b in zip(t, t[1:]))
    one = {"conv": t[0]["conv"], "void": t[0]["void"], "rank": t[0]["high"], "first": t[0]["first"], "last": t[-1]["last"]} | total
    return _table([one | {"cell": _to_columns(merge([_from_columns(r["cell"]) for r in t]))}], _RANKED)


def _say(batches):
    """Whole conversations' cells to the least edits."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            cost, audit = best(_from_columns(r["cell"]))
            out.append({k: r[k] for k in ("conv", "void", *_COUNTS[1:])} | {"cost": cost, "audit": audit})
        yield from _table(out, _SAID).to_batches()


def _cut(batches):
    """Audits to parts by block. Insertions go with the row that follows them."""
    for b in batches:
        for r in b.to_pylist():
            audit, at, made, out = r["audit"], 0, 0, []
            for i, x in enumerate(r["blocks"]):
                end, left = at, x["rows"]
                while left:
                    left -= audit[end] != "I"
                    end += 1
                if i == len(r["blocks"]) - 1:
                    end = len(audit)
                part = audit[at:end]
                out.append({"conv": r["conv"], "void": r["void"], "task": x["task"], "block": x["block"], "part": part, "made": made, "system": has_system(audit)})
                made += len(part) - part.count("D")
                at = end
            yield from _table(out, _PART).to_batches()


def _texts(rows: pa.Table, parts: pa.Table) -> pa.Table:
    """A block's repaired rows as text, in pieces of some CHUNK."""
    t, p = rows.sort_by("at").to_pydict(), parts.to_pylist()[0]
    out, held, size = [], [], 0
    got = apply(p["part"], zip(t["role"], t["text"]), p["made"], p["system"])
    for k, line in enumerate(got):
        held.append(line)
        size += len(line)
        if size > CHUNK or k == len(got) - 1:
            out.append({c: p[c] for c in ("conv", "void", "task", "block")} | {"piece": len(out), "lines": "\n".join(held)})
            held, size = [], 0
    return _table(out, _TEXT)


def _digests(batches):
    """Sorted pieces to one digest a conversation."""
    now, h = None, None
    for b in batches:
        out = []
        for conv, void, lines in zip(*(b.column(c).to_pylist() for c in ("conv", "void", "lines"))):
            if (conv, void) != now:
                if now is not None:
                    out.append({"conv": now[0], "void": now[1], "repaired_sha256": h.hexdigest()})
                now, h = (conv, void), hashlib.sha256(lines.encode())
            else:
                h.update(b"\n" + lines.encode())
        yield from _table(out, _DIGEST).to_batches()
    if now is not None:
        yield from _table([{"conv": now[0], "void": now[1], "repaired_sha256": h.hexdigest()}], _DIGEST).to_batches()


def _blocks(loose: DataFrame, fan: int) -> DataFrame:
    """Results of the conversations whose rows came by block."""
    key, by = ("conv", "void"), ("conv", "void", "task", "block")
    # a name that nulls join by
    name = lambda df: df.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("void", F.col("conv_id").isNull())
    rows = name(loose.filter("not dropped")).select(*by, "at", "turn", "role", "text")
    # the first row of each role and text, by place: a partial aggregate, and a join by a row's own place
    place = ("task", "block", "at")
    digest = F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), 256)
    first = rows.groupBy(*key, digest.alias("digest")).agg(F.min(F.struct(*place)).alias("f")).select(*(F.col(f"f.{c}") for c in place), F.lit(True).alias("new"))
    rows = materialize(rows.join(first, [*place], "left").withColumn("new", F.coalesce("new", F.lit(False))), "long-rows")
    spans = materialize(rows.groupBy(*by).applyInArrow(_block_cell, _SPAN), "spans")
    # a row for each of a conversation's blocks, few by BLOCK
    order = materialize(spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("task", "block", "rows"))).alias("blocks")), "orders")
    ranks = order.select(*key, F.posexplode("blocks").alias("rank", "b")).select(*key, F.col("rank").cast("long").alias("rank"), "b.task", "b.block")
    ranked = materialize(spans.join(ranks, [*by]).drop("task", "block"), "spans")
    # bottom-up, so many spans at a time
    while not ranked.filter("rank > 0").isEmpty():
        grouped = ranked.withColumn("high", F.floor(F.col("rank") / fan).cast("long")).groupBy(*key, "high")
        before, ranked = ranked, materialize(grouped.applyInArrow(_join_spans, _RANKED), "spans")
        discard(before)
    final = materialize(ranked.select(*key, *_COUNTS[1:], "cell").mapInArrow(_say, _SAID), "audits")
    parts = final.join(order, [*key]).select(*key, "audit", "blocks").mapInArrow(_cut, _PART)
    pieces = rows.groupBy(*by).cogroup(parts.groupBy(*by)).applyInArrow(_texts, _TEXT)
    digests = pieces.repartition(*key).sortWithinPartitions(*by, "piece").select(*key, "lines").mapInArrow(_digests, _DIGEST)
    # each turn once, then their number
    turns = rows.filter("turn is not null").select(*key, "turn").distinct().groupBy(*key).agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).cast("long").alias("gaps"))
    out = name(loose.select("conv_id").distinct()).join(final, [*key], "left").join(turns, [*key], "left").join(digests, [*key], "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NAMES[1:7]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair(rows: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, faults by kind, illegal pairs, gaps, least cost, audit and digest of the repaired rows of every conversation.

    block, fan: rows parsed together where a conversation is long, and spans combined by one group; results don't depend on them."""
    first = materialize(_first_pass(_sorted(damage(rows)), dict(rows.dtypes), block), "conversations")
    done = first.filter("task is null").select(*_NAMES)
    loose = first.filter("task is not null").select("conv_id", "task", "block", "at", "turn", "role", "text", "dropped")
    return done.unionByName(_blocks(loose, fan))


_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({t}, ''), lambda c: ord(c)::bigint)), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1])), 4294967295)"
_SPACES = "\\x20\\x09-\\x0D"


def _plus(value: str, cost: str, letters: str) -> str:
    """SQL of a state's value (nine digits of cost, then the audit) with further edits."""
    return f"(lpad(cast(left({value}, 9)::int + {cost} as varchar), 9, '0') || substr({value}, 10) || {letters})"


_CLOSED = ", ".join(
    "least(" + ", ".join(f"v{p}" if not n else _plus(f"v{p}", str(INSERT * n), f"'{'I' * n}'") for (p, q), n in INSERTED.items() if q == to) + f") as w{to}" for to in STATES)
_STEP = f"""{_plus("w0", str(DELETE), "'D'")} as n0,
        least({_plus("w1", str(DELETE), "'D'")}, case when not gone and initial = 's' then {_plus("w0", "more", "'K'")} end) as n1,
        least({_plus("w2", str(DELETE), "'D'")}, case when not gone then {_plus("least(w0, w1, w3)", f"more + case when initial = 'u' then 0 else {REROLE} end", "case when initial = 'u' then 'K' else 'R' end")} end) as n2,
        least({_plus("w3", str(DELETE), "'D'")}, case when not gone then {_plus("w2", f"more + case when initial = 'a' then 0 else {REROLE} end", "case when initial = 'a' then 'K' else 'R' end")} end) as n3"""
#: DuckDB SQL of the same: states row by row instead of spans.
SQL = f"""
with recursive {CRC_SQL},
kinds as (select conv_id, turn, coalesce(role, ' ') as was, coalesce(text, ' ') as read, {_CRC.format(t="coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc),
damaged as (select conv_id, turn, was, read, unnest(case when kind = 3 then [0, 1] else [0] end) as copy, case when kind = 4 then 'user' else was end as role,
    case kind when 1 then '' when 2 then regexp_replace(read, '[.!?]', '', 'g') else read end as text from kinds where kind <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, was, read, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, was, read, copy) as nth,
    left(role, 1) as initial, not regexp_matches(text, '[^{_SPACES}]') as blank, not regexp_matches(text, '[.!?][{_SPACES}]*\\z') as cut_off from damaged),
rows_ as (select *, not blank and nth > 1 as duplicate, not blank and nth = 1 and cut_off as truncated, lag(initial) over (partition by conv_id order by i) as before from placed),
fold(conv_id, i, v0, v1, v2, v3) as (
    select conv_id, 0::bigint, '000000000', null::varchar, null::varchar, null::varchar from (select distinct conv_id from rows_) x
    union all
    select conv_id, i, n0, n1, n2, n3 from (select conv_id, i, {_STEP} from (select f.conv_id, r.i, initial, blank or duplicate as gone, case when truncated then {TRUNCATED} else 0 end as more, {_CLOSED}
        from fold f join rows_ r on r.conv_id is not distinct from f.conv_id and r.i = f.i + 1) a) b),
ends as (select conv_id, least(w0, w3) as v from (select conv_id, {_CLOSED} from fold f where i = (select max(i) from rows_ r where r.conv_id is not distinct from f.conv_id)) x),
audits as (select conv_id, left(v, 9)::bigint as cost, substr(v, 10) as audit from ends),
letters as (select conv_id, unnest(string_split(audit, '')) as edit, unnest(range(1, length(audit) + 1)) as place, (length(replace(audit, 'D', '')) % 2) as system from audits where audit <> ''),
numbered as (select *, sum(case when edit = 'I' then 0 else 1 end) over p as i, sum(case when edit = 'D' then 0 else 1 end) over p as made from letters window p as (partition by conv_id order by place)),
lines as (select n.conv_id, string_agg(case when edit = 'K' then r.role when (made - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else r.text end, chr(10) order by place) as t
    from numbered n left join rows_ r on r.conv_id is not distinct from n.conv_id and r.i = n.i and n.edit <> 'I' where edit <> 'D' group by n.conv_id),
facts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from rows_ group by conv_id)
select c.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0) as blank, coalesce(f.duplicate, 0) as duplicate, coalesce(f.truncated, 0) as truncated, coalesce(f.illegal, 0) as illegal,
    coalesce(a.cost, 0) as cost, coalesce(a.audit, '') as audit, sha256(coalesce(l.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join facts f on f.conv_id is not distinct from c.conv_id left join audits a on a.conv_id is not distinct from c.conv_id left join lines l on l.conv_id is not distinct from c.conv_id"""
