"""Best-fit packing (operator 2) by linear grouping.

Every document's ids (text encoded, then id 0) are one piece, or pieces of ``capacity`` ids where there are more; only
the last piece may be shorter. Pieces are packed into sequences of at most ``capacity`` ids:

1. count the pieces of each length (one row a length, so at most ``capacity`` rows, whatever the corpus);
2. deal the lengths over a limit into groups of equal numbers of pieces and round each up to its group's largest;
3. choose configurations (multisets of the few rounded sizes that fit) by column generation: a linear program over
   configurations, priced by a knapsack; whole multiples are taken, the rest of the large pieces is packed by best fit;
4. put the actual lengths in place of the rounded ones, longest first, so that room appears;
5. best-fit the small pieces, longest first, into the fullest sequence that takes them; new sequences for what is left.

Steps 2 to 5 work on counts of lengths, never on documents: what they return is a table of runs (so many sequences
alike, each with one piece of each given length), and pieces find their place by their rank among those of their length.
Ranks come from counts per (length, salt), so no length is gathered in one task. Several group counts and limits are
tried and the packing with the fewest sequences is used.

A null text counts as empty: id 0 alone, a piece of length 1. Repeated rows are packed one by one. An empty table gives
no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .encoding import default_path, encoder, text_slices

CAPACITY = 2048
#: (smallest large length as a share of the capacity, groups) that are tried.
TRIALS = ((1 / 4, 16), (1 / 4, 48), (1 / 8, 32), (1 / 8, 96), (1 / 2, 64))
#: Rows of a length that are ranked in one sort at most, about.
ROWS_PER_SALT = 200_000


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    path = path or default_path("word_bpe_49k.json")
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for at, texts in text_slices(batch.column(1), 2 << 20):
                rows = []
                for i, ids in enumerate(enc.encode(texts)):
                    ids += end
                    for k, b in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[b : b + 4 * capacity]
                        rows.append((docs[at + i], k, b // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def knapsack(sizes: np.ndarray, prices: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes within capacity, with at most most[i] of each."""
    best, take = np.zeros(capacity + 1), []
    for s, p, m in zip(sizes.tolist(), prices.tolist(), most.tolist()):
        used = np.zeros(capacity + 1, np.int64)
        base = best.copy()
        if p > 1e-12:
            for k in range(1, min(m, capacity // s) + 1):
                new = base[: capacity + 1 - k * s] + k * p
                better = new > best[k * s :] + 1e-12
                best[k * s :][better] = new[better]
                used[k * s :][better] = k
        take.append(used)
    chosen, room = np.zeros(len(sizes), np.int64), capacity
    for i in range(len(sizes) - 1, -1, -1):
        chosen[i] = take[i][room]
        room -= chosen[i] * sizes[i]
    return float(best[capacity]), chosen


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, never more pieces than there are; by column generation, rounded down."""
    k = len(sizes)
    most = np.minimum(counts, capacity // sizes)
    columns = np.diag(most.astype(float))
    x = counts / most
    for _ in range(rounds):
        duals = np.linalg.solve(columns.T, np.ones(k))
        value, new = knapsack(sizes, duals, most, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, new.astype(float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        theta = max(0.0, ratio[out])
        x = np.maximum(0, x - theta * step)
        columns[:, out], x[out] = new, theta
    found, left = [], counts.astype(np.int64).copy()
    for j in np.argsort(-x, kind="stable"):
        c = columns[:, j].round().astype(np.int64)
        times = min([int(np.floor(x[j] + 1e-6)), *(left[c > 0] // c[c > 0]).tolist()])
        if times > 0:
            found.append((c, times))
            left -= c * times
    return found


class Runs:
    """Sequences alike: (lengths, number), kept by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.by_room = capacity, [], {}

    def add(self, lengths: tuple, number: int) -> None:
        room = self.capacity - sum(lengths)
        if room not in self.by_room:
            insort(self.rooms, room)
            self.by_room[room] = []
        self.by_room[room].append((lengths, number))

    def best_fit(self, length: int, number: int) -> None:
        """Put number pieces of one length where least room is left, one at a time in effect, many at a time in fact."""
        while number:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length
                if number >= each:
                    self.add((length,) * each, number // each)
                number %= each
                if number:
                    self.add((length,) * number, 1)
                return
            room = self.rooms[at]
            lengths, n = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
                self.rooms.pop(at)
            # a sequence that took a piece is the fullest that may take the next
            fit = room // length
            full, rest = divmod(min(number, fit * n), fit)
            if full:
                self.add(lengths + (length,) * fit, full)
            if rest:
                self.add(lengths + (length,) * rest, 1)
            if n > full + bool(rest):
                self.add(lengths, n - full - bool(rest))
            number -= full * fit + rest

    def all(self):
        return [x for room in self.rooms for x in self.by_room[room]]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, share: float, groups: int) -> list[tuple[tuple, int]]:
    """Runs of sequences that hold so many pieces of each length."""
    runs = Runs(capacity)
    full = lengths == capacity
    if full.any():
        runs.add((capacity,), int(counts[full][0]))
    rest = {int(a): int(b) for a, b in zip(lengths[~full], counts[~full])}
    large = np.array(sorted(x for x in rest if x > share * capacity), np.int64)
    if len(large):
        n = np.array([rest[int(x)] for x in large], np.int64)
        each = max(1, -(-int(n.sum()) // groups))
        edges = (np.cumsum(n) - 1) // each
        names, first = np.unique(edges, return_index=True)
        last = np.append(first[1:], len(large))
        # a length is never split over groups, so a group's size is its largest length
        sizes = large[last - 1]
        totals = np.add.reduceat(n, first)
        stacks = [[[int(large[i]), int(n[i])] for i in range(a, b)] for a, b in zip(first, last)]
        for config, times in configurations(sizes, totals, capacity):
            slots = [g for g in np.flatnonzero(config)[::-1] for _ in range(config[g])]
            while times:
                # the longest that are left of each group, in as many sequences as get the same lengths
                need: dict[tuple[int, int], int] = {}
                for g in slots:
                    i = len(stacks[g]) - 1
                    while need.get((g, i), 0) >= stacks[g][i][1]:
                        i -= 1
                    need[g, i] = need.get((g, i), 0) + 1
                take = min([times, *(stacks[g][i][1] // k for (g, i), k in need.items())])
                runs.add(tuple(stacks[g][i][0] for (g, i), k in need.items() for _ in range(k)), take)
                for (g, i), k in need.items():
                    stacks[g][i][1] -= k * take
                for g in set(slots):
                    stacks[g] = [s for s in stacks[g] if s[1]]
                times -= take
        for x in large.tolist():
            rest.pop(x)
        rest |= {x: n for s in stacks for x, n in s}
    for x in sorted(rest, reverse=True):
        runs.best_fit(x, rest[x])
    return runs.all()


def best_plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """The plan with the fewest sequences among the trials; stops at the least number that any packing can have."""
    least = -(-int((lengths * counts).sum()) // capacity)
    best, fewest = [], None
    for share, groups in TRIALS:
        found = plan(lengths, counts, capacity, share, groups)
        n = sum(k for _, k in found)
        if fewest is None or n < fewest:
            best, fewest = found, n
        if fewest <= least:
            break
    return best


def streams(found: list[tuple[tuple, int]]) -> pd.DataFrame:
    """Rows (length, rank, n, sequence_id, place): the pieces of a length from rank on lie at place in n sequences in turn."""
    ranks: dict[int, int] = {}
    rows, seq = [], 0
    for lengths, n in found:
        place = 0
        for x in lengths:
            rows.append((x, ranks.get(x, 0), n, seq, place))
            ranks[x] = ranks.get(x, 0) + n
            place += x
        seq += n
    return pd.DataFrame(rows, columns=["length", "rank", "n", "sequence_id", "place"]).sort_values(["length", "rank"], ignore_index=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(materialize(pieces(docs, capacity, path, end_id), "pieces"), capacity)


def pack_pieces(p: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = p.sparkSession
    # one row for each length from 1 to capacity
    counts = p.groupBy("length").count().toPandas().sort_values("length")
    table = streams(best_plan(counts["length"].to_numpy(np.int64), counts["count"].to_numpy(np.int64), capacity))
    salts = max(32, int(counts["count"].sum()) // ROWS_PER_SALT)
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    per = p.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("length", "salt", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = p.withColumn("own", own).join(per, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    sent = spark.sparkContext.broadcast(tuple(table[c].to_numpy(np.int64) for c in ("length", "rank", "sequence_id", "place")))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks, seqs, places = sent.value
        keys = lengths << 48 | ranks
        at = np.searchsorted(keys, length.to_numpy(np.int64) << 48 | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": seqs[at] + rank.to_numpy(np.int64) - ranks[at], "offset": places[at]})

    return ranked.withColumn("at", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
