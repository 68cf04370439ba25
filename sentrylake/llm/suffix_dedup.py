"""Suffix-array dedup (operator 10): a distributed merge sort of sampled suffixes that knows its common prefixes.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere else. All suffixes would be far more than
the text, so suffixes are sampled by content: of every window of LENGTH bytes, the position whose next KEY bytes have
the smallest hash is an anchor. Two equal strings of LENGTH bytes choose the same anchor, so each repeat shows as two
anchors with equal KEY bytes, a common part to the left and a common prefix to the right that make up LENGTH together.

1. Equal texts are one (their copies repeat in full); anchors whose KEY bytes occur once in the corpus drop out.
2. Each task sorts its suffixes (right contexts of LENGTH bytes) and writes a run for each range of leading bytes: the
   length of the prefix shared with the suffix before, then only the bytes after it (front coding). Of suffixes of a slice
   with equal bytes on both sides, as a passage of many texts or a periodic text has them, one is written; that all their
   windows repeat is known already. Leading bytes that fill several ranges are parted by the hash of the KEY bytes.
3. A task for each range merges the runs with a loser tree. Players carry the length of the prefix they share with the
   last winner: the longer one wins without a look at its bytes, and equal ones compare from there on. What comes out is
   the sorted suffixes with the prefix length of each to the one before, never compared twice.
4. Where that length is KEY or more, suffixes form a group. For each offset o from the window's start to the anchor, a
   window repeats when another suffix of the group shares LENGTH - o bytes to the right (from the merged lengths) and the
   o bytes to the left (from hashes of the left contexts).
5. A document's repeated windows are united to spans and cut out.

Offsets count UTF-8 bytes. A null text counts as empty. Repeated rows are copies of each other. Texts under LENGTH bytes
stay whole. An empty table gives no rows. Only doc_id and text are read; a null doc_id is an id like any other. Texts are
known by 64-bit digests, so that different texts may share a doc_id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize
from .encoding import forget, text_slices
from .words import mix, powers

LENGTH, KEY = 400, 48
_rng = np.random.default_rng(1010)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """s with s[j] - s[i] = hash of raw[i:j] times a power of the base, and those powers; modulo 2**64."""
    p = powers(len(raw) + 1)
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * p[: len(raw)], out=s[1:])
    return s, p


_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_inverses = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        out = np.full(1 << (n - 1).bit_length(), _INVERSE, np.uint64)
        out[0] = 1
        _inverses = np.multiply.accumulate(out)
    return _inverses[:n]


def window_hashes(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of raw[i:i+width] for each i."""
    s, _ = prefix_sums(raw)
    n = len(raw) - width + 1
    return mix((s[width:] - s[:n]) * inverse_powers(n))


def anchors(raw: np.ndarray, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Anchor positions and the hashes of their key bytes: of each window of length bytes, the first smallest."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = window_hashes(raw, key)
    width = length - key + 1
    n = len(h) - width + 1
    # sliding minimum: of the part in the block at hand and the part in the next; the position breaks ties
    pad = -len(h) % width
    v = np.append(h, np.full(pad, np.uint64(2**64 - 1))).reshape(-1, width)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    # of windows that share a minimum: its first place in each
    cand = np.flatnonzero(np.isin(h, np.unique(low)))
    order = np.lexsort((cand, h[cand]))
    hs, ps = h[cand][order], cand[order]
    change = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    found = []
    for a, b in zip(change.tolist(), np.append(change[1:], n).tolist()):
        i = np.searchsorted(hs, low[a], "left")
        j = np.searchsorted(hs, low[a], "right")
        if j - i == 1:
            found.append(ps[i])
        else:
            k = np.searchsorted(ps[i:j], np.arange(a, b), "left")
            found += np.unique(ps[i:j][k]).tolist()
    at = np.unique(np.array(found, np.int64))
    return at, h[at]


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Of sorted suffixes: the length shared with the one before, and the rest."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        n = common(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return np.array(shared, np.int32), rest


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be at least start."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    step = 16
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs of (shared length with the one before, suffix, payload).

    Each player holds its suffix and the length of the prefix it shares with the last winner."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.size = 1
        while self.size < max(1, len(self.runs)):
            self.size *= 2
        self.now = [None] * self.size
        self.loser = [0] * self.size
        for i in range(len(self.runs)):
            self._next(i)
            if self.now[i]:
                self.now[i][0] = 0
        self.winner = self._build(1)

    def _next(self, i):
        x = next(self.runs[i], None)
        self.now[i] = list(x) if x is not None else None

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser). The loser's shared length becomes that with this winner."""
        x, y = self.now[a], self.now[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        n = common(x[1], y[1], x[0])
        if x[1][n : n + 1] < y[1][n : n + 1] or (len(x[1]) == n and len(y[1]) == n and a < b):
            y[0] = n
            return a, b
        x[0] = n
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.loser[node] = b
        return a

    def __iter__(self):
        while self.now[self.winner] is not None:
            i = self.winner
            yield self.now[i]
            self._next(i)
            node = (i + self.size) // 2
            while node:
                i, self.loser[node] = self._play(i, self.loser[node])
                node //= 2
            self.winner = i


def repeated_offsets(shared: np.ndarray, left: list[bytes], length: int, key: int) -> np.ndarray:
    """Matrix (offset, suffix): whether the window that starts offset bytes before a suffix occurs twice.

    shared: of each suffix, prefix length common with the one before (under key where a group begins); left: bytes
    before it, nearest last."""
    n, width = len(left), length - key + 1
    have = np.array([len(x) for x in left])
    mat = np.frombuffer(b"".join(x[::-1].ljust(width - 1, b"\0") for x in left), np.uint8).reshape(n, width - 1)
    power, now = powers(width), np.zeros(n, np.uint64)
    out = np.zeros((width, n), bool)
    step = max(1, 1_000_000 // n)
    for o in range(0, width, step):
        offsets = np.arange(o, min(width, o + step))
        # of each offset, the number of the run of suffixes that share length - offset bytes
        block = np.cumsum(shared[None, :] < (length - offsets)[:, None], axis=1).astype(np.uint64)
        h = np.zeros((len(offsets), n), np.uint64)
        for j, q in enumerate(offsets.tolist()):
            h[j] = now
            if q < width - 1:
                now = now + _VALUE[mat[:, q]] * power[q]
        tag = mix(mix(h + np.uint64(1)) + block)
        order = np.argsort(tag, axis=1)
        s = np.take_along_axis(tag, order, axis=1)
        same = s[:, 1:] == s[:, :-1]
        twice = np.zeros(tag.shape, bool)
        twice[:, 1:] |= same
        twice[:, :-1] |= same
        part = np.zeros(tag.shape, bool)
        np.put_along_axis(part, order, twice, axis=1)
        out[offsets] = part & (have[None, :] >= offsets[:, None])
    return out


def spans_of(marks: np.ndarray, at: np.ndarray, right: np.ndarray, length: int):
    """Per suffix (column of marks): spans of bytes that its repeated windows cover, as (suffix, first, end)."""
    off = np.arange(marks.shape[0])[:, None]
    ok = marks & (right[None, :] >= length - off)
    grown = np.zeros((ok.shape[0] + 2, ok.shape[1]), np.int8)
    grown[1:-1] = ok
    step = np.diff(grown, axis=0)
    col_a, first = np.nonzero(step.T == 1)
    col_b, last = np.nonzero(step.T == -1)
    # offsets first..last-1 of a suffix: windows from at - (last - 1) to at - first + length
    return col_a, at[col_a] - (last - 1), at[col_a] - first + length


def _rows_schema(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def _batch(rows, schema: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)


def text_id(text: bytes) -> int:
    """A 64-bit name of a text, from a digest."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _leading(raw: bytes) -> int:
    """The first 8 bytes as a signed number in the order of the bytes."""
    return int.from_bytes(raw[:8].ljust(8, b"\0"), "big") - (1 << 63)


def _describe(docs: DataFrame, length: int, key: int) -> DataFrame:
    """Per row: doc_id, tid, keys (hashes of its anchors, each once), twice (those that stand there more than once), and the leading bytes of one anchor in 64 for choosing ranges."""
    out = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("long", pa.bool_()), ("keys", pa.list_(pa.int64())), ("twice", pa.list_(pa.int64())), ("leading", pa.list_(pa.int64()))])

    def run(batches):
        forget()
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                rows = []
                for t in texts:
                    pos, h = anchors(np.frombuffer(t, np.uint8), length, key)
                    own, first, times = np.unique(h.view(np.int64), return_index=True, return_counts=True)
                    lead = [_leading(t[p : p + 8]) for p in pos[first[own % 64 == 0]].tolist()]
                    rows.append((text_id(t), len(t) >= length, own, own[times > 1], lead))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *(pa.array(c, t) for c, t in zip(cols, out.types[1:]))], schema=out)

    return docs.mapInArrow(run, "doc_id long, tid long, long boolean, keys array<long>, twice array<long>, leading array<long>")


#: Suffixes in a range, about: what one merging task holds.
RANGE = 20_000
#: Bytes of lists, and ids, that are broadcast at most; more are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_IDS = 4 << 20, 1_000_000


def _small(df: DataFrame, entries) -> bool:
    """Whether rows of some 64 bytes and entries of some 32 bytes each are few enough to be broadcast."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(entries).alias("entries")).first()
    return r["rows"] * 64 + (r["entries"] or 0) * 32 <= BROADCAST_BYTES


def _alike(texts: list[bytes], places: list[np.ndarray], length: int, key: int) -> tuple[list[np.ndarray], list[tuple[int, int, int]]]:
    """(places without those whose bytes on both sides are the same as an earlier one's; spans (text, first, end) of all windows of such places)."""
    before = length - key
    text, at, digest = [], [], []
    for i, (t, p) in enumerate(zip(texts, places)):
        p = p[(p >= before) & (p + length <= len(t))]
        if len(p):
            s, _ = prefix_sums(np.frombuffer(t, np.uint8))
            digest.append(mix((s[p + length] - s[p - before]) * inverse_powers(int(p[-1]) - before + 1)[p - before]))
            text.append(np.full(len(p), i))
            at.append(p)
    if not at:
        return places, []
    text, at, digest = np.concatenate(text), np.concatenate(at), np.concatenate(digest)
    _, first, of, times = np.unique(digest, return_index=True, return_inverse=True, return_counts=True)
    many = times[of] > 1
    gone = np.ones(len(at), bool)
    gone[first] = False
    out, spans = list(places), []
    for i in np.unique(text[many]).tolist():
        own = text == i
        spans += [(i, a, e) for a, e in united((p - before, p + length) for p in at[own & many].tolist())]
        out[i] = np.setdiff1d(places[i], at[own & gone], assume_unique=True)
    return out, spans


def _runs(docs: DataFrame, wanted: DataFrame, cuts: list[int], length: int, key: int) -> DataFrame:
    """For each slice of texts and each range: the slice's suffixes in that range, sorted and front-coded (a run); and, with a null range, spans that are known to repeat."""
    out = pa.schema([("range", pa.int32()), ("shared", pa.binary()), ("rest_size", pa.binary()), ("rest", pa.binary()), ("tid", pa.binary()), ("at", pa.binary()), ("left_size", pa.binary()), ("left", pa.binary()), ("end", pa.binary())])
    numbers = lambda x, kind: np.array(x, kind).tobytes()
    # equal cuts: their leading bytes fill as many ranges
    edges, fills = np.unique(np.array(cuts, np.int64), return_counts=True)
    start = np.append(0, np.cumsum(fills))

    def run(batches):
        for b in batches:
            tids, keys = b.column(0).to_pylist(), b.column(1)
            for first, texts in text_slices(b.column(2), 4 << 20):
                places, hashes = [], []
                for i, t in enumerate(texts):
                    at, h = anchors(np.frombuffer(t, np.uint8), length, key) if text_id(t) == tids[first + i] else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                    keep = np.isin(h.view(np.int64), keys[first + i].values.to_numpy())
                    places.append(at[keep])
                    hashes.append(h[keep])
                every = list(places)
                places, spans = _alike(texts, places, length, key)
                if spans:
                    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), *(pa.array([None], pa.binary()) for _ in range(3)), pa.array([numbers([tids[first + i] for i, _, _ in spans], np.int64)]), pa.array([numbers([a for _, a, _ in spans], np.int64)]), *(pa.array([None], pa.binary()) for _ in range(2)), pa.array([numbers([e for _, _, e in spans], np.int64)])], schema=out)
                got = []
                for i, t in enumerate(texts):
                    own = hashes[i][np.searchsorted(every[i], places[i])].tolist()
                    got += [(t[p : p + length], tids[first + i], p, t[max(0, p - (length - key)) : p], x) for p, x in zip(places[i].tolist(), own)]
                got.sort()
                lead = np.array([_leading(g[0]) for g in got], np.int64)
                at = np.searchsorted(edges, lead, side="right")
                where = start[at]
                hot = np.flatnonzero((at > 0) & (edges[np.maximum(at - 1, 0)] == lead)) if len(edges) else []
                for i in hot:
                    where[i] = start[at[i] - 1] + 1 + got[i][4] % int(fills[at[i] - 1])
                rows = []
                for r in np.unique(where).tolist():
                    part = [got[i] for i in np.flatnonzero(where == r)]
                    shared, rest = front_code([g[0] for g in part])
                    rows.append((r, shared.tobytes(), numbers([len(x) for x in rest], np.int32), b"".join(rest), numbers([g[1] for g in part], np.int64), numbers([g[2] for g in part], np.int64), numbers([len(g[3]) for g in part], np.int32), b"".join(g[3] for g in part), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)

    # first only the rows that are wanted at all, by ids that are broadcast if they are few; then their lists
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    docs = docs.join(ids, docs["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi")
    lists = wanted.select(F.col("doc_id").alias("wanted_id"), "tid", "keys")
    if _small(wanted, F.size("keys")):
        lists = F.broadcast(lists)
    rows = docs.join(lists, docs["doc_id"].eqNullSafe(lists["wanted_id"])).select("tid", "keys", "text")
    return rows.mapInArrow(run, "range int, shared binary, rest_size binary, rest binary, tid binary, at binary, left_size binary, left binary, end binary")


def _decode(row: dict):
    """The suffixes of a run in turn: [shared length, suffix, (text, place, left context)]."""
    shared, size = np.frombuffer(row["shared"], np.int32).tolist(), np.frombuffer(row["rest_size"], np.int32).tolist()
    tid, at = np.frombuffer(row["tid"], np.int64).tolist(), np.frombuffer(row["at"], np.int64).tolist()
    last, i, j = b"", 0, 0
    for k, n in enumerate(np.frombuffer(row["left_size"], np.int32).tolist()):
        last = last[: shared[k]] + row["rest"][i : i + size[k]]
        yield shared[k], last, (tid[k], at[k], row["left"][j : j + n])
        i, j = i + size[k], j + n


def merge_runs(rows: list[dict], length: int, key: int):
    """Spans (text, first, end) that the repeated windows of the merged suffixes cover."""
    shared, held = [], []

    def flush():
        marks = repeated_offsets(np.array(shared), [h[1][2] for h in held], length, key)
        at = np.array([h[1][1] for h in held])
        col, first, end = spans_of(marks, at, np.array([h[0] for h in held]), length)
        return [(held[c][1][0], a, b) for c, a, b in zip(col.tolist(), first.tolist(), end.tolist())]

    out, alike = [], {}
    for n, suffix, payload in LoserTree([_decode(r) for r in rows]):
        # equal bytes on both sides: all windows repeat, and one of them stands for the others in its group
        tid, at, left = payload
        if n < len(suffix) or held and len(suffix) != held[-1][0]:
            alike = {}
        if len(suffix) == length and len(left) == length - key and left in alike:
            out += [(*alike[left], 0), (tid, at, 0)] if alike[left] else [(tid, at, 0)]
            alike[left] = None
            continue
        alike[left] = (tid, at)
        if n < key:
            if len(held) == 1:
                shared, held = [], []
            elif len(held) >= 4096:
                out += flush()
                shared, held = [], []
            elif len(held) > 1 and shared[-1] < key:
                shared.pop()
                held.pop()
        shared.append(n)
        held.append((len(suffix), payload))
    if len(held) > 1:
        out += flush()
    return [x if x[2] else (x[0], x[1] - (length - key), x[1] + length) for x in out]


def united(spans) -> list[list[int]]:
    """Maximal runs of the bytes that spans (first, end) cover; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def removals(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> tuple[DataFrame, DataFrame]:
    """(docs as doc_id, text; per doc_id with anything to remove: cuts, a list of (tid, whole, spans))."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    info = materialize(_describe(docs, length, key), "anchors")
    per = materialize(info.groupBy("tid").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id")).alias("rep"), F.first("long").alias("long")), "texts")
    reps = per.filter("long").select("tid", F.col("rep.doc_id").alias("doc_id"))
    # rows repeated with the same doc_id and text are one here
    one = info.filter("long").join(reps, (info["tid"] == reps["tid"]) & info["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").dropDuplicates(["tid"])
    at = one.select("tid", "doc_id", "twice", F.explode("keys").alias("key")).select("tid", "doc_id", "key", F.array_contains("twice", F.col("key")).alias("again"))
    often = at.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).filter("n > 1 or again").select("key")
    wanted = materialize(at.join(often, "key").groupBy("tid", "doc_id").agg(F.collect_set("key").alias("keys")), "repeated-anchors")
    n = wanted.agg(F.sum(F.size("keys"))).first()[0] or 0
    ranges = max(1, n // RANGE)
    quantiles = [i / ranges for i in range(1, ranges)]
    # as many numbers as ranges
    cuts = info.select(F.explode("leading").alias("x")).agg(F.percentile_approx("x", F.array(*map(F.lit, quantiles)), 100_000)).first()[0] if quantiles else []
    runs = materialize(_runs(docs, wanted.select("doc_id", "tid", "keys"), list(cuts or []), length, key), "suffix-runs")
    schema = pa.schema([("tid", pa.int64()), ("first", pa.int64()), ("end", pa.int64())])

    def merge(t: pa.Table) -> pa.Table:
        rows = merge_runs(t.to_pylist(), length, key)
        return pa.table([pa.array(c, x) for c, x in zip(zip(*rows) if rows else [[], [], []], schema.types)], schema=schema)

    def known(batches):
        for b in batches:
            for tid, first, end in zip(*(b.column(i).to_pylist() for i in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (tid, first, end)], schema=schema)

    merged = runs.filter("range is not null").groupBy("range").applyInArrow(merge, "tid long, first long, end long")
    spans = materialize(merged.unionByName(runs.filter("range is null").select("tid", "at", "end").mapInArrow(known, "tid long, first long, end long")), "repeated-spans")
    lists = spans.groupBy("tid").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    whole = per.filter("copies > 1 and long").select("tid", F.lit(True).alias("whole"))
    cut = lists.join(whole, "tid", "full").select("tid", F.coalesce("whole", F.lit(False)).alias("whole"), F.when(F.col("whole"), F.array().cast("array<struct<first:long,end:long>>")).otherwise(F.col("spans")).alias("spans"))
    ids = info.filter("long").select("doc_id", "tid").distinct()
    cut = ids.join(cut, "tid").groupBy("doc_id").agg(F.collect_list(F.struct("tid", "whole", "spans")).alias("cuts"))
    cut = materialize(cut, "cuts")
    for done in (info, per, wanted, runs, spans):
        discard(done)
    return docs, cut


def report(docs: DataFrame, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the spans (byte offsets) themselves."""
    docs, cuts = removals(docs, length, key)
    small = _small(cuts, F.expr("aggregate(cuts, 0, (n, c) -> n + 1 + size(c.spans))"))
    cuts = cuts.withColumnRenamed("doc_id", "cut_id")
    rows = docs.join(F.broadcast(cuts) if small else cuts, docs["doc_id"].eqNullSafe(cuts["cut_id"]), "left").select("doc_id", "text", "cuts")
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        for b in batches:
            lists = b.column(2)
            for at, texts in text_slices(b.column(1)):
                done = []
                for t, found in zip(texts, lists.slice(at, len(texts)).to_pylist()):
                    own = next((c for c in found or [] if c["tid"] == text_id(t)), None)
                    spans = [] if own is None else [[0, len(t)]] if own["whole"] else united((x["first"], x["end"]) for x in own["spans"])
                    kept, last = [], 0
                    for a, e in spans:
                        kept.append(t[last:a])
                        last = e
                    kept = b"".join([*kept, t[last:]])
                    done.append((len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *(pa.array(c, x) for c, x in zip(zip(*done), out.types[1:]))], schema=out)

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")
