"""N-gram Jaccard join (operator 7): size-banded tiles with hashed bitmap signatures.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents of equal sets form one class.

1. What two sets of a similarity of PERCENT % have in common is PERCENT % of either, so a class stays only if so many of its
   shingles stand in another class too. Shingles are counted in buckets of bounded size: slices of texts send a bucket the
   leading bits of their distinct shingles, packed, each once, and get back how many of each class are shared. Bits that
   agree by chance, and copies that two slices see, can only keep a class that could go.
2. The sets of the classes that stay are written as sorted arrays and their shingles counted in the same way.
3. Similar classes share one of their first shingles in any fixed order (a set of n shingles has
   n - ceil(PERCENT * n / 100) + 1 of these). The order is by count, rare ones first. Those that more than one class has
   name the tiles.
4. Within a tile, every class is compared with the first one (by a mixed id). Tiles that still hold more than one component
   are cut into blocks by size; blocks whose sizes are within the ratio meet, and only pairs of different components are
   looked at. The first two of these passes take a spanning forest of the pairs left (those of the largest bounds, then
   any), no more than a block has classes, and name the tiles in which pairs are left; the last one takes every pair of those.
5. The bit count of two bitmaps bounds the overlap from above, so most pairs fall there; the pairs left are decided by
   intersecting the sorted arrays.

All bounds are exact filters. Links between classes that one component already joins are not sought. Nothing is capped or
sampled.

A text without words, or null, has an empty set and is linked with nothing. Rows that repeat a doc_id are linked as rows
but share that id. A null doc_id takes no part in links and is returned with itself (null). Only doc_id and text are
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, small_batches, unused
from .components import components
from .encoding import forget, release, text_slices
from .words import mix, shingles, words

N, PERCENT = 5, 80
#: Shingles that a counting task holds at a time, about, and those of a slice that is counted by itself before.
BUCKET, SLICE, SETS_SLICE = 1 << 20, 1 << 19, 1 << 17
_MANY = 65535
#: Classes of a tile that are compared in one block.
BLOCK = 1024


def _sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, bound = shingles(words(texts), n)
    return [np.unique(h[a:b]) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a set, from a digest of its sorted hashes; 0 for the empty set."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else 0


def describe(docs: DataFrame, n: int = N) -> DataFrame:
    """Per row: doc_id, size of its set, the set's id."""
    out = pa.schema([("doc_id", pa.int64()), ("size", pa.int64()), ("id", pa.int64())])

    def run(batches):
        forget()
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                sets = _sets(texts, n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())], schema=out)

    return materialize(_texts(docs).mapInArrow(run, "doc_id long, size long, id long"), "shingle-sets")


def _bits(total: int) -> int:
    """Leading bits that choose a bucket."""
    return max(1, (total // BUCKET).bit_length())


def _bucket_rows(sets: list[np.ndarray], number: int, bits: int, width: int):
    """A slice's distinct shingles by bucket: (bucket, codes of width bytes, the class of each or _MANY), and how many of each class stand in two."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets)
    order = np.argsort(h, kind="stable")
    h, who = h[order], who[order]
    new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    count = np.diff(np.append(new, len(h)))
    local = np.bincount(who[np.repeat(count > 1, count)], minlength=len(sets))
    h, who = h[new], np.where(count > 1, _MANY, who[new])
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64)
    if width < 4:
        # classes in turn, so that their numbers pack well; else the shingles stay in order
        order = np.argsort(bucket * (_MANY + 1) + who, kind="stable")
        h, who, bucket = h[order], who[order], bucket[order]
    code = (h >> np.uint64(64 - bits - 8 * width)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
    rows = []
    for k in range(1 << bits):
        a, b = int(ends[k]), int(ends[k + 1])
        if b > a or k == number % (1 << bits):
            own = who[a:b].astype(np.uint16) if width < 4 else np.minimum(count[a:b], _MANY).astype(np.uint16)
            rows.append((k, code[a:b].tobytes(), (np.diff(own, prepend=np.uint16(0)) if width < 4 else own).tobytes()))
    return rows, local


def _codes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u4")[:, 0]


def _totals(codes: list[np.ndarray], times: np.ndarray) -> np.ndarray:
    """Of each code, the sum of times over all places where it stands."""
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    s = every[order]
    new = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    total = np.add.reduceat(times[order], new)
    out = np.empty(len(s), np.int64)
    out[order] = np.repeat(total, np.diff(np.append(new, len(s))))
    return out


def _sharing(docs: DataFrame, total: int, n: int, percent: int) -> DataFrame:
    """Ids of the classes of which percent % of the shingles, or more, stand in another class too (or seem to)."""
    bits, width = _bits(total), 3
    out = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("codes", pa.binary()), ("who", pa.binary()), ("ids", pa.binary()), ("sizes", pa.binary()), ("local", pa.binary())])

    def run(batches):
        seen, held, size, number = set(), [], 0, TaskContext.get().partitionId() << 32

        def send():
            rows, local = _bucket_rows([s for _, s in held], number, bits, width)
            own = number % (1 << bits)
            extra = (np.array([k for k, _ in held], np.int64).tobytes(), np.array([len(s) for _, s in held], np.int32).tobytes(), local.astype(np.int32).tobytes())
            cols = list(zip(*[(k, number, c, w, *(extra if k == own else (None, None, None))) for k, c, w in rows]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, out.types)], schema=out)

        for b in batches:
            known = b.column(0).is_valid().to_pylist()
            for at, texts in text_slices(b.column(1)):
                for s, valid in zip(_sets(texts, n), known[at:]):
                    key = set_id(s)
                    if not valid or not len(s) or key in seen:
                        continue
                    seen.add(key)
                    held.append((key, s))
                    size += len(s)
                    if size >= SLICE or len(held) == _MANY - 1:
                        yield send()
                        held, size, number = [], 0, number + 1
                if len(seen) > 200_000:
                    seen.clear()
        if held:
            yield send()

    def count(t: pa.Table) -> pa.Table:
        codes = [_codes(x, width) for x in t["codes"].to_pylist()]
        who = [np.cumsum(np.frombuffer(x, np.uint16), dtype=np.uint16) for x in t["who"].to_pylist()]
        shared = _totals(codes, 1 + (np.concatenate(who) == _MANY)) > 1 if sum(map(len, codes)) else np.zeros(0, bool)
        release()
        rows, at = [], 0
        for w in who:
            at, own = at + len(w), w[shared[at : at + len(w)]]
            k, m = np.unique(own[own < _MANY], return_counts=True)
            rows.append((k.tobytes(), np.minimum(m, _MANY).astype(np.uint16).tobytes()))
        return pa.table({"slice": t["slice"], "who": pa.array([r[0] for r in rows], pa.binary()), "n": pa.array([r[1] for r in rows], pa.binary()), "ids": t["ids"], "sizes": t["sizes"], "local": t["local"]})

    def add(t: pa.Table) -> pa.Table:
        ids, sizes, total = (np.frombuffer(next(x for x in t[c].to_pylist() if x is not None), k) for c, k in (("ids", np.int64), ("sizes", np.int32), ("local", np.int32)))
        total = total.astype(np.int64)
        for who, m in zip(t["who"].to_pylist(), t["n"].to_pylist()):
            total[np.frombuffer(who, np.uint16)] += np.frombuffer(m, np.uint16)
        return pa.table({"id": pa.array(ids[100 * total >= percent * sizes.astype(np.int64)])})

    sent = _texts(docs).mapInArrow(run, "bucket int, slice long, codes binary, who binary, ids binary, sizes binary, local binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "slice long, who binary, n binary, ids binary, sizes binary, local binary")
    return counted.groupBy("slice").applyInArrow(add, "id long")


def _arrays(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The wanted sets (id, first_doc) in slices: slice, ids, sizes, shingles (the sorted hashes one set after the other)."""
    ids = sized(wanted.select(F.col("first_doc").alias("doc_id")).distinct())
    picked = _texts(docs).join(ids, "doc_id", "left_semi").select("doc_id", "text")
    out = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            for _, texts in text_slices(b.column(1)):
                sets = _sets(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=out)

    rows = picked.mapInArrow(run, "id long, shingles binary")
    # a doc_id may repeat: one row for a set
    if not picked.groupBy("doc_id").count().filter("count > 1").isEmpty():
        rows = rows.join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])
    packed = pa.schema([("slice", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("shingles", pa.binary())])

    def pack(batches):
        held, size, number = [], 0, TaskContext.get().partitionId() << 32

        def send():
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.array([k for k, _ in held], np.int64).tobytes()]), pa.array([np.array([len(s) // 8 for _, s in held], np.int32).tobytes()]), pa.array([b"".join(s for _, s in held)])], schema=packed)

        for b in batches:
            for key, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((key, s))
                size += len(s) // 8
                if size >= SETS_SLICE:
                    yield send()
                    held, size, number = [], 0, number + 1
        if held:
            yield send()

    return materialize(rows.mapInArrow(pack, "slice long, ids binary, sizes binary, shingles binary"), "similar-sets")


def _unpacked(ids: bytes, sizes: bytes, shingles: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.frombuffer(ids, np.int64), np.split(np.frombuffer(shingles, np.uint64), np.cumsum(np.frombuffer(sizes, np.int32))[:-1])


def _first_entries(arrays: DataFrame, total: int, percent: int) -> DataFrame:
    """Per set and first shingle that more than one set has: shingle, id, size."""
    bits, width = _bits(total), 4
    out = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("codes", pa.binary()), ("times", pa.binary())])

    def run(batches):
        for b in batches:
            for number, *rest in zip(*(b.column(i).to_pylist() for i in range(4))):
                rows, _ = _bucket_rows(_unpacked(*rest)[1], number, bits, width)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*[(k, number, c, w) for k, c, w in rows]), out.types)], schema=out)

    def count(t: pa.Table) -> pa.Table:
        codes = [_codes(x, width) for x in t["codes"].to_pylist()]
        times = np.concatenate([np.frombuffer(x, np.uint16) for x in t["times"].to_pylist()]).astype(np.int64)
        total = np.minimum(_totals(codes, times), _MANY).astype(np.uint16) if len(times) else times.astype(np.uint16)
        parts = np.split(total, np.cumsum([len(c) for c in codes])[:-1])
        release()
        return pa.table({"slice": t["slice"], "bucket": t["bucket"], "times": pa.array([p.tobytes() for p in parts], pa.binary())})

    counted = arrays.mapInArrow(run, "bucket int, slice long, codes binary, times binary").groupBy("bucket").applyInArrow(count, "slice long, bucket int, times binary")
    counted = counted.groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("bucket", "times"))).alias("parts")).select("slice", F.col("parts.times").alias("times"))
    firsts = pa.schema([("shingle", pa.int64()), ("id", pa.int64()), ("size", pa.int32())])

    def choose(batches):
        for b in batches:
            for ids, sizes, shingles, times in zip(*(b.column(i).to_pylist() for i in range(4))):
                names, sets = _unpacked(ids, sizes, shingles)
                every, count = np.unique(np.frombuffer(shingles, np.uint64)), np.frombuffer(b"".join(times), np.uint16)
                found = []
                for key, s in zip(names.tolist(), sets):
                    c = count[np.searchsorted(every, s)]
                    # too few are shared: no other set can be similar
                    if 100 * int((c > 1).sum()) < percent * len(s):
                        continue
                    first = np.lexsort((s, c))[: len(s) - -(-percent * len(s) // 100) + 1]
                    first = s[first[c[first] > 1]]
                    found.append((first, key, len(s)))
                if found:
                    k = [len(f[0]) for f in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[0] for f in found]).view(np.int64)), pa.array(np.repeat(np.array([f[1] for f in found], np.int64), k)), pa.array(np.repeat(np.array([f[2] for f in found], np.int32), k))], schema=firsts)

    return arrays.join(counted, "slice").select("ids", "sizes", "shingles", "times").mapInArrow(choose, "shingle long, id long, size int")


def bitmap(s: np.ndarray) -> bytes:
    """A signature of at least four bits for each shingle, in a power of two of 64-bit words."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(width, bool)
    bits[(mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) brought to fewer words: the halves are laid over each other."""
    while bits.shape[1] > words:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _of_sets(arrays: DataFrame, ids: DataFrame, what: str) -> DataFrame:
    """Per id: size and its bitmap (what: bits) or the sorted hashes (what: shingles)."""
    out = pa.schema([("id", pa.int64()), ("size", pa.int32()), (what, pa.binary())])

    def run(batches):
        for b in batches:
            for rest in zip(*(b.column(i).to_pylist() for i in range(3))):
                names, sets = _unpacked(*rest)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.array([len(s) for s in sets], np.int32)), pa.array([bitmap(s) if what == "bits" else s.tobytes() for s in sets], pa.binary())], schema=out)

    rows = arrays.select("ids", "sizes", "shingles").mapInArrow(run, f"id long, size int, {what} binary")
    return materialize(rows.join(sized(materialize(ids.distinct(), "ids")), "id", "left_semi"), f"set-{what}")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays share enough: 100 * intersection >= percent * union."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _bounded(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and bit counts let pass."""
    x = bits.select(F.col("id").alias("a"), F.col("size").alias("sx"), F.col("bits").alias("bx"))
    y = bits.select(F.col("id").alias("b"), F.col("size").alias("sy"), F.col("bits").alias("by"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in batches:
            ok = []
            for sx, bx, sy, by in zip(*(t.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(bx, np.uint64)[None, :], np.frombuffer(by, np.uint64)[None, :]
                ok.append(bool(_reach(np.array([sx]), x, np.array([sy]), y)[0, 0] * 100 >= percent))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], schema=out).filter(pa.array(ok, pa.bool_()))

    near = pairs.join(x, "a").join(y, "b").filter(F.least("sx", "sy") * 100 >= F.greatest("sx", "sy") * percent)
    return near.select("a", "b", "sx", "bx", "sy", "by").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, from the sorted arrays."""
    sets = _of_sets(arrays, pairs.select(F.explode(F.array("a", "b")).alias("id")), "shingles")
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in batches:
            release()
            ok = [similar(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent) for p, q in zip(t.column(2), t.column(3))]
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], schema=out).filter(pa.array(ok, pa.bool_()))

    with small_batches(pairs.sparkSession):
        found = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return found


def _reach(sx, bx, sy, by) -> np.ndarray:
    """Matrix: the largest similarity that the sizes and the bit counts of two bitmaps leave room for.

    Shared shingles set shared bits; a bit set in one bitmap only stands for at least one shingle of that set only."""
    words = min(bx.shape[1], by.shape[1])
    bx, by = fold(bx, words), fold(by, words)
    ones_x, ones_y = np.bitwise_count(bx).sum(axis=1, dtype=np.int64), np.bitwise_count(by).sum(axis=1, dtype=np.int64)
    both = np.zeros((len(sx), len(sy)), np.int64)
    for k in range(words):
        both += np.bitwise_count(bx[:, k, None] & by[None, :, k])
    most = np.minimum(sx[:, None] - (ones_x[:, None] - both), sy[None, :] - (ones_y[None, :] - both))
    # rounded up a little: a pair on the very bound stays
    return most / (sx[:, None] + sy[None, :] - most) + 1e-9


def _stacked(bits) -> np.ndarray:
    """Bitmaps of several widths as rows of the least width."""
    rows = [np.frombuffer(b, np.uint64)[None, :] for b in bits]
    words = min(r.shape[1] for r in rows)
    return np.concatenate([fold(r, words) for r in rows])


def _members(t: pd.DataFrame):
    return t["id"].to_numpy(np.int64), t["size"].to_numpy(np.int64), t["component"].to_numpy(np.int64), _stacked(t["bits"])


def spanning(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Places of the edges (a, b) of a spanning forest, earlier places of order first."""
    at = order
    nodes, ends = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
    ends = ends.reshape(2, -1)
    label, taken = np.arange(len(nodes)), []
    while True:
        x, y = label[ends[0]], label[ends[1]]
        live = x != y
        at, ends, x, y = at[live], ends[:, live], x[live], y[live]
        if not len(at):
            return np.concatenate(taken) if taken else at
        # the first edge of every tree; places are a strict order, so these edges close no ring
        best = np.unique(np.unique(np.stack([x, y], 1).ravel(), return_index=True)[1] // 2)
        taken.append(at[best])
        low, high = np.minimum(x[best], y[best]), np.maximum(x[best], y[best])
        merged = np.arange(len(nodes))
        while (merged[low] != merged[high]).any():
            least = np.minimum(merged[low], merged[high])
            np.minimum.at(merged, low, least)
            np.minimum.at(merged, high, least)
        label = merged[label]


def _passing(tile: int, x, y, same: bool, percent: int, forest: str) -> pd.DataFrame:
    """Pairs (a, b) of different components that sizes and bit counts let pass: all of them, or a spanning forest; then the
    tile is named too if pairs are left."""
    (ix, sx, cx, bx), (iy, sy, cy, by) = x, y
    reach = _reach(sx, bx, sy, by)
    ok = (100 * reach >= percent) & (cx[:, None] != cy[None, :])
    if same:
        ok &= ix[:, None] < iy[None, :]
    r, c = np.nonzero(ok)
    if forest and len(r):
        mixed = mix((ix[r] ^ iy[c]).view(np.uint64))
        order = np.lexsort((mixed, -reach[r, c])) if forest == "best" else np.argsort(mixed)
        keep = spanning(cx[r], cy[c], order)
        left = len(keep) < len(r)
        r, c = r[keep], c[keep]
    else:
        left = False
    found = pd.DataFrame({"a": np.minimum(ix[r], iy[c]), "b": np.maximum(ix[r], iy[c])}).astype("Int64").assign(tile=pd.array([pd.NA] * len(r), "Int64"))
    return pd.concat([found, pd.DataFrame({"a": [pd.NA], "b": [pd.NA], "tile": [tile]}, dtype="Int64")]) if left else found


def _block_pairs(members: DataFrame, percent: int, forest: str = "") -> DataFrame:
    """Of tiles' members (shingle, n, id, size, component, bits), block by block: the pairs (a, b) that pass and the tiles in which pairs are left.

    forest: "best" or "any" for a spanning forest of each block's components, "" for every pair."""
    none = pd.DataFrame({"a": [], "b": [], "tile": []}, dtype="Int64")
    # a tile of one block is one row of a bounded list
    small = members.filter(F.col("n") <= BLOCK).groupBy("shingle").agg(F.collect_list(F.struct("id", "size", "component", "bits")).alias("rows"))

    def each(frames):
        for pdf in frames:
            found = []
            for tile, rows in zip(pdf["shingle"], pdf["rows"]):
                t = _members(pd.DataFrame([r.asDict() if hasattr(r, "asDict") else r for r in rows]))
                found.append(_passing(tile, t, t, True, percent, forest))
            yield pd.concat(found) if found else none
            release()

    out = small.select("shingle", "rows").mapInPandas(each, "a long, b long, tile long")
    # larger ones: bands of sizes (only the same and the next can be within the ratio), cut into blocks of bounded size
    large = members.filter(F.col("n") > BLOCK).withColumn("band", F.floor(F.log("size") / F.lit(float(np.log(100 / percent)))).cast("int"))
    counts = large.groupBy("shingle", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    large = large.join(counts, ["shingle", "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    blocks = counts.select("shingle", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    other = blocks.select("shingle", F.col("band").alias("band2"), F.col("block").alias("block2"))
    meet = blocks.join(other, "shingle").filter("band2 = band + 1 or (band2 = band and block2 >= block)")
    meet = materialize(meet, "block-pairs")
    left = large.join(meet, ["shingle", "band", "block"]).withColumn("side", F.lit(0))
    right = large.select("shingle", F.col("band").alias("band2"), F.col("block").alias("block2"), "id", "size", "component", "bits")
    right = right.join(meet.filter("band <> band2 or block <> block2"), ["shingle", "band2", "block2"]).withColumn("side", F.lit(1))
    cols = ["shingle", "band", "block", "band2", "block2", "side", "id", "size", "component", "bits"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["band"].iloc[0] == pdf["band2"].iloc[0] and pdf["block"].iloc[0] == pdf["block2"].iloc[0]
        x = _members(pdf[pdf["side"] == 0])
        return _passing(pdf["shingle"].iloc[0], x, x if same else _members(pdf[pdf["side"] == 1]), bool(same), percent, forest)

    far = left.select(cols).unionByName(right.select(cols)).groupBy("shingle", "band", "block", "band2", "block2").applyInPandas(run, "a long, b long, tile long")
    return out.unionByName(far)


def link(docs: DataFrame, n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(per row: doc_id, size, id of its set; per set: id, first_doc, component_id), the latter for sets that a link names only."""
    info = describe(docs, n)
    rep = info.filter("size > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("first_doc"), F.first("size").alias("size"))
    total = info.agg(F.sum("size")).first()[0] or 0
    near = materialize(_sharing(docs, total, n, percent).distinct(), "sharing-sets")
    wanted = materialize(rep.join(near, "id"), "wanted-sets")
    discard(near)
    arrays = _arrays(docs, wanted, n)
    entries = materialize(_first_entries(arrays, wanted.agg(F.sum("size")).first()[0] or 0, percent), "first-shingles")
    mixed = F.xxhash64("id")
    spans = entries.groupBy("shingle").agg(F.min_by(F.struct("id", "size"), mixed).alias("low"), F.max_by("id", mixed).alias("high"))
    # a tile of one set needs no look
    tiles = materialize(entries.join(spans.filter("low.id <> high").select("shingle", F.col("low.id").alias("low"), F.col("low.size").alias("low_size")), "shingle"), "tiles")
    discard(entries)
    bits = _of_sets(arrays, tiles.select("id"), "bits")
    stars = tiles.select(F.col("low").alias("p"), "id").filter("p <> id")
    stars = materialize(stars.select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b")).distinct(), "stars")
    links = _verified(materialize(_bounded(stars, bits, percent), "candidate-pairs"), arrays, percent)
    found, tested, left = materialize(components(links), "star-components"), stars, None
    for forest in ("best", "any", ""):
        # tiles that are not all in one component; of two sets, the star has compared both
        members = tiles if left is None else tiles.join(left, "shingle", "left_semi")
        open_ = members.select("shingle", "id", "size").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        apart = open_.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("n")).filter("c0 <> c1 and n > 2").select("shingle", "n")
        open_ = materialize(open_.join(apart, "shingle"), "open-tiles")
        if open_.isEmpty():
            break
        passed = materialize(_block_pairs(open_.join(bits.select("id", "bits"), "id"), percent, forest), "block-passes")
        discard(open_)
        left = passed.filter("tile is not null").select(F.col("tile").alias("shingle")).distinct()
        pairs = materialize(passed.filter("a is not null").select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "candidate-pairs")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            links = links.unionByName(_verified(pairs, arrays, percent))
            found = materialize(components(links), "components")
    for done in (tiles, bits, stars, arrays):
        discard(done)
    named = wanted.join(found.withColumnRenamed("node", "id"), "id")
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return info, named.join(least, "component").select("id", "first_doc", "component_id")


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    info, named = link(docs, n, percent)
    own = info.filter("size > 0 and doc_id is not null").groupBy("id").agg(F.min("doc_id").alias("own"))
    named = own.join(named.select("id", "component_id"), "id", "left").select("id", F.coalesce("component_id", "own").alias("component_id"))
    out = info.join(named, "id", "left")
    linked = (F.col("size") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


#: Ids that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sized(ids: DataFrame) -> DataFrame:
    """Marks a table of ids for broadcast if it is known to be small."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def dedup(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that a document of a smaller doc_id stands for, all their columns.

    Of rows that repeat a doc_id in one component all or none stay."""
    name = unused(docs, "gone")
    gone = materialize(join(docs, n, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return docs.join(sized(gone), docs["doc_id"] == gone[name], "left_anti")
