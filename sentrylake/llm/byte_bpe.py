"""Byte-level BPE encoding and decoding (operator 8).

A text is split by a pattern; each match is merged on its own. A segment tree over the byte positions of a match stores
at every node the smallest key (pair rank, position), so its root is the leftmost pair of the lowest rank. A merge joins
two live neighbours and updates three leaves: the merged position, the one before it, and the one that goes; each update
walks one path to the root. Matches of up to 64 bytes are merged many at a time, one tree to a row of an array; longer
ones have a tree of their own. A match that is itself in the rank table is that one id.

A null text counts as empty: no ids. Repeated rows are encoded row by row; further columns are not read. Matches repeat
over a corpus, so a worker remembers their ids (a bounded number of them).
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import text_slices

#: Matches that a worker remembers before it starts again, and the longest that it remembers, in characters.
CACHE_MATCHES, CACHE_CHARS = 400_000, 64
#: Matches merged at a time.
BATCH = 20_000
_NONE = np.int64(2**62)

_codecs: dict[tuple[str, str], "ByteBPE"] = {}


def codec(path: str, pattern: str) -> "ByteBPE":
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = ByteBPE(path, pattern)
    return _codecs[key]


class ByteBPE:
    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merge_many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most width bytes (a power of two): a tree for each row."""
        n = len(words)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        cols = np.arange(width)
        ids = self.byte_id[raw]
        nxt = np.where(cols + 1 < size[:, None], cols + 1, -1)
        prv = np.broadcast_to(cols - 1, (n, width)).copy()
        live = cols < size[:, None]
        tree = np.full((n, 2 * width), _NONE, np.int64)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rank[nxt[:, :-1] < 0] = _NONE
        tree[:, width : 2 * width - 1] = np.where(rank < _NONE, rank * width + cols[:-1], _NONE)
        for node in range(width - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

        def update(rows, at, value):
            node = at + width
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def leaf(rows, at):
            right = nxt[rows, at]
            r = np.where(right >= 0, self._rank(ids[rows, at], ids[rows, np.maximum(right, 0)]), _NONE)
            return np.where(r < _NONE, r * width + at, _NONE)

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            at = tree[rows, 1] % width
            ids[rows, at] = tree[rows, 1] // width
            gone = nxt[rows, at]
            after = nxt[rows, gone]
            nxt[rows, at] = after
            has = after >= 0
            prv[rows[has], after[has]] = at[has]
            live[rows, gone] = False
            update(rows, gone, np.full(len(rows), _NONE))
            update(rows, at, leaf(rows, at))
            before = prv[rows, at]
            has = before >= 0
            if has.any():
                update(rows[has], before[has], leaf(rows[has], before[has]))
            rows = rows[tree[rows, 1] < _NONE]
        return [ids[i, live[i]] for i in range(n)]

    def merge_one(self, word: bytes) -> list[int]:
        """Ids of one word of any length."""
        n, get, none = len(word), self.pairs.get, 1 << 62
        width = 1 << max(0, (n - 1).bit_length())
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def key(i):
            r = get(ids[i] << 32 | ids[nxt[i]]) if nxt[i] >= 0 else None
            return none if r is None else r * width + i

        for i in range(n):
            tree[width + i] = key(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(i, value):
            node = i + width
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            gone = nxt[i]
            ids[i], nxt[i], ids[gone] = rank, nxt[gone], -1
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            update(gone, none)
            update(i, key(i))
            if prv[i] >= 0:
                update(prv[i], key(prv[i]))
        return [x for x in ids if x >= 0]

    def encode_matches(self, matches: list[str]) -> dict[str, bytes]:
        """Ids of each match, as little-endian unsigned 32-bit integers."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {8: [], 16: [], 32: [], 64: []}
        for m in matches:
            b = m.encode("utf-8", "replace")
            if b in self.ranks:
                out[m] = self.ranks[b].to_bytes(4, "little")
            elif len(b) <= 64:
                by_width[8 if len(b) <= 8 else 16 if len(b) <= 16 else 32 if len(b) <= 32 else 64].append((m, b))
            else:
                out[m] = np.array(self.merge_one(b), "<u4").tobytes()
        for width, words in by_width.items():
            for i in range(0, len(words), BATCH):
                part = words[i : i + BATCH]
                for (m, _), ids in zip(part, self.merge_many([b for _, b in part], width)):
                    out[m] = ids.astype("<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        found = [self.find(t) for t in texts]
        new = set().union(*found).difference(self.cache)
        if new and len(self.cache) + len(new) > CACHE_MATCHES:
            self.cache.clear()
            new = set().union(*found)
        ids = self.encode_matches(list(new))
        self.cache.update((m, x) for m, x in ids.items() if len(m) <= CACHE_CHARS)
        long = {m: x for m, x in ids.items() if len(m) > CACHE_CHARS}
        if long:
            return [b"".join([self.cache.get(m) or long[m] for m in ms]) for ms in found]
        get = self.cache.__getitem__
        return [b"".join(map(get, ms)) for ms in found]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id and ids (binary, little-endian unsigned 32-bit integers)."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids = bpe.encode([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id and bytes."""

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or b"") for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, from ids encoded and then decoded in one pass."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for at, texts in text_slices(batch.column(1)):
                ids = bpe.encode([t.decode() for t in texts])
                cols = [[len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), *(pa.array(c, t) for c, t in zip(cols, out.types[1:]))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
