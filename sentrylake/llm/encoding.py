"""Encoding whole texts with a tokenizer file of the ``tokenizers`` library, one cached word at a time.

Where the file's own rules drop white space and never join what stands on two sides of it, the ids of a text are the ids
of its white-space-separated words in turn, so that words seen before need no second encoding. For any other file whole
texts are encoded. Both ways give the library's ids.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import words

#: Words that a worker remembers before it sets them aside; those that come again are taken over, the others go the next time.
CACHE_WORDS = 200_000
#: Longer words are encoded each time and not remembered.
CACHE_WORD_BYTES = 64

_SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~|"

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None

_encoders: dict[str, "Encoder"] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "Encoder":
    """One encoder for each file and worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Frees the encoders of a worker that goes on with another operator."""
    _encoders.clear()
    release()


def release() -> None:
    """Gives memory that isn't used any more back to the system: workers wait for further tasks, and keep what they hold."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def splits_at_white_space(spec: dict) -> bool:
    """Whether the file drops white space between words: a normalizer that acts on characters only, then a split whose matches hold none."""
    norm = spec.get("normalizer") or {}
    kinds = [x["type"] for x in norm.get("normalizers", [norm] if norm else [])]
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    first = steps[0] if steps else {}
    pattern = (first.get("pattern") or {}).get("Regex", "")
    own = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    lower = "Lowercase" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"}
    plain = all(s["type"] == "ByteLevel" and not s.get("add_prefix_space") and not s.get("use_regex") for s in steps[1:])
    added = all(not t["lstrip"] and not t["rstrip"] and not t["normalized"] for t in spec.get("added_tokens", []))
    return own and lower and plain and added and first.get("behavior") == "Removed" and bool(first.get("invert"))


def byte_names() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = byte_names()


def plain_letters(word: str) -> bool:
    """Letters only, which neither the normal form nor lower-casing changes."""
    return word.isalpha() and (word.isascii() and word.islower() or word.lower() == word and unicodedata.is_normalized("NFC", word))


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.by_word = splits_at_white_space(json.load(f))
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[int, bytes] = {}
        self.aside: dict[int, bytes] = {}

    def _letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of lower-case letters in normal form, one match of the file's split each: the model alone is asked."""
        pack, tokenize = struct.pack, self.tokenizer.model.tokenize
        out = []
        for w in words:
            ids = tokenize(w.decode("latin-1").translate(_BYTE_NAMES))
            out.append(pack(f"<{len(ids)}I", *[t.id for t in ids]))
        return out

    def _words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of white-space-separated words. A word of letters and then ASCII signs is two matches of the file's split."""
        cut, odd, want = {}, [], set()
        for w in new:
            base = w.rstrip(_SIGNS)
            if base and plain_letters(base.decode()):
                tail = w[len(base) :]
                cut[w] = (base, tail)
                want.add(base)
            else:
                odd.append(w)
        tails = {t for _, t in cut.values() if t}
        out = dict(zip(odd, self._ids([w.decode() for w in odd])))
        out.update(zip(tails, self._ids([t.decode() for t in tails])))
        if want:
            want = list(want)
            out.update(zip(want, self._letters(want)))
        for w, (base, tail) in cut.items():
            out[w] = out[base] + out[tail] if tail else out[base]
        return out

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in out]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text, as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._ids([t.decode() for t in texts])
        gc.disable()  # nothing here makes cycles, and each pass over so many objects costs more than the work
        try:
            plain = [t for t in texts if b"<|" not in t]
            done = iter(self._encode_plain(plain))
            # A-Z are lower-cased for the rest, as the file does; not where that could make the name of a special token
            return [next(done) if b"<|" not in t else self._ids([t.decode()])[0] for t in texts]
        finally:
            gc.enable()

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        w = words(texts)
        if not len(w.hash):
            return [b""] * len(texts)
        # words are known by their hashes; a worker knows few of them, so that two share one is out of question
        known, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        found = list(map(self.cache.get, known.tolist()))
        lost = [i for i, x in enumerate(found) if x is None]
        if lost:
            if len(self.cache) + len(lost) > CACHE_WORDS:
                self.cache, self.aside = {}, self.cache
            again = list(map(self.aside.get, known[lost].tolist()))
            for i, x in zip(lost, again):
                if x is not None:
                    found[i] = self.cache[int(known[i])] = x
            lost = [i for i, x in zip(lost, again) if x is None]
        if lost:
            raw = w.raw.tobytes().lower()
            new = [raw[a:b] for a, b in zip(w.start[at[lost]].tolist(), w.end[at[lost]].tolist())]
            ids = self._words(new)
            for i, x in zip(lost, new):
                found[i] = ids[x]
                if len(x) <= CACHE_WORD_BYTES:
                    self.cache[int(known[i])] = found[i]
        table = np.frombuffer(b"".join(found), "<u4")
        size = np.array(list(map(len, found)), np.int64) // 4
        first = np.cumsum(size) - size
        per = size[back]
        total = np.zeros(len(per) + 1, np.int64)
        np.cumsum(per, out=total[1:])
        ids = table[np.arange(total[-1]) + np.repeat(first[back] - total[:-1], per)].tobytes()
        bounds = (total[w.bound] * 4).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def text_slices(batch_texts, max_bytes: int = 1 << 20):
    """Cut an Arrow string array into runs of rows of at most max_bytes of text (one row at least); nulls become empty.

    Yields (first row, list of UTF-8 bytes). Work on words takes some 50 bytes of memory for each of text."""
    sizes = pc.fill_null(pc.binary_length(batch_texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + max_bytes, side="right")))
        yield at, batch_texts.slice(at, end - at).cast(pa.large_binary()).fill_null(b"").to_pylist()
        at = end
    release()
