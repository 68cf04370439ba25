"""Spelling variants: frequent words one edit apart, by one-edit neighbourhoods of reduced words.

Words are counted over whole texts. Letters are hashed to a few symbols, fewer for longer words and more for a large vocabulary, and
every reduced word is known by 64 bits. A word's full neighbourhood (itself, each replacement, insertion and deletion over the symbols) is generated for
the reduced words of each length that one edit can reach, and joined with the reduced vocabulary; two words one edit apart
always meet there, and what meets is checked on the original strings. No two words are compared because they share a group:
a candidate is a neighbour that exists.

Before the join, neighbours that no reduced word can equal are dropped by a bitmap of the reduced vocabulary. It has 16 bits
a word and MOST_BITS at most (128 MB), so that its broadcast is bounded; where a vocabulary outgrows it, it drops less and the
join does more, with the same result.

Null texts have no words; a null doc_id counts as empty text in the hash that damages runs. Repeated rows count as often as
they stand there. An empty table gives no words. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialize
from .words import mix

#: Letters that runs are made of, beside a-z.
LATIN = "À-ÿ"
#: Words have so many code points and occurrences at least; a form is so many times as frequent as its variant.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One run in so many (by its hash) loses a code point.
DAMAGED = 97
#: Bits of a reduced word that its alphabet aims at, at least, and those beyond the logarithm of the vocabulary.
AIM, SPARE = 24, 10
MOST_BITS = 1 << 30

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_LENGTH = 0xD6E8FEB86659FD93


def counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: what the runs of all texts come to after the damage, if of LEAST_LENGTH code points or more and found ``least`` times."""
    run = F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"([a-z{LATIN}]{{{LEAST_LENGTH},}})"), 1))
    runs = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), run.alias("run"))
    h = F.crc32(F.concat("head", "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % DAMAGED != 0, F.col("run")).otherwise(F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run"))))
    words = hashed.select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def aim(words: int) -> int:
    """Bits of a reduced word, for so many words: SPARE more than their number takes, so that a neighbour seldom equals another word's by chance."""
    return max(AIM, math.ceil(math.log2(max(1, words))) + SPARE)


def symbols(length: int, bits: int = AIM) -> int:
    """Size of the reduced alphabet for words of a length: a power of two with some bits a word, 2 at least and 32 at most."""
    return 1 << min(5, max(1, round(bits / length)))


#: Five bits of every letter's hash; a smaller alphabet takes the lower ones.
_HASH = np.array([zlib.crc32(bytes([7, i])) >> 9 & 31 for i in range(256)], np.uint8)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _final(value: np.ndarray, length: int) -> np.ndarray:
    """The key of a reduced word of a length from the sum over its symbols."""
    return mix(value + np.uint64(_LENGTH * length % (1 << 64)))


def _reduced(letters: np.ndarray, length: int, bits: int) -> np.ndarray:
    """Symbols (from 1 on) that words (a row of code points each) have in the alphabet of a length."""
    return (_HASH[letters] & np.uint8(symbols(length, bits) - 1)).astype(np.uint64) + np.uint64(1)


def keys(letters: np.ndarray, bits: int = AIM) -> np.ndarray:
    """Keys of words of one length."""
    n = letters.shape[1]
    return _final((_reduced(letters, n, bits) * _powers(n)).sum(axis=1, dtype=np.uint64), n)


def neighbours(letters: np.ndarray, bits: int = AIM) -> tuple[np.ndarray, np.ndarray]:
    """Of words of one length: (row, key) of every reduced word that one edit at most makes of theirs, each once."""
    rows, n = letters.shape
    every = np.arange(rows)
    p = _powers(n + 1)
    who, out = [every], [keys(letters, bits)]
    # replacements
    s, k = _reduced(letters, n, bits), symbols(n, bits)
    value = (s * p[:n]).sum(axis=1, dtype=np.uint64)
    for step in range(1, k):
        other = (s - np.uint64(1) + np.uint64(step)) % np.uint64(k) + np.uint64(1)
        out.append(_final(value[:, None] + (other - s) * p[:n], n).ravel())
        who.append(np.repeat(every, n))
    # insertions before each place and at the end; after an equal symbol they make the same word as before it
    s, k = _reduced(letters, n + 1, bits), symbols(n + 1, bits)
    sums = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(s * p[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
    moved = sums + (sums[:, -1:] - sums) * np.uint64(_P)
    for c in range(1, k + 1):
        key = _final(moved + np.uint64(c) * p, n + 1)
        new = np.ones((rows, n + 1), bool)
        new[:, 1:] = s != c
        out.append(key[new])
        who.append(np.broadcast_to(every[:, None], new.shape)[new])
    # deletions; of equal neighbours the first
    if n > 1:
        s = _reduced(letters, n - 1, bits)
        np.cumsum(s * p[:n], axis=1, dtype=np.uint64, out=sums[:, 1:])
        key = _final(sums[:, :-1] + (sums[:, -1:] - sums[:, 1:]) * np.uint64(_P_INVERSE), n - 1)
        new = np.ones((rows, n), bool)
        new[:, 1:] = s[:, 1:] != s[:, :-1]
        out.append(key[new])
        who.append(np.broadcast_to(every[:, None], new.shape)[new])
    return np.concatenate(who), np.concatenate(out)


#: Code points that are worked on at once; a neighbourhood has up to some 60 keys for each.
_SLICE = 1 << 14


def _by_length(words: list[str]):
    """(rows, their code points) of words of one length and of bounded size together. Letters are below U+0100."""
    size = np.array([len(w) for w in words], np.int64)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, _SLICE // int(n))
        for k in range(0, len(at), step):
            rows = at[k : k + step]
            raw = "".join(words[i] for i in rows).encode("latin-1")
            yield rows, np.frombuffer(raw, np.uint8).reshape(len(rows), n)


def reduced(words: DataFrame, bits: int = AIM) -> DataFrame:
    """word and n with the key of the reduced word."""

    def run(batches):
        for b in batches:
            text = b.column("word").to_pylist()
            out = np.zeros(len(text), np.uint64)
            for rows, letters in _by_length(text):
                out[rows] = keys(letters, bits)
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(out.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def bitmap(vocabulary: DataFrame, words: int):
    """Which keys exist, by their lowest bits: pieces of 4 KB with their number, one by one, and the number of bits, MOST_BITS at most."""
    bits = min(MOST_BITS, max(1 << 20, 1 << (16 * max(1, words) - 1).bit_length()))
    # the functions number places from 1 on
    place = F.col("key").bitwiseAND(bits - 1) + 1
    pieces = vocabulary.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    return ((r["piece"], bytes(r["bits"])) for r in pieces.toLocalIterator()), bits


def candidates(vocabulary: DataFrame, words: int) -> DataFrame:
    """word, n and the key of a neighbour of its reduced word, if the bitmap of all keys has it."""
    sc = vocabulary.sparkSession.sparkContext
    pieces, size = bitmap(vocabulary, words)
    whole, bits = np.zeros(size // 8, np.uint8), aim(words)
    for piece, raw in pieces:
        whole[(piece - 1) * 4096 : (piece - 1) * 4096 + len(raw)] = np.frombuffer(raw, np.uint8)[: len(whole) - (piece - 1) * 4096]
    sent = sc.broadcast(whole)
    del whole

    def run(batches):
        known = sent.value
        for b in batches:
            text, n = b.column("word").to_pylist(), b.column("n")
            for rows, letters in _by_length(text):
                who, key = neighbours(letters, bits)
                at = key & np.uint64(size - 1)
                there = known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
                take = pa.array(rows[who[there]])
                if len(take):
                    yield pa.RecordBatch.from_arrays([b.column("word").take(take), n.take(take), pa.array(key[there].view(np.int64))], ["word", "n", "key"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, key long")


def near(vocabulary: DataFrame, words: int) -> DataFrame:
    """word, n, other, other_n of words that one inserted, deleted or replaced code point makes of each other; both orders."""
    other = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "key")
    # Spark takes candidates, some tens for each word, to be as small as the vocabulary, and would send them to all tasks
    met = candidates(vocabulary, words).hint("merge").join(other, "key").filter("word <> other")
    return met.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def roots(forms: DataFrame) -> DataFrame:
    """word and root of words that have a form: forms are followed to the last by doubling, each round written.

    A form is at least TIMES as frequent as its word, so chains end, and rounds number the logarithm of the longest one."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = materialize(at.join(on.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(at)
        moved = not new.filter("moved").isEmpty()
        at, before = new.select("word", "root"), new
        at._sentrylake_path = before._sentrylake_path
        if not moved:
            return at


def group(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the texts."""
    found = materialize(counts(docs), "words")
    size = found.count()
    vocabulary = materialize(reduced(found, aim(size)), "reduced")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    of = near(vocabulary, size).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    frequent = -F.col("best.less") >= TIMES * F.col("n")
    # words without a near one need no join: they come from the vocabulary by the same key
    pairs = materialize(of.select("word", "n_near", F.when(frequent, F.col("best.other")).alias("form"), F.when(frequent, -F.col("best.less")).alias("form_n")), "near")
    ends = roots(pairs.filter("form is not null"))
    out = found.join(pairs.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def _crc32(text: str) -> str:
    """DuckDB SQL of the CRC-32 of a text of ASCII and U+0080 to U+00FF; ``crc.t`` is the table."""
    byte = "list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split({t}, ''), lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [(192 + ord(c) // 64)::bigint, (128 + ord(c) % 64)::bigint] end))), lambda a, x: xor(a >> 8, crc.t[(xor(a, x) & 255) + 1]))"
    return f"xor({byte.format(t=text)}, 4294967295)"


#: The table of CRC-32 by its rule.
CRC_SQL = "crc as (select list(v order by n) as t from (select n, list_reduce(list_prepend(n, range(8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from (select unnest(range(256)) as n) x) y)"
# letters one by one for ASCII signs, since levenshtein() counts bytes
_SIGNS, _LETTERS = "".join(chr(c) for c in range(33, 97)).replace("'", "''"), "".join(chr(c) for c in range(0xC0, 0x100))
SQL = f"""
with recursive {CRC_SQL},
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z{LATIN}]+')) as run from documents),
hashed as (select run, {_crc32("coalesce(doc_id::varchar, '') || ':' || run")} as h from runs, crc where length(run) >= {LEAST_LENGTH}),
words as (select case when h % {DAMAGED} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word from hashed),
vocabulary as (select word, count(*) as n, length(word) as size, translate(word, '{_LETTERS}', '{_SIGNS}') as plain from words where length(word) >= {LEAST_LENGTH} group by word having count(*) >= {LEAST_COUNT}),
cut as (select word, n, size, plain, unnest(list_distinct(list_append(list_transform(range(1, size + 1), lambda i: left(plain, i - 1) || substr(plain, i + 1)), plain))) as piece from vocabulary),
near as (select distinct a.word, a.n, b.word as other, b.n as other_n from cut a join cut b on a.piece = b.piece and a.word <> b.word and levenshtein(a.plain, b.plain) = 1),
best as (select word, count(*) as n_near, case when max(other_n) >= {TIMES} * any_value(n) then arg_min(other, (-other_n, other)) end as form, case when max(other_n) >= {TIMES} * any_value(n) then max(other_n) end as form_n from near group by word),
chain(word, root) as (select word, form from best where form is not null union all select c.word, b.form from chain c join best b on b.word = c.root where b.form is not null),
ends as (select word, root from chain c where not exists (select 1 from best b where b.word = c.root and b.form is not null))
select v.word, v.n, coalesce(b.n_near, 0) as n_near, b.form, b.form_n, coalesce(e.root, v.word) as root from vocabulary v left join best b on b.word = v.word left join ends e on e.word = v.word"""
