"""Perplexity of each mail by the words of all mails up to it.

A mail's word weighs as often as it stands in mails up to this one, in the order of steps and event ids. Mails are many and long, their
documents fewer: no row is made for a word of a mail. Words are known by 64-bit hashes and dealt to buckets. A bucket has every
document's words that are its own, once, and reads all mails in order as chunks of their document's id and subject; counts so far
of its words are its state. Sums of a chunk by bucket are added up in the end.

What is shuffled grows with the documents' words, and with buckets times mails at some bytes each. Buckets are as many as keep one's
words to some WORDS, so that their memory is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import translate
from ..session import batches_of, written

#: Mails of a chunk, words (of documents, each once) of a bucket, buckets at least, characters for each word of a document.
CHUNK, WORDS, LEAST_BUCKETS, CHARS = 10_000, 6_000_000, 24, 10
#: Mails whose documents' ids are sent to all tasks, to leave other documents out.
MOST_SENT = 500_000

_ROW = "bucket int, chunk long, docs binary, sizes binary, keys binary, counts binary"
_BATCH = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), *((n, pa.binary()) for n in ("docs", "sizes", "keys", "counts"))])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _hashes(text: str) -> str:
    return translate(f"transform(@words({text}@w), w -> xxhash64(w))", "spark")


def _counted(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """of, key and count of each pair, in order."""
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], key[at], np.diff(np.append(at, len(key)))


def _dealt(buckets: int):
    """Batches of doc_key and words (hashes) to a row for each bucket that has some."""

    def run(batches):
        for b in batches:
            words = b.column("words")
            of, key, count = _counted(words.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy())))
            if not len(key):
                continue
            ids, bucket = b.column("doc_key").to_numpy(zero_copy_only=False), (key.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for k in range(buckets):
                at = order[ends[k] : ends[k + 1]]
                if len(at):
                    docs, sizes = np.unique(of[at], return_counts=True)
                    rows.append((k, -1, ids[docs].astype(np.int64).tobytes(), sizes.astype(np.int32).tobytes(), key[at].tobytes(), count[at].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BATCH.types)], schema=_BATCH)

    return run


class _Bucket:
    """Words of one bucket by document and by subject, and their counts so far."""

    def __init__(self, parts: list, subjects: list):
        docs, sizes, keys, counts = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int32, np.int64, np.int32)))
        start = np.cumsum(sizes, dtype=np.int64) - sizes
        order = np.argsort(docs, kind="stable")
        self.docs, self.start, self.size = docs[order], start[order], sizes[order].astype(np.int64)
        own = np.concatenate([keys, *(k for k, _ in subjects)])
        words, ids = np.unique(own, return_inverse=True)
        self.ids, self.counts = ids.astype(np.int32), np.concatenate([counts, *(n.astype(np.int32) for _, n in subjects)])
        self.seen = np.zeros(len(words), np.int64)
        n = np.array([len(k) for k, _ in subjects], np.int64)
        self.subject_size, self.subject_start = n, len(keys) + np.cumsum(n) - n

    def read(self, mail: np.ndarray, doc: np.ndarray, subject: np.ndarray, copies: np.ndarray, mails: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each mail of a chunk: sum of count times count so far, and number of words."""
        low, high = np.searchsorted(self.docs, doc, "left"), np.searchsorted(self.docs, doc, "right")
        entry = _ranges(low, high - low)
        start, size = np.concatenate([self.start[entry], self.subject_start[subject]]), np.concatenate([self.size[entry], self.subject_size[subject]])
        who = np.concatenate([np.repeat(mail, high - low), mail])
        times = np.concatenate([np.ones(len(entry), np.int64), copies])
        at, of = _ranges(start, size), np.repeat(who, size)
        word, count = self.ids[at], self.counts[at] * np.repeat(times, size)
        order = np.argsort(word.astype(np.int64) * mails + of, kind="stable")
        word, of, count = word[order], of[order], count[order]
        if not len(word):
            return np.zeros(mails, np.int64), np.zeros(mails, np.int64)
        total = np.cumsum(count)
        first = np.ones(len(word), bool)
        first[1:] = word[1:] != word[:-1]
        begin = np.flatnonzero(first)
        # a mail's own words count, all of them
        last = np.append(first[1:] | (of[1:] != of[:-1]), True)
        end = np.flatnonzero(last)
        upto = total[end[np.searchsorted(end, np.arange(len(word)))]] - np.repeat(total[begin] - count[begin], np.diff(np.append(begin, len(word)))) + self.seen[word]
        self.seen[word[begin]] += np.add.reduceat(count, begin)
        sums, number = np.zeros(mails, np.int64), np.zeros(mails, np.int64)
        np.add.at(sums, of, count * upto)
        np.add.at(number, of, count)
        return sums, number


def _packed(batches):
    """Rows of mails (event_id, step, doc_key, variants, copies) in order to chunks. docs: ids of the texts' documents; sizes: their mail, subject and copies; keys, counts: events and steps."""
    part, number, held = TaskContext.get().partitionId(), 0, []

    def put(rows):
        flat = [(i, r[2], v, r[4]) for i, r in enumerate(rows) for v in r[3]]
        mail, doc, subject, copies = (np.array(x, np.int64) for x in zip(*flat))
        values = (part << 32 | number, doc.tobytes(), np.stack([mail, subject, copies]).astype(np.int32).tobytes(), np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, _BATCH.types[1:])], schema=pa.schema(list(_BATCH)[1:]))

    for b in batches:
        held += zip(*(b.column(i).to_pylist() for i in range(5)))
        while len(held) >= CHUNK:
            yield put(held[:CHUNK])
            held, number = held[CHUNK:], number + 1
    if held:
        yield put(held)


def _read(subjects: dict, buckets: int):
    """Sorted rows of buckets (documents, then chunks in order) to sums by chunk."""

    def run(batches):
        now, parts, state = None, [], None
        for b in batches:
            out = []
            for bucket, chunk, *raw in zip(*(b.column(n).to_pylist() for n in _BATCH.names)):
                if bucket != now:
                    now, parts, state = bucket, [], None
                if chunk < 0:
                    parts.append(raw)
                    continue
                if state is None:
                    mine = [subjects.get(v, (np.zeros(0, np.int64),) * 2) for v in range(8)]
                    keep = [k.view(np.uint64) % np.uint64(buckets) == bucket for k, _ in mine]
                    state, parts = _Bucket(parts, [(k[x], n[x]) for (k, n), x in zip(mine, keep)]), []
                mail, subject, copies = np.frombuffer(raw[1], np.int32).reshape(3, -1).astype(np.int64)
                sums, number = state.read(mail, np.frombuffer(raw[0], np.int64), subject, copies, len(raw[2]) // 8)
                out.append((chunk, sums.tobytes(), number.astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "sums", "number"])

    return run


def _added(chunks: pa.Table, parts: pa.Table) -> pa.Table:
    """event_id, step, weighted, n and the chunk's words up to the mail."""
    head = chunks.to_pylist()[0]
    event, step = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["counts"], np.int64)
    weighted, n = np.zeros(len(event), np.int64), np.zeros(len(event), np.int64)
    for sums, number in zip(parts.column("sums"), parts.column("number")):
        weighted += np.frombuffer(sums.as_buffer(), np.int64)
        n += np.frombuffer(number.as_buffer(), np.int32)
    return pa.table({"chunk": np.full(len(event), head["chunk"]), "event_id": event, "step": step, "weighted": weighted, "n": n, "upto": np.cumsum(n)})


def perplexities(sent: DataFrame, documents: DataFrame, subjects: DataFrame) -> DataFrame:
    """event_id, perplexity of mails (event_id, step, doc_key, variant) whose text is their subject (variant from 0 to 7, subject) and their document's text (doc_id, text).

    Mails without a step, a document's id or a subject have none. A document that is missing, or has no text, has no words; one that stands there more than once has all of them."""
    spark = sent.sparkSession
    mails = sent.filter("step is not null and doc_key is not null and variant between 0 and 7")
    of = {r[0]: _counted(np.array(r[1], np.int64), np.zeros(len(r[1]), np.int64))[1:] for r in subjects.selectExpr("variant", _hashes("subject")).collect()}  # eight rows
    n, chars = mails.count(), documents.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, math.ceil(chars / CHARS / WORDS))
    again = documents.groupBy(F.col("doc_id").alias("doc_key")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    by_mail = mails.groupBy("step", "event_id", "doc_key").agg(F.collect_list("variant").alias("variants")).join(again, "doc_key", "left")
    ordered = by_mail.select("event_id", "step", "doc_key", "variants", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    ordered = ordered.repartitionByRange(max(1, math.ceil(n / (20 * CHUNK))), "step", "event_id").sortWithinPartitions("step", "event_id")
    chunks = written(ordered.mapInArrow(_packed, _ROW.removeprefix("bucket int, ")), "mail-chunks")
    texts = documents.filter("text is not null").select(F.col("doc_id").alias("doc_key"), "text")
    if n <= MOST_SENT:
        texts = texts.join(F.broadcast(mails.select("doc_key").distinct()), "doc_key", "left_semi")
    words = texts.filter("doc_key is not null").select("doc_key", F.expr(_hashes("text")).alias("words")).mapInArrow(_dealt(buckets), _ROW)
    # every bucket reads the chunks, which have no words in them
    to_all = chunks.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "chunk", "docs", "sizes", F.expr("keys"), F.lit(None).cast("binary").alias("counts"))
    rows = words.unionByName(to_all).repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    with batches_of(spark, 500):
        parts = written(rows.mapInArrow(_read(of, buckets), "chunk long, sums binary, number binary"), "mail-sums")
    schema = "chunk long, event_id long, step long, weighted long, n long, upto long"
    got = chunks.select("chunk", "keys", "counts").groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(_added, schema)
    got = written(got, "mail-words")
    # a row for each CHUNK mails
    before = got.groupBy("chunk").agg(F.sum("n").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    weighted = F.sum("weighted").over(Window.partitionBy("event_id")).cast("double") / F.col("n").cast("double") / (F.col("before") + F.col("upto")).cast("double")
    return got.join(before.select("chunk", "before"), "chunk").select("event_id", F.least(F.lit(100.0), 1.0 / F.greatest(F.lit(0.001), weighted)).alias("perplexity"))
