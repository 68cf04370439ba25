"""CSV with line breaks in quoted fields, read by many tasks from one file.

A file is read as lines by Spark's own splits. Whether a split begins inside a quoted field is told by the number of quotes before
it, so that one pass counts each split's quotes, and their running sum over the splits of a file gives where each begins. A
second pass cuts every split into records. What a split begins inside of, and what it ends within, are pieces of records that
go on over splits: two for each split at most, which are joined by record.

Quotes in fields are doubled; a backslash is a character. Lines end with ``\\n`` or ``\\r\\n`` outside of quotes; blank lines are no
records. Bytes that are no UTF-8 become U+FFFD. A record with a field over the limit is left out. A record with fewer fields than its
file's header has nulls for the others, and with more they are left out. Of a file's splits 8 bytes each are sent to the tasks.
"""

from __future__ import annotations

import csv
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of a field, at most.
FIELD_LIMIT = 10 * 1024 * 1024


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), line (bytes), in order within a split."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _name(file: str, start: int) -> int:
    return xxhash.xxh64_intdigest(f"{start}:{file}") >> 1


def _splits(batches):
    """(file, start, lines) of each split in turn; lines as lists of bytes, in several parts where there are many."""
    for b in batches:
        file, start, line = b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("line").to_pylist()
        at = 0
        while at < len(line):
            end = at
            while end < len(line) and file[end] == file[at] and start[end] == start[at]:
                end += 1
            yield file[at], start[at], line[at:end]
            at = end


def _fields(record: str, limit: int) -> list[str] | None:
    csv.field_size_limit(sys.maxsize)
    row = next(csv.reader([record]), [])
    return None if any(len(x) > limit for x in row) else row


def _quotes(batches):
    """Of each split: its number of quotes, and the first record's beginning if it is a file's first split."""
    for file, start, lines in _splits(batches):
        head = None
        if start == 0:
            for k, line in enumerate(lines):
                head = line if k == 0 else head + b"\n" + line
                if head.count(b'"') % 2 == 0:
                    break
        yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "quotes": sum(x.count(b'"') for x in lines), "head": head}], _COUNTS)


_COUNTS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("quotes", pa.int64()), ("head", pa.binary())])


def read(spark: SparkSession, path: str, columns: list[str], limit: int = FIELD_LIMIT) -> DataFrame:
    """The named columns (whatever their case) of a CSV file or folder with headers, as strings; null where a file has no such column."""
    lines = _lines(spark, path)
    counted = lines.mapInArrow(_quotes, "file string, start long, quotes long, head binary")
    # an Arrow batch gives a row, so that a split may have several; only the first of a file has the header
    first = F.row_number().over(Window.partitionBy("file", "start").orderBy(F.col("head").isNull(), F.monotonically_increasing_id()))
    counted = counted.withColumn("nth", first)
    splits = counted.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.max(F.when(F.col("nth") == 1, F.col("head"))).alias("head"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).withColumn("head", F.max("head").over(Window.partitionBy("file")))
    known = splits.select("file", "start", "inside", "head").collect()  # a row for each split of some 128 MB
    heads = sorted({bytes(r["head"]) for r in known if r["head"] is not None})
    places = []
    for h in heads:
        names = [x.strip().lower() for x in (_fields(h.decode("utf-8", "replace").lstrip("﻿").rstrip("\r"), sys.maxsize) or [])]
        places.append([names.index(c.lower()) if c.lower() in names else None for c in columns])
    where = sorted((_name(r["file"], r["start"]), int(r["inside"]) + 2 * heads.index(bytes(r["head"]))) for r in known if r["head"] is not None)
    sent = spark.sparkContext.broadcast((np.array([w[0] for w in where], np.int64), np.array([w[1] for w in where], np.int32)))
    out = pa.schema([*((f"c{i}", pa.string()) for i in range(len(columns))), ("file", pa.string()), ("start", pa.int64()), ("piece", pa.int32()), ("text", pa.binary())])
    schema = ", ".join([*(f"c{i} string" for i in range(len(columns))), "file string, start long, piece int, text binary"])

    def values(record: bytes, place: list) -> list | None:
        row = _fields(record.decode("utf-8", "replace"), limit)
        return None if not row else [row[p] if p is not None and p < len(row) else None for p in place]

    def cut(batches):
        name, info = sent.value
        now, inside, held, rows = None, False, [], []
        whole, place, header = True, [], False

        def piece(kind: int):
            """What a split begins (0), holds only a part of (1) or ends within (2)."""
            rows.append([None] * len(columns) + [now[0], now[1], kind, b"\n".join(held)])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), out.types)], schema=out)
            rows.clear()
            return batch

        def end():
            if held:
                piece(2 if whole else 1)

        for file, start, lines in _splits(batches):
            if (file, start) != now:
                if now is not None:
                    end()
                i = int(np.searchsorted(name, _name(file, start)))
                inside, place = bool(info[i] % 2), places[info[i] // 2]
                now, held, whole, header = (file, start), [], not inside, start == 0
            for line in lines:
                held.append(line)
                if line.count(b'"') % 2:
                    inside = not inside
                if not inside:
                    if not whole:
                        piece(0)
                        whole = True
                    elif header:
                        header = False
                    else:
                        record = b"\n".join(held).rstrip(b"\r")
                        got = values(record, place) if record else None
                        if got is not None:
                            rows.append([*got, None, None, None, None])
                    held = []
            if len(rows) > 1000:
                yield flush()
        if now is not None:
            end()
        if rows:
            yield flush()

    cut_rows = lines.mapInArrow(cut, schema)
    pieces = cut_rows.filter("file is not null")
    # a record begins with the end of a split (2), goes on over whole splits (1) and ends at the beginning of one (0)
    record = F.sum(F.when(F.col("piece") == 2, 1).otherwise(0)).over(Window.partitionBy("file").orderBy("start", "piece"))
    numbered = pieces.select("file", "start", "piece", "text", record.alias("record"))

    def joined(table: pa.Table) -> pa.Table:
        t = table.sort_by([("start", "ascending"), ("piece", "ascending")]).to_pydict()
        first = sent.value[1][int(np.searchsorted(sent.value[0], _name(t["file"][0], 0)))]
        got = values(b"\n".join(t["text"]).rstrip(b"\r"), places[first // 2]) if t["record"][0] or t["start"][0] else None
        return pa.table({f"c{i}": pa.array([] if got is None else [got[i]], pa.string()) for i in range(len(columns))})

    over = numbered.groupBy("file", "record").applyInArrow(joined, ", ".join(f"c{i} string" for i in range(len(columns))))
    mine = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    return cut_rows.filter("file is null").select(*mine).unionByName(over.select(*mine))
