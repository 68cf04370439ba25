"""Spelling variants against brute force."""

import re
import zlib

import numpy as np
import pytest

from sentrylake.llm import spelling

LETTERS = "abcdeorst" + "éèñÿÀ"


def plain_words(rows):
    found = {}
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] = found.get(run, 0) + 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_force(rows):
    words = plain_words(rows)
    out, form = [], {}
    for w, n in words.items():
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
        out.append([w, n, len(near), form[w], words[form[w]] if form[w] else None])
    for r in out:
        root = r[0]
        while form[root]:
            root = form[root]
        r.append(root)
    return sorted(map(tuple, out))


def got(df):
    return sorted(tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    base = ["".join(rng.choice(list(LETTERS), rng.integers(5, 12))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "x" * 400, "x" * 401, "x" * 200 + "y" + "x" * 200]
    words = []
    for w in base:
        # chains of ever rarer variants, and ties
        n = int(rng.integers(3, 60))
        while n >= 2:
            words += [w] * n
            k = int(rng.integers(0, len(w)))
            w = [w[:k] + w[k + 1 :], w[:k] + str(rng.choice(list(LETTERS))) + w[k:], w[:k] + "z" + w[k + 1 :]][int(rng.integers(0, 3))]
            n //= int(rng.integers(1, 4)) if n > 6 else 2
    rng.shuffle(words)
    texts = ["; ".join(words[k : k + 37]) for k in range(0, len(words), 37)]
    texts = [t.upper() if i % 5 == 0 and t.isascii() else t for i, t in enumerate(texts)]
    return [*enumerate(texts), (None, texts[0]), (1, texts[1]), (7, None), (8, ""), (9, "a×b÷cdefg 12345 " * 4), (10, "abcde" * 4000)]


def test_against_brute_force(spark, rows):
    docs = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    want = by_force(rows)
    assert got(spelling.group(docs)) == want
    # the fixture has what it is for: chains, ties, words without a form
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] and not r[3] for r in want) and any(len(r[0]) == 401 and r[2] for r in want)


def test_runs_are_damaged_by_their_hash(spark):
    rows = [(d, "abcdefgh " * 3) for d in range(400)]
    want = by_force(rows)
    assert len(want) > 1 and got(spelling.group(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_empty(spark):
    assert got(spelling.group(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert got(spelling.group(spark.createDataFrame([(1, None), (2, "one two one")], "doc_id long, text string"))) == []


@pytest.mark.parametrize("n", [5, 6, 9, 13, 30])
def test_neighbourhoods_are_full_and_without_repeats(n):
    """Every edit of a word has its reduced key among the neighbours, each key once."""
    rng = np.random.default_rng(n)
    words = ["".join(rng.choice(list("abé"), n)) for _ in range(4)]
    who, key = spelling.neighbours(next(spelling._by_length(words))[1])
    for i, w in enumerate(words):
        own = key[who == i].tolist()
        assert len(own) == len(set(own))
        edits = {w[:k] + w[k + 1 :] for k in range(n)} | {w[:k] + c + w[k:] for k in range(n + 1) for c in "abzéÿ"} | {w[:k] + c + w[k + 1 :] for k in range(n) for c in "abzéÿ"}
        for _, letters in spelling._by_length(sorted(edits)):
            assert set(spelling.keys(letters).tolist()) <= set(own)


def test_a_full_bitmap_changes_nothing(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_force(rows)
    monkeypatch.setattr(spelling, "MOST_BITS", 1 << 15)
    assert got(spelling.group(docs)) == want


def test_candidates_are_not_broadcast(spark, rows):
    """Spark takes the candidates to be as small as the vocabulary that they are made from."""
    words = spelling.materialize(spelling.reduced(spelling.counts(spark.createDataFrame(rows, "doc_id long, text string"))), "reduced")
    plan = spelling.near(words, words.count())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_reduced_words_grow_with_the_vocabulary(spark, rows, monkeypatch):
    assert spelling.aim(1) == spelling.AIM and spelling.aim(1 << 22) == 32
    monkeypatch.setattr(spelling, "SPARE", 26)
    assert got(spelling.group(spark.createDataFrame(rows, "doc_id long, text string"))) == by_force(rows)
