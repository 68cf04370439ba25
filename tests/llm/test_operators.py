"""Small tables with nulls, empty and repeated texts, and clashing columns, against brute force."""

import base64
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrylake.llm import ann, byte_bpe, exact_dedup, licenses, ngram_join, packing, passages, suffix_dedup, token_store, toxicity
from sentrylake.llm.common import new_path

P = pytest.importorskip("public_tokenizers")
RNG = np.random.default_rng(1)


def prose(n):
    return " ".join("".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(n))


LONG = prose(300)
EDITED = LONG.split()
EDITED[40] = "changed"
PASSAGE = prose(60)
ROWS = [(1, LONG), (2, LONG.upper()), (3, " ".join(EDITED)), (4, None), (5, ""), (6, prose(80) + " " + PASSAGE), (7, PASSAGE + " " + prose(90)), (8, "two words"), (9, "Two words"), (10, "x" * 3000), (11, prose(120)), (11, prose(50))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "own", 0) for i, t in ROWS], "doc_id long, text string, digest string, id int")


def empty(docs):
    return docs.filter("1 = 0")


def test_exact_dedup(docs):
    got = {(r.doc_id, r.text_sha256): r for r in exact_dedup.report(docs).collect()}
    assert len(got) == 12
    assert {r.doc_id for r in got.values() if not r.kept} == {1, 4, 8}
    assert exact_dedup.dedup(docs).columns == docs.columns
    assert exact_dedup.dedup(docs).count() == 9
    assert exact_dedup.report(empty(docs)).count() == 0


def test_index_goes_on(spark, docs):
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    assert index.append(docs.filter("doc_id >= 5")).filter("kept").count() == 7
    later = {r.doc_id: (r.kept, r.keep_id) for r in index.append(docs.filter("doc_id < 5")).collect()}
    assert later[4] == (False, 5) and later[2] == (True, 2) and later[1] == (False, 2)
    # a named batch may be repeated: the same rows stay
    own = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    once = own.append(docs, "first").filter("kept").count()
    assert once == 9 and own.append(docs, "first").filter("kept").count() == once and own.append(docs, "second").filter("kept").count() == 0


def test_ngram_join(docs):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.join(docs).collect()}
    assert got[(1, 296)] == got[(2, 296)] == got[(3, 296)] == 1
    assert got[(8, 1)] == got[(9, 1)] == 8 and got[(4, 0)] == 4 and got[(5, 0)] == 5
    assert {r.doc_id for r in ngram_join.dedup(docs).collect()} == {1, 4, 5, 6, 7, 8, 10, 11}
    assert ngram_join.join(empty(docs)).count() == 0


def test_passages(docs):
    got = passages.repeats(docs.filter("doc_id > 3")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(7, 6)}
    assert got[0].n_words == 60
    cut = {r.doc_id: r.text for r in passages.cut(docs.filter("doc_id > 3 and doc_id < 11")).collect()}
    assert PASSAGE not in cut[7] and PASSAGE in cut[6] and cut[4] is None
    assert passages.repeats(empty(docs)).count() == 0


def test_suffix_dedup(docs):
    got = {}
    texts = [(i, (t or "").encode()) for i, t in ROWS]
    n = 400
    seen = {}
    for _, t in texts:
        for k in range(len(t) - n + 1):
            seen[t[k : k + n]] = seen.get(t[k : k + n], 0) + 1
    want = sorted((i, len(t), len({b for k in range(len(t) - n + 1) if seen[t[k : k + n]] > 1 for b in range(k, k + n)})) for i, t in texts)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.report(docs).collect())
    assert got == want
    assert suffix_dedup.report(empty(docs)).count() == 0


def test_loser_tree():
    runs = [sorted(bytes(RNG.choice([97, 98], 6)) for _ in range(n)) for n in (7, 1, 0, 12)]
    coded = [[(suffix_dedup.common(a, b, 0), b, None) for a, b in zip([b"", *r], r)] for r in runs]
    out = [(n, s) for n, s, _ in suffix_dedup.LoserTree(coded)]
    flat = sorted(x for r in runs for x in r)
    assert [s for _, s in out] == flat
    assert [n for n, _ in out[1:]] == [suffix_dedup.common(a, b, 0) for a, b in zip(flat, flat[1:])]


def test_token_store(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    folder = new_path(spark, "store")
    part = docs.filter("doc_id < 11")
    token_store.write(part, folder)
    got = {r.doc_id: r for r in token_store.read_digests(spark, folder).collect()}
    ids = {r.doc_id: r.ids for r in token_store.decode(spark, folder).collect()}
    start = 0
    for i, t in ROWS[:10]:
        want = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(want.tobytes()))
        assert ids[i] == want.tolist()
        start += len(want)
    assert token_store.verify(spark, folder)
    recipes = spark.read.parquet(f"{folder}/recipes")
    other = new_path(spark, "store")
    recipes.withColumn("n_tokens", F.col("n_tokens") + F.when(F.col("doc_id") == 3, 1).otherwise(0)).write.parquet(f"{other}/recipes")
    for part in ("data/kind=0", "manifest"):
        spark.read.parquet(f"{folder}/{part}").write.parquet(f"{other}/{part}")
    with pytest.raises(ValueError):
        token_store.read_digests(spark, other)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in at.values():
        v.sort()
        assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
    assert packing.pack(empty(docs)).count() == 0


def test_best_plan_is_near_the_least():
    lengths = RNG.integers(1, 2049, 3000)
    x, n = np.unique(lengths, return_counts=True)
    found = packing.best_plan(x, n, 2048)
    assert sorted(l for ls, k in found for l in ls for _ in range(k)) == sorted(lengths.tolist())
    assert sum(k for _, k in found) <= 1.03 * lengths.sum() / 2048


def test_byte_bpe(docs):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode(docs.filter("doc_id < 11"), path, P.PATTERN).collect():
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == own.encode_ordinary(dict(ROWS)[r.doc_id] or "")


def test_ann(spark):
    v = RNG.normal(size=(200, 8))
    v[7] = v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in ann.search(t, t.filter("vec_id % 20 = 0"), 5).collect()}
    for q in range(0, 200, 20):
        want = sorted((-float((v[q] * v[i]).sum()), i) for i in range(200) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [i for _, i in want]


def test_toxicity(spark):
    rows = [(i, prose(60) + (" nastyword " + prose(20) + " nastyword" if i % 3 == 0 else "")) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).filter("doc_id < 300")
    model = toxicity.fit(docs, labels)
    for r in toxicity.tag(docs, model).collect():
        assert (r.score >= 0.5) == (r.doc_id < 300 and r.doc_id % 3 == 0)
    assert toxicity.keep_clean(docs, model).count() == 202
    assert toxicity.fit(docs, labels.filter("1 = 0")).keys.size == 0


def test_licenses(spark):
    rows = [(1, prose(30) + "\nReleased under the MIT License.\n" + prose(9)), (2, "Licensed under CC BY-NC 4.0."), (3, prose(40)), (4, None), (5, "the public gave him a copy of it")]
    got = {r.doc_id: r.family for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "MIT" and got[2] == "CC-BY-NC" and got[3] == got[4] == got[5] == "none"


def test_passages_of_later_holders(spark):
    """Earlier texts hold its phrases one by one, none of them the passage that two later texts share."""
    rng = np.random.default_rng(17)
    words = lambda n: ["".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(n)]
    w = words(60)
    rows = [(100 * k + i, " ".join(words(60) + w[i : i + 5] + words(60))) for i in range(56) for k in range(8)]
    rows += [(1000, " ".join(words(80) + w + words(80))), (1001, " ".join(words(70) + w + words(90)))]
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.n_words) for r in got} == {(1001, 1000, 60)}


def test_a_phrase_of_the_passage_elsewhere():
    """A verbatim passage is found whole though one of its phrases also stands earlier in the earlier text."""
    rng = np.random.default_rng(23)
    words = lambda n: ["".join(rng.choice(list("klmnopqrst"), 6)) for _ in range(n)]
    w = words(60)
    for j in (0, 10, 25, 40, 50):
        for ahead in (5, 20, 30, 35, 70):
            gap = words(ahead)
            a = " ".join(words(30) + w[j : j + 5] + gap + w + words(30))
            b = " ".join(words(20) + w + words(20))
            n = len(a.split()) - 5
            assert [(m[0], m[1]) for m in passages.matches(a.encode(), b.encode(), [(0, n, 0, 95)], False)] == [(20, 60)], (j, ahead)


def test_wrapped_and_several_licenses(spark):
    head = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation"
    rows = [(1, head), (2, "Released under the MIT License.\n\n" + prose(9) + "\n\n" + head), (3, head.replace("# it", "\n# it"))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].family == "GPL" and [tuple(n) for n in got[1].notices] == [("GPL", 0, 1)]
    assert [tuple(n) for n in got[2].notices] == [("MIT", 0, 0), ("GPL", 4, 5)]
    assert got[3].notices == []


def test_license_threshold_is_over_all_lines(spark):
    """One line in a hundred scores high, far beyond any sample of lines by hash: repeated lines count as often as they stand."""
    model = licenses.fit(spark.createDataFrame([(1, "plain text")], "doc_id long, text string"))
    score = lambda p: 1 - model.probabilities(p)[-1]
    high, low = sorted((b"to any person obtaining a copy", b"under the old bridge"), key=score, reverse=True)
    docs = spark.createDataFrame([(i, (high if i % 100 == 0 else low).decode()) for i in range(6000)], "doc_id long, text string")
    assert 0 <= licenses.threshold(docs, model) - score(high) <= 1 / licenses.BINS
    rare = docs.withColumn("text", F.when(F.col("doc_id") == 0, high.decode()).otherwise(low.decode()))
    assert 0 <= licenses.threshold(rare, model) - score(low) <= 1 / licenses.BINS
    assert licenses.threshold(docs.filter("1 = 0"), model) == 0


def test_license_families_of_made_paragraphs(spark):
    """Paragraphs made from the templates with other words dropped than in training."""
    model = licenses.fit(spark.createDataFrame([(1, "plain text")], "doc_id long, text string"))
    rows, labels = licenses.examples(77, [], 20)
    right = [int(np.argmax(model.of(r)[:-1])) == y and model.of(r)[-1] < 0.5 for r, y in zip(rows, labels) if r]
    assert np.mean(right) >= 0.95


def test_queries_of_another_dimension_take_no_part(spark):
    """The table's most common dimension counts, also where the queries have another one for the most part."""
    schema = "vec_id long, embedding array<double>"
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)] + [(20, [1.0]), (21, [2.0])], schema)
    asked = spark.createDataFrame([(20, [1.0]), (21, [2.0]), (3, [3.0, 1.0]), (None, [1.0, 1.0])], schema)
    got = ann.search(table, asked, 2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(3, 1, 8, 25.0), (3, 2, 7, 22.0)]


def test_passages_among_many_holders(spark):
    """The one earlier text with the whole passage is neither the first nor the last of many that hold a part of it."""
    rng = np.random.default_rng(31)
    v = ["w%d" % k for k in range(30_000)]
    text = lambda n: list(rng.choice(v, n))
    rows, want = [], set()
    for g in range(12):
        p = text(62)
        for k in range(21):
            part = p if k == 10 else p[:40] if k % 2 else p[22:]
            rows.append((100 * g + k, " ".join([*text(30), *part, *text(30)])))
        rows.append((100 * g + 50, " ".join([*text(20), *p, *text(20)])))
        want.add((100 * g + 50, 100 * g + 10))
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == want and all(r.n_words >= 62 for r in got)


def test_live_ranges_by_brute_force():
    """Ranges in which four of five distinct tokens are shared, of a length or with a token that repeats; never over two texts."""
    rng = np.random.default_rng(32)
    for _ in range(60):
        sizes = rng.integers(0, 30, 4)
        bound = np.append(0, np.cumsum(sizes))
        h = rng.integers(0, 60, bound[-1]).astype(np.uint64)
        shared, again = rng.random(60)[h.astype(int)] < 0.75, rng.random(60)[h.astype(int)] < 0.02
        got = passages.live(h, bound, shared, again, 8)
        for a, b in zip(bound[:-1], bound[1:]):
            for i in range(a, b):
                for j in range(i + 1, b + 1):
                    good, all_ = len(np.unique(h[i:j][shared[i:j]])), len(np.unique(h[i:j]))
                    if 5 * good >= 4 * all_ and (j - i >= 8 or (shared & again)[i:j].any()):
                        assert got[i:j].all()
        assert not got.all() or shared.mean() > 0.5
