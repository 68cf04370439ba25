"""Language ID: accuracy on rows that are held out, vectors and decoding against plain loops, cases of the docstring."""

import math
import zlib

import numpy as np
import pytest

from sentrylake.llm import languages

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, languages.fit(docs)


def test_held_out_accuracy(real):
    docs, model = real
    rows = languages.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_short_texts(spark, real):
    """Pieces of six words of held-out documents."""
    docs, model = real
    some = [r for r in docs.filter(languages.held_out("doc_id") & docs.lang.isNotNull() & docs.text.isNotNull()).collect() if len(r.text.split()) > 30]
    pieces = spark.createDataFrame([(i, " ".join(r.text.split()[10:16]), r.lang) for i, r in enumerate(some)], "doc_id long, text string, want string")
    got = languages.predict(pieces, model).join(pieces, "doc_id").collect()
    assert sum(r.want == r.lang_pred for r in got) >= 0.95 * len(got)


def plain_vector(text):
    """The same features character by character."""
    low = text.translate({c: c + 32 for c in [*range(65, 91), *[c for c in range(0xC0, 0xDF) if c != 0xD7]]})
    low = "".join(c if not c.isascii() or c.isalpha() else " " for c in low)
    raw = (" " + " ".join(low.split(" ")).strip() + " ").encode()
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    raw = bytes(0 if b == 32 else b for b in raw)
    out, m = np.zeros(languages.SIZE), [int(x) for x in languages._MULTIPLIERS]
    for n in languages.GRAMS:
        for i in range(len(raw) - n + 1):
            h = sum((raw[i + k] + 1) * m[k] for k in range(n)) % 2**32
            h = ((h ^ (h >> 15)) * m[1] + n) % 2**32
            out[h >> (32 - languages.SIZE.bit_length() + 1)] += 1
    return out / max(1, out.sum())


def test_vectors():
    texts = ["Hello, World!", "", "12 34", "a", "ÉCOLE École ÷×", "  x  y ", "日本語 ok", "naïve-café's\nnew"]
    got = languages.vectors([t.encode() for t in texts])
    for g, t in zip(got, texts):
        assert np.allclose(g, plain_vector(t), atol=1e-6), t


def test_decoding(real):
    """Losses against the definition, in plain loops."""
    m = real[1]
    x = languages.vectors([b"the onting of thonand", "le éaux de la".encode()])
    got = languages.losses(m, x)
    for r, row in enumerate(x):
        z = [float(row @ m.weights[:, j] + m.bias[j]) for j in range(m.code.shape[1])]
        for i in range(len(m.languages)):
            assert got[r, i] == pytest.approx(sum(m.share[i, j] * math.log1p(math.exp(-m.code[i, j] * z[j])) for j in range(len(z))), rel=1e-4)
    assert np.allclose(m.share.sum(axis=1), 1)


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20])
def test_codewords_are_apart(n):
    code = languages.code_matrix(n)
    apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
    assert apart >= (2 ** (n - 2) if n <= languages.EXHAUSTIVE else code.shape[1] // 4)
    assert all(abs(c.sum()) < n for c in code.T)


def test_wrong_bits_are_corrected():
    """A codeword of 7 bits with 4 between any two still decodes with one bit wrong."""
    code = languages.code_matrix(4)
    m = languages.Model(list("abcd"), code, np.zeros((languages.SIZE, 7), np.float32), np.zeros(7, np.float32), np.full((4, 7), 1 / 7), 1.0)
    for i in range(4):
        for wrong in range(7):
            z = code[i].astype(float).copy()
            z[wrong] *= -1
            assert languages.losses(m._replace(bias=z), np.zeros((1, languages.SIZE), np.float32)).argmin() == i


def test_cases(spark):
    de, en = "und der die das nicht ein ", "the and with that from this "
    rows = [(i, (de if i % 2 else en) * (1 + i % 3), "de" if i % 2 else "en") for i in range(60)]
    rows += [(None, en, "en"), (100, None, "de"), (101, "", None), (102, "12, 34 !?", "en"), (103, de * 4000, None), (104, "der", None), (5, rows[5][1], "de"), (105, "的", None)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    got = languages.predict(df, languages.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102)) and by[103].lang_pred == "de" and by[104].lang_pred == "de" and by[105].lang_pred in ("de", "en")
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert by[None].lang_pred == "en" and sum(r.doc_id == 5 for r in got) == 2


def test_nothing_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    none = spark.createDataFrame([], schema)
    assert languages.predict(none, languages.fit(none)).count() == 0
    bare = spark.createDataFrame([(1, "some text", None)], schema)
    assert [(r.lang_pred, r.score) for r in languages.predict(bare, languages.fit(bare)).collect()] == [("und", 0.0)]
    one = spark.createDataFrame([(1, "some text", "en"), (2, "more of it", "en"), (3, "7", "en")], schema)
    assert {r.doc_id: r.lang_pred for r in languages.predict(one, languages.fit(one)).collect()} == {1: "en", 2: "en", 3: "und"}


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('word', id) as text", "if(id % 10 = 0, 'a', 'b') as lang")
    got = languages.sample(docs, 200).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"a": 100, "b": 100}
