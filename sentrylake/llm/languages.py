"""Language of whole texts by error-correcting output codes.

Each language has a codeword; each of its bits is a logistic regression over hashed byte n-grams of letters. Decoding takes the
codeword of the least loss, where a bit's loss weighs as much as the bit was right about the language on rows kept back from
the fit (loss-weighted decoding). What is near two codewords is flagged as ambiguous.

Texts are read as bytes: A-Z and the capitals of U+00C0 to U+00DE are lower-cased, runs of other ASCII characters than letters are
one space, and so is each end of a text. An n-gram never leaves its text.

The fit takes a bounded sample: SAMPLE labelled rows in all, as many of each language, chosen by hash from the rows of all of
the table. Each gives two vectors, its whole text's and that of a piece of PIECE bytes, so that short texts are known too. Only
vectors go to the driver. Languages are few: their number is that of the distinct labels.

A text without a letter, or null, is ``und`` with score 0; so is every text where no row has a label. With one language all others
are that one. A null doc_id counts as empty text in the hash that holds rows out. Repeated rows are predicted alike, ties between
codewords go to the language that sorts first. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoding import text_slices

#: Labelled rows that the classifiers are fitted to, at most (one of each language at least); bytes of the pieces.
SAMPLE, PIECE = 2000, 120
#: Lengths of the n-grams, and the vectors' length.
GRAMS, SIZE = (2, 3, 4), 1 << 13
#: One sampled row in so many is kept back from the fit, to weigh bits and to scale scores.
KEPT_BACK = 5
#: Two languages whose shares differ by less are ambiguous.
MARGIN = 0.2
#: Up to so many languages have every column that tells two sets of them apart.
EXHAUSTIVE = 6
_ROWS = 512  # vectors that are held at once
NONE = "und"

_LOWER = np.zeros(256, np.uint8)
_LOWER[0x80:] = np.arange(0x80, 256)
for _c in range(26):
    _LOWER[65 + _c] = _LOWER[97 + _c] = 97 + _c
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # SIZE x bits
    bias: np.ndarray
    share: np.ndarray  # languages x bits: what a bit weighs for a language
    scale: float


def vectors(texts: list[bytes]) -> np.ndarray:
    """Relative frequencies of the hashed n-grams, a row for each text."""
    out = np.zeros((len(texts), SIZE), np.float32)
    raw = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    who = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    codes = _LOWER[raw]
    after = np.zeros(len(raw), bool)
    after[1:] = raw[:-1] == 0xC3
    codes[after & (codes >= 0x80) & (codes <= 0x9E) & (codes != 0x97)] += 0x20
    keep = codes != 0
    keep[1:] |= (codes[:-1] != 0) | (who[1:] != who[:-1])
    keep[0] = True
    codes, who = codes[keep], who[keep]
    h = np.zeros(len(codes), np.uint32)
    counts = np.zeros(len(texts) * SIZE, np.int64)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1]
        h = h + (codes[n - 1 :].astype(np.uint32) + np.uint32(1)) * _MULTIPLIERS[n - 1]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * _MULTIPLIERS[1] + np.uint32(n)
            at = (mixed >> np.uint32(32 - SIZE.bit_length() + 1)).astype(np.int64)
            inside = who[: len(h)] == who[n - 1 :]
            counts += np.bincount((who[: len(h)].astype(np.int64) * SIZE + at)[inside], minlength=len(counts))
    out[:] = counts.reshape(len(texts), SIZE)
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0)


def code_matrix(n: int) -> np.ndarray:
    """Codewords of n languages: all columns that part them, or, of many, the farthest apart of random ones."""
    if n <= EXHAUSTIVE:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, np.int8).T.reshape(n, len(columns))
    rng = np.random.default_rng(n)
    best, far = None, -1
    for _ in range(200):
        m = rng.choice(np.array([-1, 1], np.int8), (n, 15 * int(np.ceil(np.log2(n)))))
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = (m.shape[1] - m.astype(np.int32) @ m.T.astype(np.int32)) // 2 + np.eye(n, dtype=np.int32) * 10**6
        if apart.min() > far:
            best, far = m, int(apart.min())
    return best


def _regressions(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of a logistic regression for each column of y (-1 or 1), by Adam over all rows."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for t in range(1, steps + 1):
        z = x @ w + b
        slope = -y / (1 + np.exp(np.clip(y * z, -30, 30))) / len(x)
        for k, (v, g) in enumerate(((w, x.T @ slope + l2 * w), (b, slope.sum(axis=0)))):
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (g - first)
            second += 0.001 * (g * g - second)
            v -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8) * (1 - t / (steps + 1))
    return w, b


def losses(model: Model, x: np.ndarray) -> np.ndarray:
    """Loss-weighted distance of each row to each language's codeword."""
    z = x @ model.weights + model.bias
    out = np.empty((len(x), len(model.languages)))
    for i in range(len(model.languages)):
        out[:, i] = np.logaddexp(0, -model.code[i] * z) @ model.share[i]
    return out


def _soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(names: list[str], x: np.ndarray, language: np.ndarray, back: np.ndarray) -> Model:
    """A model of vectors x with places of their languages in names; back: rows that are kept back from the fit."""
    if len(names) < 2:
        return Model(names, np.ones((len(names), 0), np.int8), np.zeros((SIZE, 0), np.float32), np.zeros(0, np.float32), np.ones((len(names), 0)), 1.0)
    code = code_matrix(len(names))
    seen = ~back
    # rare n-grams count for more: features over the root of their mean, which the weights take in
    root = np.sqrt(x[seen].mean(axis=0) + 1e-6)
    w, b = _regressions(x[seen] / root, code[language[seen]].astype(np.float32))
    model = Model(names, code, (w / root[:, None]).astype(np.float32), b, np.full(code.shape, 1 / code.shape[1]), 1.0)
    check = back if back.any() else seen
    right = (x[check] @ model.weights + b) * code[language[check]] > 0
    share = np.ones(code.shape)
    for i in range(len(names)):
        mine = language[check] == i
        if mine.any():
            # one more right answer for each bit, so that no language loses all of its bits
            share[i] = (right[mine].sum(axis=0) + 1) / (mine.sum() + 1)
    model = model._replace(share=share / share.sum(axis=1, keepdims=True))
    loss = losses(model, x[check])
    fits = [(-np.log(np.maximum(_soft(-s * loss)[np.arange(len(loss)), language[check]], 1e-9)).mean(), s) for s in (0.5, 1, 2, 3, 5, 8, 12, 20)]
    return model._replace(scale=float(min(fits)[1]))


def held_out(doc_id):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, lang, text of the rows to fit to: labelled ones that aren't held out, as many of each language, by hash."""
    able = docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id")).filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    counts = able.groupBy("lang").count()
    # a row for each language
    n = {r["lang"]: r["count"] for r in counts.collect()}
    each = max(1, most // max(1, len(n)))
    h = F.xxhash64("text", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # first a share by hash that leaves some more than are wanted, so that few rows of a language meet in a task
    share = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(min(1.0, (1.5 * each + 30) / v))) for k, v in (n or {"": 1}).items()))
    few = able.withColumn("h", h).filter(F.col("h").cast("double") / 2.0**63 <= -1 + 2 * share[F.col("lang")])
    return few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).filter(F.col("place") <= each).select("doc_id", "lang", "h", "text")


def _piece(text: bytes, h: int) -> bytes:
    """Some PIECE bytes of a text from a place that its hash names."""
    if len(text) <= PIECE:
        return text
    at = h % (len(text) - PIECE)
    return text[at : at + PIECE].decode("utf-8", "ignore").encode()


def fit(docs: DataFrame, most: int = SAMPLE) -> Model:
    """The model of documents (doc_id, lang, text)."""

    def run(batches):
        for b in batches:
            lang, h = b.column("lang").to_pylist(), b.column("h").to_pylist()
            for at, texts in text_slices(b.column("text")):
                for k in range(0, len(texts), _ROWS):
                    part = texts[k : k + _ROWS]
                    ids = range(at + k, at + k + len(part))
                    both = [(lang[i], h[i], v) for x in (part, [_piece(t, h[i]) for t, i in zip(part, ids)]) for i, v in zip(ids, vectors(x))]
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both]), pa.array([x[1] for x in both]), pa.array([np.flatnonzero(x[2]).astype("<u2").tobytes() for x in both], pa.binary()), pa.array([x[2][x[2] > 0].tobytes() for x in both], pa.binary())], ["lang", "h", "place", "value"])

    # two vectors of each of at most SAMPLE rows
    rows = sample(docs, most).select("lang", "h", "text").mapInArrow(run, "lang string, h long, place binary, value binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["h"], r["place"], r["value"]))
    names = sorted({r["lang"] for r in rows})
    x = np.zeros((len(rows), SIZE), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["place"], "<u2")] = np.frombuffer(r["value"], np.float32)
    where = {n: i for i, n in enumerate(names)}
    back = np.array([r["h"] % KEPT_BACK == 0 for r in rows], bool)
    language = np.array([where[r["lang"]] for r in rows], np.int64)
    # a language is fitted to something
    for i in range(len(names)):
        if back[language == i].all():
            back[language == i] = False
    return train(names, x, language, back)


def _has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(model)  # SIZE rows of some bits for each language
    kinds = dict(docs.dtypes)

    def run(batches):
        m = sent.value
        for b in batches:
            names, scores, near = [], [], []
            for _, texts in text_slices(b.column("text")):
                for k in range(0, len(texts), _ROWS):
                    part = texts[k : k + _ROWS]
                    if m.languages:
                        p = _soft(-m.scale * losses(m, vectors(part)))
                        first = p.argmax(axis=1)
                        top = p[np.arange(len(p)), first]
                        p[np.arange(len(p)), first] = 0
                        second = p.max(axis=1)
                    for i, t in enumerate(part):
                        known = bool(m.languages) and _has_letter(t)
                        names.append(m.languages[first[i]] if known else NONE)
                        scores.append(float(top[i]) if known else 0.0)
                        near.append(bool(top[i] - second[i] < MARGIN) if known else True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(near, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, f"doc_id {kinds['doc_id']}, held_out boolean, lang_pred string, score double, ambiguous boolean")
