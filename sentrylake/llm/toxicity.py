"""Toxicity (operator 5): a linear-chain conditional random field over tokens.

Tokens are runs of letters, digits and bytes outside ASCII; their features are the token and its first 4, 5 and 6 bytes,
with A-Z lower-cased. Labels are given for documents, so tokens are labelled first: of all labelled documents, features
that stand in at least MIN_SHARE of the toxic ones and LIFT times as often there as in the others are marked, and in a
toxic document the tokens with a marked feature are the toxic ones. The field (two states) is fitted to a bounded sample
of those documents (SAMPLE_DOCS of each label) by gradient ascent on the likelihood, with a penalty.

Scoring runs forward and backward over each whole text. Tokens without a weighted feature all have the same potential,
so a run of n of them is the n-th power of one 2 x 2 matrix: the sums stay exact and only weighted tokens cost time. A
document's score is a logistic function, fitted on the same sample, of the largest marginal and of the expected number of
toxic tokens; runs of tokens whose marginal is at least one half are the offending spans (byte offsets).

Rows whose crc32(doc_id as text) mod 5 is 0 are held out: nothing is learned from them. A null label is no label; a
doc_id labelled twice counts as toxic if either row says so. Null and empty texts get the score of no evidence. Without
labels every score is 0. Repeated rows are scored one by one. Only doc_id, text and the labels' doc_id, toxic are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .encoding import forget, text_slices
from .words import mix, words

#: Documents of each label in the sample that the field and the score are fitted on.
SAMPLE_DOCS = 1000
#: Share of the toxic documents that a marked feature stands in at least, and how many times as often as in the others.
MIN_SHARE, LIFT = 0.002, 15.0
#: Labels that are broadcast at most; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
PREFIXES = (4, 5, 6)
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def features(texts: list[bytes]):
    """The tokens of texts and, one row a token, the keys of its features; the first is that of its first 4 bytes.

    A key of 0 stands for a prefix that the token is too short for."""
    w = words(texts, BREAKS)
    size = w.end - w.start
    raw = np.append(w.raw, np.zeros(8, np.uint8))
    head = np.zeros(len(w.start), np.uint64)
    keys = np.zeros((len(w.start), 1 + len(PREFIXES)), np.uint64)
    done = 0
    for j, n in enumerate(PREFIXES):
        for k in range(done, n):
            head |= np.where(size > k, _LOWER[raw[w.start + k]], np.uint64(0)) << np.uint64(8 * k)
        done = n
        keys[:, j] = np.where((size >= n) | (j == 0), mix(head + np.uint64(n << 56)), np.uint64(0))
    keys[:, -1] = mix(w.hash + np.uint64(77))
    return w, keys.view(np.int64)


class Model(NamedTuple):
    keys: np.ndarray  # sorted feature keys
    weights: np.ndarray
    heads: np.ndarray  # sorted 4-byte keys of tokens that can have a weighted feature
    bias: float
    change: np.ndarray  # log potentials of state changes
    score: np.ndarray  # intercept and two weights


NO_MODEL = Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), -8.0, np.zeros((2, 2)), np.array([-50.0, 0.0, 0.0]))


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(keys.shape, np.int64), np.zeros(keys.shape, bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def marginals(potentials: np.ndarray, gaps: list[int], model: Model) -> np.ndarray:
    """P(toxic) of each weighted token. gaps: tokens without weights before each one and after the last."""
    step = np.exp(model.change) * np.array([1.0, np.exp(model.bias)])[None, :]
    powers: dict[int, np.ndarray] = {}

    def gap(n: int) -> np.ndarray:
        if n not in powers:
            m, base, left = np.eye(2), step / step.max(), n
            while left:
                if left & 1:
                    m = m @ base
                    m /= m.max()
                base = base @ base
                base /= base.max()
                left >>= 1
            powers[n] = m
        return powers[n]

    k = len(potentials)
    trans = np.exp(model.change)
    emit = np.ones((k, 2))
    emit[:, 1] = np.exp(np.minimum(potentials, 50))
    forward = np.zeros((k, 2))
    state = np.array([1.0, 0.0])  # a text starts outside toxic spans
    for i in range(k):
        state = (state @ gap(gaps[i]) @ trans) * emit[i]
        state /= state.sum()
        forward[i] = state
    back = gap(gaps[k]).sum(axis=1)
    out = np.zeros(k)
    for i in range(k - 1, -1, -1):
        both = forward[i] * back
        out[i] = both[1] / both.sum()
        back = gap(gaps[i]) @ (trans @ (emit[i] * back))
        back /= back.sum()
    return out


def evidence(texts: list[bytes], model: Model) -> list[tuple[float, float, list[list[int]]]]:
    """Per text: largest marginal, expected number of toxic tokens, spans."""
    w, keys = features(texts)
    out = [(0.0, 0.0, [])] * len(texts)
    if not len(w.start) or not len(model.keys):
        return out
    hit = np.flatnonzero(_member(model.heads, keys[:, 0])[1])
    at, ok = _member(model.keys, keys[hit])
    value = np.where(ok, model.weights[at], 0.0).sum(axis=1) + model.bias
    some = ok.any(axis=1)
    hit, value = hit[some], value[some]
    bounds = np.searchsorted(hit, w.bound)
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[i], bounds[i + 1]
        own = hit[a:b]
        edges = np.concatenate([[w.bound[i] - 1], own, [w.bound[i + 1]]])
        p = marginals(value[a:b], (np.diff(edges) - 1).tolist(), model)
        spans: list[list[int]] = []
        last = -2
        for t, q in zip(own.tolist(), p.tolist()):
            if q >= 0.5:
                lo, hi = int(w.start[t] - w.first[i]), int(w.end[t] - w.first[i])
                if spans and t == last + 1:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
                last = t
        out[i] = (float(p.max()), float(p.sum()), spans)
    return out


def to_score(top: np.ndarray, count: np.ndarray, model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-(model.score[0] + model.score[1] * top + model.score[2] * np.log1p(count))))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the rows that may be learned from."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    y = y.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    small = y.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(y) if small else y, "doc_id")


def _document_counts(rows: DataFrame, only: np.ndarray | None) -> DataFrame:
    """Per feature key: documents that have it, summed within each slice of texts; only: of these keys."""
    out = pa.schema([("key", pa.int64()), ("head", pa.int64()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for _, texts in text_slices(b.column(0)):
                w, keys = features(texts)
                if not len(keys):
                    continue
                doc = np.repeat(np.arange(len(texts)), np.diff(w.bound))
                flat, head, doc = keys.ravel(), np.repeat(keys[:, 0], keys.shape[1]), np.repeat(doc, keys.shape[1])
                keep = flat != 0 if only is None else _member(only, flat)[1]
                flat, head, doc = flat[keep], head[keep], doc[keep]
                order = np.lexsort((doc, flat))
                flat, head, doc = flat[order], head[order], doc[order]
                new = np.append(True, (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])) if len(flat) else np.zeros(0, bool)
                key, first, n = np.unique(flat[new], return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(head[new][first]), pa.array(n)], schema=out)

    return rows.select("text").mapInArrow(run, "key long, head long, n long").groupBy("key").agg(F.min("head").alias("head"), F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    rows = labelled(docs, labels)
    # two rows at most: one a label
    total = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = total.get(1, 0), total.get(0, 0)
    if not n_toxic:
        return NO_MODEL
    # at most (features of a document) / MIN_SHARE keys can stand in so many documents, whatever the corpus
    least = max(5.0, MIN_SHARE * n_toxic)
    often = materialize(_document_counts(rows.filter("toxic <> 0"), None).filter(F.col("n") >= least), "toxic-features")
    toxic = often.toPandas().sort_values("key", ignore_index=True)
    keys = toxic["key"].to_numpy(np.int64)
    clean = materialize(_document_counts(rows.filter("toxic = 0"), keys), "clean-features").select("key", F.col("n").alias("m")).toPandas()
    both = toxic.merge(clean, on="key", how="left").fillna({"m": 0})
    lift = both["n"] / n_toxic / ((both["m"] + 1) / max(1, n_clean))
    marked = both[lift >= LIFT].sort_values("key", ignore_index=True)
    if marked.empty:
        return NO_MODEL
    # by the least hashes: about twice as many rows pass the first filter as stay, however many there are
    order = F.xxhash64("doc_id", "text")
    bound = lambda n: int(-(2**63) + 2**64 * min(1.0, (2 * sample_docs + 100) / max(1, n))) - 1
    part = [rows.filter(c).filter(order <= F.lit(bound(n))).orderBy(order).limit(sample_docs).select("text", "toxic") for c, n in (("toxic <> 0", n_toxic), ("toxic = 0", n_clean))]
    keys = marked["key"].to_numpy(np.int64)
    return train(_hits(part[0].union(part[1]), keys).toPandas(), keys, np.unique(marked["head"].to_numpy(np.int64)), (n_toxic, n_clean))


def _hits(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """Per row of the sample (text, toxic): toxic, its number of tokens, and the places and numbers of the features in keys."""
    out = pa.schema([("toxic", pa.int32()), ("n_tokens", pa.int64()), ("places", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))])

    def run(batches):
        for b in batches:
            for at, texts in text_slices(b.column(0)):
                w, all_keys = features(texts)
                index, ok = _member(keys, all_keys)
                tok, col = np.nonzero(ok)
                ends = pa.array(np.searchsorted(tok, w.bound), pa.int32())
                place = tok - w.bound[np.searchsorted(w.bound, tok, "right") - 1]
                lists = (pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (place, index[tok, col]))
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, len(texts)), pa.array(np.diff(w.bound), pa.int64()), *lists], schema=out)

    return sample.mapInArrow(run, "toxic int, n_tokens long, places array<int>, features array<int>")


def train(sample: pd.DataFrame, keys: np.ndarray, heads: np.ndarray, total: tuple[int, int], width: int = 128, rounds: int = 60) -> Model:
    """Fit the field to the sample (see _hits): tokens in chains of at most width, the features in keys."""
    toxic, count = (sample["toxic"] != 0).to_numpy(), sample["n_tokens"].to_numpy(np.int64)
    chains = -(-count // width)
    first = np.cumsum(chains) - chains
    n = int(chains.sum())
    size = np.full(n, width)
    some = count > 0
    size[(first + chains - 1)[some]] = (count - (chains - 1) * width)[some]
    doc = np.repeat(np.arange(len(sample)), [len(x) for x in sample["places"]])
    join = lambda lists: np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in lists)])
    place, f = join(sample["places"]), join(sample["features"])
    chain = first[doc] + place // width
    active = np.zeros(n, bool)
    active[chain] = True
    # chains without a marked feature all look alike: one of each length stands for all of them
    kept = np.flatnonzero(active)
    plain = np.bincount(size[~active], minlength=width + 1)
    lengths = np.flatnonzero(plain)
    m = len(kept) + len(lengths)
    mult = np.concatenate([np.ones(len(kept)), plain[lengths]]).astype(float)
    length = np.concatenate([size[kept], lengths])
    row, col = np.searchsorted(kept, chain), place % width
    y = np.zeros((m, width), np.int64)
    y[row, col] = toxic[doc]
    mask = np.arange(width)[None, :] < length[:, None]
    weights, bias, change = np.zeros(len(keys)), -4.0, np.zeros((2, 2))
    state = np.concatenate([weights, [bias], change.ravel()])
    mom, var = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, rounds + 1):
        weights, bias, change = state[: len(keys)], state[len(keys)], state[len(keys) + 1 :].reshape(2, 2)
        s = np.full((m, width), bias)
        np.add.at(s, (row, col), weights[f])
        emit = np.stack([np.ones_like(s), np.exp(np.clip(s, -50, 50))], axis=2)
        tr = np.exp(change)
        a = np.zeros((m, width, 2))
        prev = np.zeros((m, 2))
        prev[:, 0] = 1
        for i in range(width):
            cur = (prev @ tr) * emit[:, i]
            cur /= cur.sum(axis=1, keepdims=True)
            a[:, i] = cur
            prev = np.where(mask[:, i : i + 1], cur, prev)
        b = np.ones((m, 2))
        p = np.zeros((m, width))
        grad_c = np.zeros((2, 2))
        for i in range(width - 1, -1, -1):
            on = mask[:, i]
            g = a[:, i] * b
            g /= g.sum(axis=1, keepdims=True)
            p[:, i] = g[:, 1] * on
            before = a[:, i - 1] if i else np.tile([1.0, 0.0], (m, 1))
            pair = before[:, :, None] * tr[None] * (emit[:, i] * b)[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            grad_c -= ((mult * on)[:, None, None] * pair).sum(axis=0)
            was = y[:, i - 1] if i else np.zeros(m, np.int64)
            np.add.at(grad_c, (was, y[:, i]), mult * on)
            nb = (emit[:, i] * b) @ tr.T
            nb /= nb.sum(axis=1, keepdims=True)
            b = np.where(on[:, None], nb, b)
        diff = (y - p) * mask * mult[:, None]
        grad_w = np.bincount(f, weights=diff[row, col], minlength=len(keys)) - 0.1 * weights
        grad = np.concatenate([grad_w, [diff.sum() - 0.01 * bias], (grad_c - 0.1 * change).ravel()])
        mom, var = 0.9 * mom + 0.1 * grad, 0.99 * var + 0.01 * grad**2
        state = state + 0.3 * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.99**t)) + 1e-8)
    model = Model(keys, state[: len(keys)].copy(), heads, float(state[len(keys)]), state[len(keys) + 1 :].reshape(2, 2).copy(), np.zeros(3))
    # the score, with each label weighted to its share of all labelled documents
    top, expected = np.zeros(len(sample)), np.zeros(len(sample))
    bounds = np.searchsorted(doc, np.arange(len(sample) + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        own, at = np.unique(place[bounds[i] : bounds[i + 1]], return_inverse=True)
        value = np.bincount(at, weights=model.weights[f[bounds[i] : bounds[i + 1]]]) + model.bias
        p = marginals(value, (np.diff(np.concatenate([[-1], own, [count[i]]])) - 1).tolist(), model)
        top[i], expected[i] = p.max(), p.sum()
    x = np.stack([np.ones(len(sample)), top, np.log1p(expected)], axis=1)
    z = toxic.astype(float)
    weight = np.where(toxic, total[0] / max(1, toxic.sum()), total[1] / max(1, (~toxic).sum()))
    weight = weight / weight.sum() * len(z)
    beta = np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 0.05 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (weight * (z - q)) - 0.05 * beta)
    return model._replace(score=beta)


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, score, spans of offending bytes."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("spans", pa.list_(pa.list_(pa.int64())))])
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        forget()
        m = Model(*sent.value)
        for b in batches:
            for at, texts in text_slices(b.column(1)):
                e = evidence(texts, m)
                score = to_score(np.array([v[0] for v in e]), np.array([v[1] for v in e]), m)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(e)), pa.array(score), pa.array([v[2] for v in e], out.types[2])], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, spans array<array<long>>")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is under one half, all their columns."""
    at_text = docs.columns.index("text")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        forget()
        m = Model(*sent.value)
        for b in batches:
            for at, texts in text_slices(b.column(at_text).cast(pa.string())):
                e = evidence(texts, m)
                clean = to_score(np.array([v[0] for v in e]), np.array([v[1] for v in e]), m) < 0.5
                yield b.slice(at, len(e)).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
