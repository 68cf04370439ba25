"""Measures of texts against plain Python from their rules."""

import math
import os
import re

import pytest

from sentrylake.functions import bayes
from sentrylake.plans import queries as plans

TEXTS = [
    "Don't stop. It's a well-known price: 3.50 dollars, e.g. per pound! Isn't it?", "one two  three\tfour.\n five", "No end", "", None, "...", "a\u00a0b c\u2003d. e", "URGENT: verify your account now! Click here. Click",
    "x " * 40 + ". " + "y z " * 10 + "!!", "We're twenty-two. Mr. O'Neil's 1,000.25 items; 4.5.6?", "Short. Words here again. Words here again. Words here again and so on, then.", "Ça été naïve. L'œuvre d'été!",
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two senders' mails in order, each with a text of its own; the subject is that of the adapter."""
    folder = str(tmp_path_factory.mktemp("texts"))
    n = len(TEXTS)
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    events = [(i, f"2024-01-01 {i // 2:02d}:00:00", i % 2, "error", 100.0, '{"k": 8}') for i in range(2 * n)]
    spark.createDataFrame(events, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    mails = [(i, i % 2, plans.SUBJECTS[0] + (TEXTS[i % n] or "")) for i in range(2 * n)]
    return folder, mails


def words(t):
    return re.findall(r"\b\w+\b", t.lower())


def sentences(t):
    return [s.strip() for s in re.split(r"[.!?]+", t) if s.strip()]


def lengths(t):
    return [len(s.split()) for s in sentences(t)]


def mean(x):
    return sum(x) / len(x)


def got(spark, tables, name):
    return {r["event_id"]: r for r in plans.queries()[name](spark, tables[0]).collect()}


def test_counts(spark, tables):
    rows = got(spark, tables, "tokenize_words_sentences")
    for e, _, t in tables[1]:
        assert (rows[e].n_words, rows[e].n_distinct, rows[e].n_sentences) == (len(words(t)), len(set(words(t))), len(sentences(t))), t


def test_style_metrics(spark, tables):
    rows = got(spark, tables, "style_metrics")
    for e, _, t in tables[1]:
        if len(words(t)) < 30:
            assert e not in rows
        else:
            assert rows[e].avg_sentence_length == pytest.approx(mean(lengths(t))) and rows[e].vocabulary_richness == pytest.approx(len(set(words(t))) / len(words(t)))


def spread(x):
    return math.sqrt(mean([(v - mean(x)) ** 2 for v in x]))


def test_burstiness(spark, tables):
    rows = got(spark, tables, "burstiness")
    for e, _, t in tables[1]:
        n = lengths(t)
        assert rows[e].burstiness == pytest.approx(0.5 if len(n) < 2 else min(1.0, spread(n) / max(mean(n), 1) / 1.5)), t


def test_style_anomaly(spark, tables):
    rows = got(spark, tables, "style_anomaly")
    for e, _, t in tables[1]:
        assert rows[e].style_anomaly == pytest.approx(min(1.0, (abs(mean(lengths(t)) - 14.6) / 5 + abs(len(set(words(t))) / len(words(t)) - 0.633) / 0.15) / 3))


def profiles(mails):
    """Of each mail, the sender's count and rings before it."""
    held, out = {}, {}
    for e, who, t in mails:
        p = held.setdefault(who, {"n": 0, "len": [], "rich": []})
        out[e] = {"n": p["n"], "len": list(p["len"]), "rich": list(p["rich"])}
        if sentences(t):
            p["len"] = (p["len"] + [mean(lengths(t))])[-50:]
        if words(t):
            p["rich"] = (p["rich"] + [len(set(words(t))) / len(words(t))])[-50:]
        p["n"] += 1
    return out


def deviation(t, p):
    if p["n"] < 3 or not sentences(t):
        return 0.0
    n, r = mean(lengths(t)), len(set(words(t))) / max(len(words(t)), 1)
    a = abs(n - mean(p["len"][-10:])) / max(mean(p["len"][-10:]), 1) if p["len"] else 0.0
    b = abs(r - mean(p["rich"][-10:])) / max(mean(p["rich"][-10:]), 0.1) if p["rich"] else 0.0
    return (a + b) / 2


def test_authorship(spark, tables):
    rows, before = got(spark, tables, "authorship_consistency"), profiles(tables[1])
    for e, _, t in tables[1]:
        assert rows[e].consistency == pytest.approx(1 - min(1.0, deviation(t, before[e]))), t
    assert any(r.consistency < 1 for r in rows.values())


def test_author_profile(spark, tables):
    rows = got(spark, tables, "author_profile")
    for e, who, t in tables[1]:
        upto = [m for m in tables[1] if m[1] == who and m[0] <= e]
        assert rows[e].mails == len(upto) and rows[e].lengths == len([m for m in upto if sentences(m[2])]) and rows[e].richnesses == len([m for m in upto if words(m[2])])
        assert rows[e].avg_length == pytest.approx(mean([mean(lengths(m[2])) for m in upto][-50:]))


def bayes_by_rule(variant, text):
    """Term weights and class shares worked out anew: vectors of unit length, smoothed counts, equal priors."""
    tokens = lambda t: [w for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in bayes.STOPPED]
    bad, good = bayes.SAMPLES[variant]
    docs = [tokens(t) for t in (*bad, *good)]
    vocabulary = sorted({w for d in docs for w in d})
    idf = [math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in vocabulary]

    def vector(d):
        v = [d.count(w) * i for w, i in zip(vocabulary, idf)]
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm if norm else 0.0 for x in v]

    like = []
    for part in (docs[len(bad) :], docs[: len(bad)]):
        total = [1 + sum(x) for x in zip(*map(vector, part))]
        like.append(sum(x * math.log(c / sum(total)) for x, c in zip(vector(tokens(text)), total)) + math.log(len(part) / len(docs)))
    return 1 / (1 + math.exp(like[0] - like[1]))


def test_built_in_classifier(spark, tables):
    rows = got(spark, tables, "text_classifier_prob")
    for e, _, t in tables[1]:
        assert rows[e].probability_ce == pytest.approx(bayes_by_rule("ce", t)) and rows[e].probability_eg == pytest.approx(bayes_by_rule("eg", t))
    assert bayes_by_rule("ce", "nothing known") == 0.5


def test_ai_probability(spark, tables):
    rows, before = got(spark, tables, "ai_text_probability"), profiles(tables[1])
    seen, total = {}, 0
    for e, _, t in tables[1]:
        for w in words(t):
            seen[w] = seen.get(w, 0) + 1
            total += 1
        average = sum(seen[w] / total for w in words(t)) / len(words(t))
        odd, n, d = min(100.0, 1 / max(average, 0.001)), lengths(t), deviation(t, before[e])
        burst = 0.5 if len(n) < 2 else min(1.0, spread(n) / max(mean(n), 1) / 1.5)
        assert rows[e].ai_probability == pytest.approx(0.3 * (odd < 30) + 0.3 * (burst < 0.3) + 0.2 * (d > 0.5)), t
        assert rows[e].ai_eg == pytest.approx(0.3 * (odd < 30) + 0.3 * (len(n) >= 2 and spread(n) / (mean(n) + 0.1) < 0.3) + 0.2 * (d > 0.5)), t
        assert rows[e].ai_trained == pytest.approx(0.3 * (len(n) >= 2 and spread(n) / (mean(n) + 0.1) < 0.25)), t


def test_code_reaches_executors(tmp_path):
    """A session in another working directory whose workers don't have the package on their path."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").getOrCreate()
from sentrylake.plans import queries
for name in ("confirmed_alerts", "parse_mail", "stream_correlate"):
    assert queries.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "all ran" in out.stdout, out.stderr[-2000:]
