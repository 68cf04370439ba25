"""The built-in phishing classifier: naive Bayes over tf-idf of a few fixed sentences, as a table of weights and SQL over it."""

from __future__ import annotations

import math
import re

# The sentences (phishing, then legitimate) of the two variants, and which of their words count as stop words.
SAMPLES = {
    "ce": (
        ("Urgent: Your account has been suspended. Click here to verify.", "Congratulations! You've won a free prize. Claim now!", "Your password will expire. Update immediately.", "Act now to avoid account suspension."),
        ("Please find attached the quarterly report.", "Meeting scheduled for tomorrow at 3pm.", "Here are the documents you requested.", "Thank you for your email. I'll review and respond."),
    ),
    "eg": (
        ("Urgent: Account suspended. Click here.", "Congratulations! Claim prize now.", "Password expires. Update immediately."),
        ("Please find attached the report.", "Meeting at 3pm tomorrow.", "Here are the documents."),
    ),
}
STOPPED = ("and", "are", "at", "been", "find", "for", "has", "here", "now", "please", "the", "to", "will", "you", "your")


def table(variant: str) -> list[tuple[str, float, float]]:
    """(word, smoothed inverse document frequency, log of its share in phishing over that in legitimate texts)."""
    classes = [[[w for w in re.findall(r"\w{2,}", t.lower()) if w not in STOPPED] for t in texts] for texts in SAMPLES[variant]]
    docs = classes[0] + classes[1]
    words = sorted({w for d in docs for w in d})
    idf = {w: math.log((1 + len(docs)) / (1 + sum(w in d for d in docs))) + 1 for w in words}

    def shares(texts):
        total = dict.fromkeys(words, 1.0)
        for d in texts:
            norm = math.sqrt(sum((d.count(w) * idf[w]) ** 2 for w in set(d)))
            for w in d:
                total[w] += idf[w] / norm
        whole = sum(total.values())
        return {w: math.log(x / whole) for w, x in total.items()}

    bad, good = shares(classes[0]), shares(classes[1])
    return [(w, idf[w], bad[w] - good[w]) for w in words]


def probabilities() -> str:
    """Table expressions ending in ``phishing_probabilities`` (doc_key, variant, ce, eg) over ``texts``: texts without a known word have the classes' prior, a half."""
    rows = {v: {w: (i, x) for w, i, x in table(v)} for v in SAMPLES}
    words = sorted({*rows["ce"], *rows["eg"]})
    values = " union all ".join("select '%s' as word, %s" % (w, ", ".join(f"{rows[v].get(w, (0.0, 0.0))[0]!r}e0 as idf_{v}, {rows[v].get(w, (0.0, 0.0))[1]!r}e0 as weight_{v}" for v in SAMPLES)) for w in words)
    listed = ", ".join(f"'{w}'" for w in words)
    said = lambda v: f"1e0 / (1e0 + exp(-coalesce(sum(n * idf_{v} * weight_{v}) / sqrt(nullif(sum(n * idf_{v} * n * idf_{v}), 0e0)), 0e0)))"
    return f"""
phishing_terms as ({values}),
known_words as (select doc_key, variant, word, count(*) as n from (select doc_key, variant, @explode(@filter(@words(content@w), @it in ({listed})@f)) as word from texts) x group by doc_key, variant, word),
phishing_probabilities as (select t.doc_key, t.variant, {said("ce")} as ce, {said("eg")} as eg from (select doc_key, variant from texts) t left join known_words k on k.doc_key = t.doc_key and k.variant = t.variant left join phishing_terms p on p.word = k.word group by t.doc_key, t.variant)"""
