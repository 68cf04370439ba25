"""Alert decisions: one ordered pass over each actor's anchors.

EWMA baselines, trust and cooldown depend on earlier decisions of the same actor, so anchors are dealt by actor, sorted, and
read in order with a small state; a task streams over its rows, and no actor's anchors are gathered. One actor's anchors are one
task's work by the nature of the rule.

Where weights learn from verdicts they are shared by all actors. ``learn`` takes the anchors in rounds of some steps: all anchors
of a round are judged with the same weights, the gradients of its confirmed alerts are summed, and the weights that follow serve
the next round. Actors' states go from round to round through the shared folder. There are as many rounds as the log has days,
whatever its rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, written
from .features import WEIGHTS

#: Features that the baseline of the first variant follows.
BASELINE_KEYS = ("login_burst", "sens_burst", "email_burst", "after_hours", "export_large", "export_small", "staging_export")


# Parameters of the variants.
@dataclass(frozen=True)
class Config:
    early: float = 3.0
    confirmed: float = 4.0
    cooldown: int = 6
    use_baseline: bool = True
    use_trust: bool = True
    alpha_mean: float = 0.08
    alpha_var: float = 0.08
    z_clip: float = 6.0
    z_weight: float = 0.9
    trust_init: float = 0.70
    trust_min: float = 0.10
    trust_max: float = 0.95
    trust_slope: float = 1.2
    trust_tp: float = -0.15
    trust_fp: float = 0.04
    ml_weight: float = 2.0
    ml_margin: float = 3.0
    rate: float = 0.04
    decay: float = 1e-4
    weight_clip: float = 6.0
    role_adjustment: tuple = ()
    keys: tuple = BASELINE_KEYS


_SIX = ("login_burst", "sens_burst", "after_hours", "export_large", "export_small", "staging_export")
CONFIGS = {
    "lsc": Config(),
    "ce": Config(early=2.5, confirmed=3.5, keys=_SIX),
    "eg": Config(early=2.0, trust_tp=-0.18, trust_fp=0.05, role_adjustment=(("analyst", 0.8), ("admin", 1.2)), keys=_SIX),
    "egx": Config(early=2.0, use_baseline=False, trust_tp=-0.18, trust_fp=0.05, role_adjustment=(("analyst", 0.8), ("admin", 1.2)), keys=_SIX),
}


class ActorState:
    """What an actor's earlier anchors leave: baseline moments, trust, last alert of each tier."""

    def __init__(self, c: Config):
        self.c, self.mean, self.var, self.trust, self.last = c, {}, {}, c.trust_init, {}

    def baseline(self, features: dict[str, float]) -> float:
        c, total = self.c, 0.0
        for k, x in features.items():
            m, v = self.mean.get(k, 0.0), self.var.get(k, 1.0)
            total += min(max((x - m) / (v**0.5 + 1e-6), 0.0), c.z_clip)
            m = (1 - c.alpha_mean) * m + c.alpha_mean * x
            self.mean[k], self.var[k] = m, (1 - c.alpha_var) * v + c.alpha_var * (x - m) ** 2
        return c.z_weight * total

    def threshold(self, role: str | None = None) -> float:
        return self.c.confirmed + dict(self.c.role_adjustment).get(role, 0.0) + (self.c.trust_slope * (self.trust - 0.5) if self.c.use_trust else 0.0)

    def fires(self, tier: str, step: int) -> bool:
        if tier in self.last and step - self.last[tier] < self.c.cooldown:
            return False
        self.last[tier] = step
        return True

    def verdict(self, malicious: bool) -> None:
        if self.c.use_trust:
            t = self.trust + (self.c.trust_tp if malicious else self.c.trust_fp)
            self.trust = min(max(t, self.c.trust_min), self.c.trust_max)


SCHEMA = "event_id long, actor_id long, step long, label string, phase string, base double, value double, threshold double, trust double, early boolean, confirmed boolean, early_score double, confirmed_score double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
#: Weights that learn, and where they begin. What policy adds (the last) comes after the score, but the verdict sees it.
FIRST_WEIGHTS = WEIGHTS["lsc"] | {"unapproved": 2.0}


def judge(state: ActorState, r: dict, weights: dict | None = None) -> tuple:
    """What one anchor comes to, and what it leaves in its actor's state. weights: those that have been learnt, in place of its score_base."""
    c = state.c
    plain = r["score_base"] if weights is None else sum(w * r[k] for k, w in weights.items() if k != "unapproved")
    base = (plain + r["off"]) * r["mult"]
    if c.use_baseline:
        base += state.baseline({k: r[k] for k in c.keys})
    value = base + r["boost"]
    threshold, trust = state.threshold(r["role"]), state.trust
    # what the anomaly model adds moves borderline scores only
    nudged = lambda least: value + (c.ml_weight * r["ml"] if value >= least - c.ml_margin else 0.0)
    early_score, confirmed_score = nudged(c.early), nudged(threshold)
    early = bool(early_score >= c.early and state.fires("early", r["step"]))
    confirmed = bool(confirmed_score >= threshold and r["gate"] and state.fires("confirmed", r["step"]))
    if confirmed:
        state.verdict(r["label"] == "malicious")
    return r["event_id"], r["actor_id"], r["step"], r["label"], r["phase"], base, value, threshold, trust, early, confirmed, early_score, confirmed_score


def decide(scored: DataFrame, config: Config | None = None, by: tuple = ()) -> DataFrame:
    """A row for each scored anchor (ord, role, label, phase, score_base, off, mult, boost, ml, gate and the baseline's features): scores, threshold, and what fires.

    by: further columns that part the state, as the runs of a sweep do; they stay in the result."""
    c = config or Config()
    for name in ("boost", "ml"):
        scored = scored if name in scored.columns else scored.withColumn(name, F.lit(0.0))
    kinds = dict(scored.dtypes)
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), SCHEMA])

    def follow(frames):
        last, state = None, None
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                key = (*(r[b] for b in by), r["actor_id"])
                if key != last:
                    # the columns of a sweep may carry thresholds and switches of their own
                    own = {k: r[k] for k in ("confirmed", "early", "use_baseline", "use_trust") if k in r}
                    last, state = key, ActorState(replace(c, **own))
                rows.append((*(r[b] for b in by), *judge(state, r)))
            yield pd.DataFrame(rows, columns=[*by, *_NAMES])

    keys = [*by, "actor_id"]
    return scored.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInPandas(follow, schema)


#: Gradients are summed as integers of this unit, so that no order of adding changes them.
UNIT = 1e12
_NEVER = -(10**9)
_GRADIENTS = [f"g_{k}" for k in FIRST_WEIGHTS]
_STATE = "means array<double>, vars array<double>, last_early long, last_confirmed long"


def gradient(r: dict, weights: dict) -> list[int]:
    """Of the loss of one confirmed alert, without the decay, in UNITs."""
    p = 1 / (1 + math.exp(-sum(w * r[k] for k, w in weights.items())))
    y = 1.0 if r["label"] == "malicious" else 0.0
    return [round((p - y) * r[k] * UNIT) for k in weights]


def moved(weights: dict, sums: list[int], n: int, c: Config) -> dict:
    """Weights after a round with n confirmed alerts."""
    return {k: min(max(w - c.rate * (g / UNIT + n * c.decay * w), -c.weight_clip), c.weight_clip) for (k, w), g in zip(weights.items(), sums)}


def learn(scored: DataFrame, config: Config | None = None, every: int = 24, by: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """Decisions as ``decide`` gives them, with weights that learn, and the weights in force: by, round, key, weight.

    scored has a column for each key of FIRST_WEIGHTS. by: columns that name a model of its own; there are few of them."""
    c = config or Config()
    spark = scored.sparkSession
    for name in ("boost", "ml"):
        scored = scored if name in scored.columns else scored.withColumn(name, F.lit(0.0))
    kinds = dict(scored.dtypes)
    own = [k for k in ("confirmed", "early", "use_baseline", "use_trust") if k in scored.columns]
    columns = list(dict.fromkeys([*by, "event_id", "actor_id", "ord", "step", "label", "phase", "role", "score_base", "off", "mult", "boost", "ml", "gate", *own, *c.keys, *FIRST_WEIGHTS]))
    rows = written(scored.select(*columns, F.floor(F.col("step") / every).cast("long").alias("round")), "rounds", "round")
    folder = shared_folder(spark, "decided")
    schema = ", ".join([*(f"{b} {kinds[b]}" for b in by), SCHEMA, *(f"{g} long" for g in _GRADIENTS), "held boolean", _STATE])
    names = [x.split()[0] for x in schema.split(", ")]
    whole = {n: "Int64" for n in ("event_id", "actor_id", "step", *_GRADIENTS, "last_early", "last_confirmed")}
    models: dict[tuple, dict] = {}
    history: list[tuple] = []
    state = None
    # one number for each day or so
    for number in sorted(r[0] for r in rows.select("round").distinct().collect()):
        new = rows.filter(F.col("round") == number).drop("round").withColumn("held", F.lit(False))
        both = new if state is None else new.unionByName(state, allowMissingColumns=True)
        sent = dict(models)

        def follow(frames):
            last, actor, weights, done = None, None, None, []

            def keep():
                state = {"means": [actor.mean.get(k, 0.0) for k in c.keys], "vars": [actor.var.get(k, 1.0) for k in c.keys]}
                done.append(dict(zip((*by, "actor_id"), last)) | {"held": True, "trust": actor.trust, **{f"last_{t}": actor.last.get(t, _NEVER) for t in ("early", "confirmed")}} | state)

            def put():
                out = pd.DataFrame(done, columns=names).astype(whole).astype(object)
                out = out.where(out.notna(), None)
                done.clear()
                return out

            for pdf in frames:
                for r in pdf.to_dict("records"):
                    key = (*(r[b] for b in by), r["actor_id"])
                    if key != last:
                        if last is not None:
                            keep()
                        last, actor, weights = key, ActorState(c), sent.get(key[:-1], FIRST_WEIGHTS)
                    if r["held"]:
                        actor.mean, actor.var, actor.trust = dict(zip(c.keys, r["means"])), dict(zip(c.keys, r["vars"])), r["trust"]
                        actor.last = {t: int(r[f"last_{t}"]) for t in ("early", "confirmed") if r[f"last_{t}"] != _NEVER}
                        continue
                    actor.c = replace(c, **{k: r[k] for k in own}) if own else c
                    got = judge(actor, r, weights)
                    done.append(dict(zip(by, key)) | dict(zip(_NAMES, got)) | {"held": False, "means": [], "vars": []} | (dict(zip(_GRADIENTS, gradient(r, weights))) if got[10] else {}))
                yield put()
            if last is not None:
                keep()
                yield put()

        keys = [*by, "actor_id"]
        both.repartition(*keys).sortWithinPartitions(*keys, F.desc("held"), "ord").mapInPandas(follow, schema).write.parquet(f"{folder}/round={number}")
        done = spark.read.schema(schema).parquet(f"{folder}/round={number}")
        for m in done.select(*by).distinct().collect() if by else [()]:
            history += [(*m, number, k, w) for k, w in models.get(tuple(m), FIRST_WEIGHTS).items()]
        sums = done.filter("confirmed").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(g).alias(g) for g in _GRADIENTS)).collect()
        for s in sums:
            if s["n"]:
                m = tuple(s[b] for b in by)
                models[m] = moved(models.get(m, FIRST_WEIGHTS), [s[g] for g in _GRADIENTS], s["n"], c)
        state = done.filter("held").select(*by, "actor_id", "trust", "held", *(x.split()[0] for x in _STATE.split(", ")))
    decided = spark.read.schema(schema).parquet(f"{folder}/round=*") if state is not None else spark.createDataFrame([], schema)
    weights = spark.createDataFrame(history, ", ".join([*(f"{b} {kinds[b]}" for b in by), "round long, key string, weight double"]))
    return decided.filter("not held").select(*by, *_NAMES), weights


def fired(decided: DataFrame, config: Config | None = None) -> DataFrame:
    """The early and the confirmed alerts of decided anchors, one row each, in one pass."""
    c = config or Config()
    shared = [x for x in decided.columns if x not in (*_NAMES[5:],)]
    verdict = F.when(F.col("label") == "malicious", "malicious").otherwise("benign")
    tier = lambda name, fires, score, threshold, said: F.struct(F.col(fires).alias("fires"), F.lit(name).alias("tier"), F.col(score).alias("score"), threshold.alias("threshold"), said.alias("verdict"))
    both = F.array(tier("early", "early", "early_score", F.lit(c.early), F.lit(None).cast("string")), tier("confirmed", "confirmed", "confirmed_score", F.col("threshold"), verdict))
    rows = decided.select(*shared, "trust", F.explode(F.filter(both, lambda x: x["fires"])).alias("a"))
    return rows.select(*shared, "a.tier", "a.score", "a.threshold", "trust", "a.verdict")


def alerts(scored: DataFrame, config: Config | None = None) -> DataFrame:
    """Early and confirmed alerts of scored anchors."""
    return fired(decide(scored, config), config)
