"""Goals and plans inferred from an actor's encoded actions.

Probabilities depend on every earlier action of the actor, so actions are dealt by actor, sorted, and read in order with a
small state: the last 20 codes, the goals' probabilities, the plans' positions. A task streams over its rows; no actor's rows
are gathered, however many there are. An actor without actions has no rows; a null code counts as an empty one.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rules (actions in order, goal, boost), plans and thresholds of the second and the third variant.
_SHARED_RULES = (
    (("db_query:patients_table", "data_export"), "data_theft", 0.4),
    (("data_export", "email_send:external"), "exfiltration", 0.5),
    (("db_query:sensitive", "db_query:sensitive", "db_query:sensitive"), "reconnaissance", 0.3),
    (("login:after_hours", "db_query:sensitive"), "data_theft", 0.35),
)
_SHARED_PLANS = {
    "exfil_direct": ("db_query:sensitive", "data_export", "email_send:external"),
    "exfil_staged": ("db_query:sensitive", "db_query:sensitive", "data_export:internal", "email_send:external"),
    "recon": ("login", "db_query", "db_query", "db_query"),
}


@dataclass(frozen=True)
class Variant:
    rules: tuple
    plans: dict
    #: A goal that was idle for more than IDLE steps fades: once by this, or by its power of the steps beyond.
    fade: float
    by_age: bool
    #: Each contradiction multiplies all probabilities; a goal under the least one is dropped.
    contradiction: float
    least: float
    #: What a plan loses by an action of another kind, and by one of the kind that lacks the qualifier.
    other_kind: float
    same_kind: float
    #: A goal is reported over this probability, a plan over this completion.
    reported: float
    active: float


VARIANTS = {
    "ce": Variant(
        (*_SHARED_RULES, (("login:new_device", "login:after_hours"), "credential_harvesting", 0.4), (("data_export:internal", "data_export:internal"), "staging", 0.45)),
        _SHARED_PLANS | {"cred_theft": ("login:after_hours", "login:new_device", "db_query:sensitive")}, 0.95, False, 1.0, 0.0, 0.05, 0.02, 0.3, 0.3),
    "eg": Variant(_SHARED_RULES, _SHARED_PLANS, 0.92, True, 0.85, 0.08, 0.03, 0.03, 0.25, -1.0),
}
RULES, PLANS = VARIANTS["ce"].rules, VARIANTS["ce"].plans
RECENT, IDLE, MOST = 20, 20, 0.95
#: Goals in the order of their columns.
GOALS = ("data_theft", "exfiltration", "staging", "reconnaissance", "credential_harvesting")


def fits(code: str, wanted: str) -> bool:
    """Whether a code is of the wanted kind and holds its qualifier, if any."""
    kind, _, qualifier = wanted.partition(":")
    return code.startswith(kind) and qualifier in code


def occurs(codes, wanted) -> bool:
    """Whether the wanted actions occur in this order, others between them."""
    rest = iter(codes)
    return all(any(fits(c, w) for c in rest) for w in wanted)


class Goals:
    """State of one actor."""

    def __init__(self, variant: str = "ce"):
        self.v = VARIANTS[variant]
        self.codes, self.p, self.at = deque(maxlen=RECENT), {}, {}
        self.done, self.confidence = dict.fromkeys(self.v.plans, 0), dict.fromkeys(self.v.plans, 0.1)

    def observe(self, step: int, code: str, contradictions: int = 0) -> None:
        v = self.v
        self.codes.append(code)
        if v.contradiction < 1:
            for goal in self.p:
                self.p[goal] *= v.contradiction**contradictions
        for wanted, goal, boost in v.rules:
            if occurs(self.codes, wanted):
                self.p[goal] = min(MOST, self.p[goal] + boost * (1 - self.p[goal])) if goal in self.p else boost
                self.at[goal] = step
        for goal, last in list(self.at.items()):
            if step - last > IDLE:
                self.p[goal] *= v.fade ** (step - last - IDLE) if v.by_age else v.fade
            if self.p[goal] < v.least:
                del self.p[goal], self.at[goal]
        for name, wanted in v.plans.items():
            if self.done[name] < len(wanted):
                following = wanted[self.done[name]]
                if fits(code, following):
                    self.done[name] += 1
                    self.confidence[name] = min(0.9, self.confidence[name] + 0.15)
                else:
                    same_kind = code.startswith(following.partition(":")[0])
                    self.confidence[name] = max(0.05, self.confidence[name] - (v.same_kind if same_kind else v.other_kind))

    def assess(self) -> tuple:
        goal = max(self.p, key=self.p.get, default=None)
        if goal is not None and self.p[goal] <= self.v.reported:
            goal = None
        part = {name: self.done[name] / len(wanted) for name, wanted in self.v.plans.items()}
        plan = max(self.v.plans, key=lambda name: self.confidence[name] * part[name])
        active = part[plan] > self.v.active
        return (goal, self.p[goal] if goal else 0.0, plan if active else None, part[plan] if active else 0.0, *(self.p.get(g, 0.0) for g in GOALS[:4]))


SCHEMA = "event_id long, actor_id long, step long, last_of_step boolean, goal string, intent double, plan string, completion double, p_data_theft double, p_exfiltration double, p_staging double, p_reconnaissance double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def infer(codes: DataFrame, variant: str = "ce") -> DataFrame:
    """Per action (event_id, actor_id, step, ord, code; contradictions and last_of_step, if given): what is inferred of its actor after it."""
    for name, value in (("contradictions", 0), ("last_of_step", True)):
        codes = codes if name in codes.columns else codes.withColumn(name, F.lit(value))

    def follow(frames):
        actor, state = None, None
        for pdf in frames:
            rows = []
            for event, who, step, code, against, last in zip(*(pdf[c] for c in ("event_id", "actor_id", "step", "code", "contradictions", "last_of_step"))):
                if state is None or who != actor:
                    actor, state = who, Goals(variant)
                state.observe(step, code, against)
                rows.append((event, who, step, last, *state.assess()))
            yield pd.DataFrame(rows, columns=_NAMES)

    dealt = codes.filter("actor_id is not null").withColumn("code", F.coalesce("code", F.lit(""))).repartition("actor_id").sortWithinPartitions("actor_id", "ord")
    return dealt.select("event_id", "actor_id", "step", "code", "contradictions", "last_of_step").mapInPandas(follow, SCHEMA)


#: What a contradiction leaves of a goal's probability in the fourth variant.
KEPT = 0.85


def accumulate(boosted: DataFrame, goals: tuple) -> DataFrame:
    """Per action (event_id, actor_id, step, ord, last_of_step, contradictions, ``b_<goal>``: what its rules add): ``p_<goal>`` after it.

    Each contradiction leaves KEPT of every probability, then the boosts are added, up to 1. Further columns stay."""
    rest = [c for c in boosted.columns if not c.startswith("b_")]
    kinds = dict(boosted.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in rest), *(f"p_{g} double" for g in goals)])

    def follow(frames):
        actor, p = None, None
        for pdf in frames:
            rows = []
            for who, against, *boosts in zip(pdf["actor_id"], pdf["contradictions"], *(pdf[f"b_{g}"] for g in goals)):
                if p is None or who != actor:
                    actor, p = who, [0.0] * len(goals)
                p = [min(1.0, x * KEPT**against + b) for x, b in zip(p, boosts)]
                rows.append(p)
            yield pd.concat([pdf[rest], pd.DataFrame(rows, columns=[f"p_{g}" for g in goals], index=pdf.index)], axis=1)

    return boosted.filter("actor_id is not null").repartition("actor_id").sortWithinPartitions("actor_id", "ord").mapInPandas(follow, schema)
