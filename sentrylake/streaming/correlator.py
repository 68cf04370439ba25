"""The correlator of the first variant over a stream, with event time and keyed state.

An actor's state is a value: the rows of steps that are still open, the last events of the window, baseline moments by
feature, and trust with the steps of the last alerts. A step is worked on when the watermark has passed its
end: a timer stands at the end of the earliest open step, and when it fires, all steps that are over are taken in order, each as a
whole. What comes out therefore doesn't depend on how events are dealt to batches, as long as they come within the watermark;
Spark drops rows that come later and counts them. The alerts of the last steps come when later events move the watermark on.

An actor without events for ``idle`` milliseconds of event time is forgotten, if that is given: their next event starts anew,
and a timer frees their state.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.decisions import CONFIGS, ActorState, judge
from ..operators.features import WEIGHTS, WINDOW

#: Milliseconds of a step, and when step 0 begins.
STEP_MS, ORIGIN_MS = 3_600_000, 1_704_067_200_000
_FIELDS = ("event_id", "step", "event_type", "resource", "action", "dst", "bytes", "attachment_kb", "role", "after_hours", "takeover", "device_change", "cycle", "ticket_id", "approved_partner", "label", "phase", "src_rank")
SCHEMA = "event_id long, actor_id long, step long, tier string, label string, score double, threshold double, trust double"
_ALERT = tuple(x.split()[0] for x in SCHEMA.split(", "))


def features(recent: list[dict]) -> dict[str, float]:
    """Window features of a list of events, the latest last."""
    kind = lambda r, k: r["event_type"] == k
    large = sum(kind(r, "email_send") and (r["dst"] or "").endswith("outside") and (r["attachment_kb"] or 0) > 200 for r in recent)
    taken = [r["bytes"] or 0 for r in recent if kind(r, "data_export") and r["resource"] == "patients_table" and r["action"] == "EXPORT"]
    found = {
        "login_burst": sum(kind(r, "login") for r in recent) >= 3,
        "sens_burst": sum(kind(r, "db_query") and r["resource"] == "patients_table" for r in recent) >= 6,
        "email_burst": large >= 3,
        "after_hours": any(r["after_hours"] for r in recent),
        "export_large": bool(taken) and max(taken) >= 120000,
        "export_small": bool(taken) and max(taken) < 120000,
        "staging_export": any(kind(r, "data_export") and r["resource"] == "patients_table" and r["action"] in ("EXPORT_INTERNAL", "EXPORT_STAGING") for r in recent),
    }
    return {k: float(v) for k, v in found.items()}


def score(event: dict, recent: list[dict], profile: tuple) -> dict | None:
    """The scored anchor, or None where policy leaves it out. profile: role, allowed_after_hours, approved_dst."""
    role, allowed, approved = profile
    f = features(recent)
    f["anchor_email"], f["anchor_login"] = float(event["event_type"] == "email_send"), float(event["event_type"] == "login")
    base = sum(w * f[k] for k, w in WEIGHTS["lsc"].items())
    mult, off = 1.0, 0.0
    if any(r["cycle"] == "partner_reporting" for r in recent):
        mult, off = (0.70, -0.60) if any(r["ticket_id"] for r in recent) else (0.85, -0.30)
    leaving = [r["dst"] == approved or r["approved_partner"] for r in recent if r["event_type"] == "email_send" and (r["dst"] or "").lower().endswith("outside")]
    unapproved = not all(leaving)
    if leaving and not unapproved and not f["anchor_login"]:
        return None
    if f["after_hours"] and not allowed:
        mult, off = mult * 1.15, off + 0.50
    return f | {"event_id": event["event_id"], "step": event["step"], "label": event["label"], "phase": event["phase"], "role": role, "score_base": base, "mult": mult, "off": off, "boost": 0.0, "ml": 0.0,
                "gate": unapproved or bool(f["export_large"]) or bool(f["anchor_login"])}


def is_anchor(r: dict) -> bool:
    if r["event_type"] == "email_send":
        return (r["dst"] or "").endswith("outside") and (r["attachment_kb"] or 0) > 200
    return r["event_type"] == "login" and bool((r["after_hours"] and r["role"] == "admin") or r["takeover"])


def _profile(actor: int, role: str) -> tuple:
    return role, role != "staff" or actor % 8 == 0, "partner@outside" if role != "staff" else None


def close(actor: int, events: list[dict], recent: list[dict], state: ActorState, profile: tuple) -> tuple[list[tuple], list[dict]]:
    """Alerts of an actor's events of one step, in order, and the window after it."""
    recent = (recent + events)[-WINDOW:]
    out = []
    for e in filter(is_anchor, events):
        row = score(e, recent, profile)
        if row is None:
            continue
        got = judge(state, row | {"actor_id": actor})
        for tier, fires, value, threshold in (("early", got[9], got[11], state.c.early), ("confirmed", got[10], got[12], got[7])):
            if fires:
                out.append((e["event_id"], actor, e["step"], tier, e["label"], value, threshold, got[8]))
    return out, recent


def _text(rows: list[dict]) -> str:
    return "\n".join(map(json.dumps, rows))


def _dicts(text: str) -> list[dict]:
    """Rows of lines of JSON; nulls may be left out."""
    return [dict.fromkeys(_FIELDS) | json.loads(line) for line in text.split("\n") if line]


class Correlator(StatefulProcessor):
    """State and timers of one actor.

    All of it is one value, as every access is a message to Spark, and actors are many: there is one to read and one to write."""

    def __init__(self, idle: int | None = None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # what comes first in a state must not be null; -1: no alert yet
        self.actor = handle.getValueState("actor", "trust double, early long, confirmed long, last long, timer long, moments string, open string, window string")

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None or pd.isna(key[0]):
            # rows without an actor only move the watermark
            return
        steps, held = [], []
        for new in rows:
            steps += new["step"].tolist()
            held += new["row"].tolist()
        if not held:
            return
        trust, early, confirmed, last, timer, moments, open_, window = self.actor.get() or (CONFIGS["lsc"].trust_init, -1, -1, 0, 0, "{}", "", "")
        due = ORIGIN_MS + (int(min(steps)) + 1) * STEP_MS
        if not timer or due < timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = due
            self.handle.registerTimer(timer)
        self.actor.update((trust, early, confirmed, last, timer, moments, "\n".join([open_, *held] if open_ else held), window))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        actor, now = int(key[0]), timerValues.getCurrentWatermarkInMs()
        trust, early, confirmed, last, _, moments, open_, window = self.actor.get()
        events = sorted(_dicts(open_), key=lambda e: (e["step"], e["src_rank"], e["event_id"]))
        over = lambda e: ORIGIN_MS + (e["step"] + 1) * STEP_MS <= now
        out: list[tuple] = []
        ready, left = [e for e in events if over(e)], [e for e in events if not over(e)]
        if ready:
            state, recent = ActorState(CONFIGS["lsc"]), _dicts(window)
            state.trust, state.last = trust, {t: s for t, s in (("early", early), ("confirmed", confirmed)) if s >= 0}
            for feature, (mean, var) in json.loads(moments).items():
                state.mean[feature], state.var[feature] = mean, var
            for step, mine in itertools.groupby(ready, key=lambda e: e["step"]):
                if self.idle is not None and last and ORIGIN_MS + step * STEP_MS - last >= self.idle:
                    state, recent = ActorState(CONFIGS["lsc"]), []
                last, mine = ORIGIN_MS + (step + 1) * STEP_MS, list(mine)
                found, recent = close(actor, mine, recent, state, _profile(actor, mine[-1]["role"]))
                out += found
            window, moments = _text(recent), json.dumps({f: (m, state.var[f]) for f, m in state.mean.items()})
            trust, early, confirmed = state.trust, state.last.get("early", -1), state.last.get("confirmed", -1)
        timer = 0
        if left:
            timer = ORIGIN_MS + (left[0]["step"] + 1) * STEP_MS
        elif self.idle is not None:
            timer = last + self.idle
        if timer and timer <= now:
            # nothing is open, and the actor was idle for long enough
            self.actor.clear()
        else:
            if timer:
                self.handle.registerTimer(timer)
            self.actor.update((trust, early, confirmed, last, timer, moments, _text(left), window))
        if out:
            yield pd.DataFrame({"alert": [json.dumps(dict(zip(_ALERT, x))) for x in out]})

    def close(self) -> None:
        pass


def alerts(events: DataFrame, idle: int | None = None) -> DataFrame:
    """Alerts of a stream of activity events with a watermark on ``ts``."""
    # one text a row, in and out: pandas takes its time for each column of each actor
    found = events.select("actor_id", "ts", "step", F.to_json(F.struct(*_FIELDS)).alias("row")).groupBy("actor_id").transformWithStateInPandas(Correlator(idle), "alert string", "append", "eventTime")
    return found.select(F.from_json("alert", SCHEMA).alias("a")).select("a.*")
