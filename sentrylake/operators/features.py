"""Rolling-window features, scores, policies and gates as common table expressions.

``w`` has the window sums of every event over its actor's last 48; ``snap`` is the last row of each (actor, step);
``stepped`` gives every event the sums as they stand at the end of its step, which is what an anchor sees; ``anchors`` are the
risky e-mails and logins; ``flags`` their features; ``scored`` adds the weighted score of the first variant, its policy and
its gates. All windows are partitioned by actor and ordered alike, so that one exchange and one sort serve them all.
"""

from __future__ import annotations

#: Events of history that a feature sees.
WINDOW = 48

# Weights of the four variants. What policy sets after the score (unapproved partners) has no weight in it.
WEIGHTS = {
    "lsc": {"anchor_email": 2.0, "anchor_login": 2.0, "export_large": 2.0, "export_small": 1.0, "staging_export": 1.0, "after_hours": 1.0, "sens_burst": 1.0, "login_burst": 1.0, "email_burst": 1.0},
    "ce": {"anchor_email": 2.0, "anchor_login": 2.0, "export_large": 2.0, "export_small": 1.0, "staging_export": 1.5, "after_hours": 1.0, "sens_burst": 1.0, "login_burst": 1.0, "email_burst": 1.0,
           "exfil_chain": 3.5, "intent": 2.5, "plan": 2.0, "phishing": 2.0, "ai_text": 1.5, "violation": 2.5},
    "eg": {"anchor_email": 1.5, "anchor_login": 1.5, "export_large": 2.5, "export_small": 1.0, "staging_export": 2.0, "after_hours": 1.2, "sens_burst": 1.2, "login_burst": 1.0, "email_burst": 1.0,
           "exfil_chain": 4.0, "intent": 3.0, "plan": 2.5, "phishing": 2.5, "peer_dev": 2.0, "irreg": 1.5, "stealth_pattern": 3.0},
}
#: Features that come from other operators than the window sums.
CONTEXT = ("intent", "plan", "phishing", "ai_text", "violation", "peer_dev", "irreg")


def total(condition: str, frame: str = "w48") -> str:
    return f"cast(sum(case when {condition} then 1 else 0 end) over {frame} as bigint)"


_SENSITIVE = "event_type = 'db_query' and resource = 'patients_table'"
_OUTSIDE = "event_type = 'email_send' and lower(dst) like '%outside'"
_LARGE_MAIL = "event_type = 'email_send' and dst like '%outside' and attachment_kb > 200"
_EXPORT = "event_type = 'data_export' and resource = 'patients_table' and action = 'EXPORT'"
_STAGED = "event_type = 'data_export' and action in ('EXPORT_INTERNAL', 'EXPORT_STAGING')"
_LISTED = "coalesce(dst = approved_dst, false)"

_SUMS = {
    "n": "count(*) over w48",
    "logins": total("event_type = 'login'"),
    "queries": total("event_type = 'db_query'"),
    "sensitive": total(_SENSITIVE),
    "exports": total("event_type = 'data_export'"),
    "emails": total("event_type = 'email_send'"),
    "outside": total(_OUTSIDE),
    "outside_large": total(_LARGE_MAIL),
    "after_hours_n": total("after_hours"),
    "mails_over_500": total("event_type = 'email_send' and attachment_kb > 500"),
    "outside_unapproved": total(f"{_OUTSIDE} and not approved_partner"),
    "outside_unlisted": total(f"{_OUTSIDE} and not {_LISTED}"),
    "outside_neither": total(f"{_OUTSIDE} and not {_LISTED} and not approved_partner"),
    "approved_mails": total("event_type = 'email_send' and approved_partner"),
    "exports_without_ticket": total("event_type = 'data_export' and ticket_id is null"),
    "device_changes": total("device_change"),
    "cycles": total("cycle = 'partner_reporting'"),
    "tickets": total("ticket_id is not null"),
    "staged": total(_STAGED),
    "staged_patients": total(f"{_STAGED} and resource = 'patients_table'"),
    "moves_over_100k": total("event_type in ('db_query', 'data_export') and bytes > 100000"),
    "large_exports": total("event_type = 'data_export' and bytes > 100000"),
    "largest_export": f"max(case when {_EXPORT} then bytes end) over w48",
    "bytes_moved": "cast(coalesce(sum(case when event_type in ('db_query', 'data_export') then bytes end) over w48, 0) as bigint)",
    "bytes_most": "cast(coalesce(max(case when event_type in ('db_query', 'data_export') then bytes end) over w48, 0) as bigint)",
    "span": "max(step) over w48 - min(step) over w48",
    "chains": total(f"{_OUTSIDE} and t1 = 'data_export' and t2 = 'db_query' and r2 = 'patients_table' and step - s2 <= 5", "w46"),
    "sequences": total("event_type = 'email_send' and t1 = 'data_export' and t2 = 'db_query'", "w46"),
}
_ORDER = "partition by actor_id order by step, src_rank, event_id"

WINDOWS = f"""
lagged as (select *, lag(event_type, 1) over a as t1, lag(event_type, 2) over a as t2, lag(resource, 2) over a as r2, lag(step, 2) over a as s2,
    coalesce(lead(step, 1) over a <> step, true) as last_of_step
    from ordered window a as ({_ORDER})),
w as (select *, {", ".join(f"{v} as {k}" for k, v in _SUMS.items())},
    coalesce({_LARGE_MAIL}, false) as anchor_email, coalesce(event_type = 'login' and ((after_hours and role = 'admin') or takeover), false) as anchor_login
    from lagged
    window w48 as ({_ORDER} rows between 47 preceding and current row), w46 as ({_ORDER} rows between 45 preceding and current row))"""
FEATURES = f"""
snap as (select * from w where last_of_step),
stepped as (select event_id, ord, actor_id, step, label, phase, profile_role, allowed_after_hours, anchor_email, anchor_login, {", ".join(f"last_value({k}) over st as {k}" for k in _SUMS)}
    from w window st as (partition by actor_id, step order by src_rank, event_id rows between unbounded preceding and unbounded following)),
anchors as (select * from stepped where anchor_email or anchor_login),
flags as (select event_id, ord, actor_id, step, label, phase, profile_role as role, n, cycles, tickets, approved_mails, outside, outside_large, outside_neither, outside_unlisted, allowed_after_hours,
    case when anchor_email then 1.0e0 else 0.0e0 end as anchor_email, case when anchor_login then 1.0e0 else 0.0e0 end as anchor_login,
    case when logins >= 3 then 1.0e0 else 0.0e0 end as login_burst, case when sensitive >= 6 then 1.0e0 else 0.0e0 end as sens_burst,
    case when outside_large >= 3 then 1.0e0 else 0.0e0 end as email_burst, case when after_hours_n > 0 then 1.0e0 else 0.0e0 end as after_hours,
    case when largest_export >= 120000 then 1.0e0 else 0.0e0 end as export_large, case when largest_export < 120000 then 1.0e0 else 0.0e0 end as export_small,
    case when staged > 0 then 1.0e0 else 0.0e0 end as staging_export, case when chains > 0 then 1.0e0 else 0.0e0 end as exfil_chain,
    case when sensitive >= 1 and outside_large >= 1 and exports = 0 then 1.0e0 else 0.0e0 end as stealth_pattern,
    case when outside_neither > 0 then 1.0e0 else 0.0e0 end as unapproved
    from anchors)"""


def score(variant: str, without: tuple = ()) -> str:
    return " + ".join(f"{w}e0 * {f}" for f, w in WEIGHTS[variant].items() if f not in without)


_LATE = "after_hours = 1 and not allowed_after_hours"
#: (multiplier, offset) of each variant's policy, for ``(score + offset) * multiplier``.
POLICY = {
    "lsc": (f"(case when cycles > 0 then case when tickets > 0 then 0.70e0 else 0.85e0 end else 1.0e0 end) * (case when {_LATE} then 1.15e0 else 1.0e0 end)",
            f"(case when cycles > 0 then case when tickets > 0 then -0.60e0 else -0.30e0 end else 0.0e0 end) + (case when {_LATE} then 0.50e0 else 0.0e0 end)"),
    "ce": ("(case when cycles > 0 and tickets > 0 then 0.50e0 else 1.0e0 end)", "(case when cycles > 0 and tickets > 0 then -1.2e0 else 0.0e0 end)"),
    "eg": ("(case when cycles > 0 and tickets > 0 then case when approved_mails > 0 then 0.45e0 * 0.35e0 else 0.45e0 end else 1.0e0 end)",
           "(case when cycles > 0 and tickets > 0 then case when approved_mails > 0 then -2.5e0 else -1.5e0 end else 0.0e0 end)"),
    "egx": ("1.0e0", "1.5e0 * outside_unlisted"),
}
#: Anchors whose only reason is mail to approved partners: the first variant drops them.
SUPPRESSED = "(anchor_email = 1 and outside > 0 and outside_neither = 0 and anchor_login = 0)"

SCORED = f"""
scored as (select *, {score("lsc")} as score_base, {POLICY["lsc"][0]} as mult, {POLICY["lsc"][1]} as off,
    (unapproved = 1 or export_large = 1 or anchor_login = 1) as gate
    from flags where not {SUPPRESSED})"""

#: Evidence of the gated variants: (condition, weight).
EVIDENCE = (
    ("(export_large > 0 or staging_export > 0)", 1.5), ("unapproved > 0", 2.0), ("exfil_chain > 0", 2.5), ("intent > 0.4e0", 2.0), ("phishing > 0.5e0", 1.5), (_LATE, 1.0),
    ("(email_burst > 0 and unapproved > 0)", 1.5), ("(phishing > 0.3e0 and unapproved > 0)", 2.0), ("outside_large >= 2", 1.5), ("(stealth_pattern > 0 and unapproved > 0)", 2.5),
)
ITEMS = " + ".join(f"case when {c} then 1 else 0 end" for c, _ in EVIDENCE)
WEIGHT = " + ".join(f"case when {c} then {w}e0 else 0e0 end" for c, w in EVIDENCE)

#: Boosts that are added after policy and baseline.
BOOST = {"lsc": "0e0", "ce": "1.5e0 * intent + 1.2e0 * (phishing + violation)", "eg": "2.0e0 * intent + 1.5e0 * phishing"}
GATE = {"ce": "true", "eg": "(items >= 2 and weight >= 2.5e0)"}


def scored_with_context(variant: str) -> str:
    """``scored_{variant}``: flags with the columns of CONTEXT from the table expression ``context_{variant}`` (actor_id, step, ...)."""
    columns = ", ".join(f"coalesce(c.{x}, 0e0) as {x}" for x in CONTEXT)
    return f"""
both_{variant} as (select f.*, {columns} from flags f left join context_{variant} c on f.actor_id = c.actor_id and f.step = c.step),
weighed_{variant} as (select *, {ITEMS} as items, {WEIGHT} as weight from both_{variant}),
scored_{variant} as (select *, {score(variant)} as score_base, {POLICY[variant][0]} as mult, {POLICY[variant][1]} as off, {BOOST[variant]} as boost, {GATE[variant]} as gate from weighed_{variant})"""
