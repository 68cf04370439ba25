"""The fourth variant: goals that add up, plans counted by any of their first two actions, no baseline.

Rules and plans look for their actions as plain parts of a code. A goal's probability only grows by hits and shrinks by
contradictions, so everything but that one product and sum is windows in SQL; ``goals.accumulate`` does the rest. Anchors also
count logins from a changed device, and addresses that hold the outside domain anywhere. All windows are by actor.
"""

from __future__ import annotations

from ..operators.decisions import CONFIGS
from ..operators.features import EVIDENCE, ITEMS, POLICY, WEIGHT, score, total

# Rules (actions in order, goal, boost; half of it counts) and the plans' first two actions and lengths.
RULES = (
    (("db_query:patients_table", "data_export"), "data_theft", 0.4),
    (("data_export", "email_send:external"), "exfiltration", 0.5),
    (("db_query:sensitive", "db_query:sensitive", "db_query:sensitive"), "reconnaissance", 0.3),
    (("login:after_hours", "db_query:sensitive"), "data_theft", 0.35),
)
PLANS = {"exfil_direct": (("db_query:sensitive", "data_export"), 3), "exfil_staged": (("db_query:sensitive", "db_query:sensitive"), 4), "recon": (("login", "db_query"), 4)}
GOALS = ("data_theft", "exfiltration", "reconnaissance")
#: Thresholds of intent, plan and phishing; what they add to the score after policy.
TOLD, FOLLOWED, PHISHY, BOOST = 0.30, 0.4, 0.3, "2.0e0 * intent + 1.5e0 * phishing"

_parts = lambda wanted: ";" + "([^;]*;)*".join(f"[^;]*{w}[^;]*;" for w in wanted)
_boost = lambda goal: " + ".join(f"case when rule_{i} then {b / 2}e0 else 0e0 end" for i, (_, g, b) in enumerate(RULES) if g == goal)
_hold = lambda code, wanted: " or ".join(f"contains({code}, '{w}')" for w in dict.fromkeys(wanted))
_plan = lambda n: f"least(1e0, greatest({', '.join(f'cast({n}{p} as double) / {size}' for p, (_, size) in PLANS.items())}) * 0.8e0)"

_AWAY = "coalesce(lower(dst) like '%outside%', false)"
_MAILED = f"event_type = 'email_send' and {_AWAY}"
_LARGE = f"{_MAILED} and attachment_kb > 200"
_PATIENTS = "event_type = 'data_export' and resource = 'patients_table' and action = 'EXPORT'"
_SUMS = {
    "logins": total("event_type = 'login'"),
    "sensitive": total("event_type = 'db_query' and resource = 'patients_table'"),
    "exports": total("event_type = 'data_export'"),
    "outside_large": total(_LARGE),
    "outside_unlisted": total(f"{_MAILED} and not coalesce(dst = approved_dst, false)"),
    "after_hours_n": total("after_hours"),
    "largest_export": f"max(case when {_PATIENTS} then bytes end) over w48",
    "staged": total("event_type = 'data_export' and action in ('EXPORT_INTERNAL', 'EXPORT_STAGING')"),
    "chains": total(f"{_MAILED} and t1 = 'data_export' and t2 = 'db_query' and r2 = 'patients_table' and step - s2 <= 5", "w46"),
}
_ORDER = "partition by actor_id order by step, src_rank, event_id"
_flag = lambda condition: f"case when {condition} then 1e0 else 0e0 end"
#: Scores see no unapproved partner, peers or regularity: policy sets the first after them, and nothing the others.
_WITHOUT = ("peer_dev", "irreg", "ai_text", "violation")
_REASONS = "concat(repeat('unapproved_partner;', cast(outside_unlisted as int)), case when intent > 0 then 'tom;' else '' end, case when phishing > 0 then 'forensics;' else '' end)"


def blocks(code: str) -> list[str]:
    """Table expressions in order; ``goals_egx`` comes from ``goals.accumulate`` over ``boosted_egx``. code: the SQL of an action's code."""
    return [
        f"""
coded_egx as (select event_id, actor_id, step, src_rank, ord, last_of_step, coalesce({code}, '') as code, cast(case when event_type = 'data_export' and ticket_id is not null then 1 else 0 end as bigint) as contradictions from lagged),
hits_egx as (select *, {", ".join(f"@matches(codes, '{_parts(w)}') as rule_{i}" for i, (w, _, _) in enumerate(RULES))} from (select *, concat(';', @joined(code@j) over (partition by actor_id order by step, src_rank, event_id rows between 19 preceding and current row)@end, ';') as codes,
    {", ".join(f"cast(sum(case when {_hold('code', w)} then 1 else 0 end) over ({_ORDER} rows between unbounded preceding and current row) as bigint) as n_{p}" for p, (w, _) in PLANS.items())} from coded_egx) x),
boosted_egx as (select event_id, actor_id, step, ord, last_of_step, contradictions, {", ".join(f"{_boost(g)} as b_{g}" for g in GOALS)}, {", ".join(f"n_{p}" for p in PLANS)} from hits_egx)""",
        f"""
assessed_egx as (select *, greatest({", ".join(f"p_{g}" for g in GOALS)}) as intent, {_plan("n_")} as plan from goals_egx)""",
        f"""
windows_egx as (select *, {", ".join(f"{v} as {k}" for k, v in _SUMS.items())}, {_LARGE} as by_mail, coalesce(event_type = 'login' and ((after_hours and role = 'admin') or takeover or device_change), false) as by_login
    from lagged window w48 as ({_ORDER} rows between 47 preceding and current row), w46 as ({_ORDER} rows between 45 preceding and current row)),
anchors_egx as (select * from (select event_id, ord, actor_id, step, label, phase, profile_role, allowed_after_hours, coalesce(by_mail, false) as by_mail, by_login, {", ".join(f"last_value({k}) over st as {k}" for k in _SUMS)}
    from windows_egx window st as (partition by actor_id, step order by src_rank, event_id rows between unbounded preceding and unbounded following)) x where by_mail or by_login),
flags_egx as (select event_id, ord, actor_id, step, label, phase, profile_role as role, allowed_after_hours, outside_large, outside_unlisted, {_flag("by_mail")} as anchor_email, {_flag("by_login")} as anchor_login,
    {_flag("logins >= 4")} as login_burst, {_flag("sensitive >= 6")} as sens_burst, {_flag("outside_large >= 3")} as email_burst, {_flag("after_hours_n > 0")} as after_hours, {_flag("largest_export >= 120000")} as export_large,
    {_flag("largest_export < 120000")} as export_small, {_flag("staged > 0")} as staging_export, {_flag("chains > 0")} as exfil_chain, {_flag("sensitive >= 1 and outside_large >= 1 and exports = 0")} as stealth_pattern,
    {_flag("outside_unlisted > 0")} as unapproved from anchors_egx)""",
        f"""
phished_egx as (select event_id, cast(sum(cast(round(phishing_trained * 3) as bigint)) over p as double) / (3 * count(*) over p) as phishing from style window p as (partition by actor_id order by step, event_id rows between 9 preceding and current row)),
known_egx as (select actor_id, step, phishing from (select o.actor_id, o.step, o.last_of_step, @known(m.phishing@k) over (partition by o.actor_id order by o.step, o.src_rank, o.event_id rows between unbounded preceding and current row) as phishing
    from lagged o left join phished_egx m on o.event_id = m.event_id) x where last_of_step)""",
        f"""
told_egx as (select f.*, {", ".join(f"case when {x} > {least}e0 then {x} else 0e0 end as {y}" for x, least, y in (("a.intent", TOLD, "intent"), ("a.plan", FOLLOWED, "plan"), ("k.phishing", PHISHY, "phishing")))}
    from flags_egx f join (select * from assessed_egx where last_of_step) a on a.actor_id = f.actor_id and a.step = f.step left join known_egx k on k.actor_id = f.actor_id and k.step = f.step),
scored_egx as (select *, {score("eg", _WITHOUT)} as score_base, {POLICY["egx"][0]} as mult, {POLICY["egx"][1]} as off, {BOOST} as boost, items >= 2 and weight >= 2.5e0 as gate, {_REASONS} as reasons
    from (select *, {ITEMS} as items, {WEIGHT} as weight from told_egx) x)""",
    ]


#: As ``folds.alerts`` takes it: no baseline.
SOURCE = f"select *, actor_id as fold_key, {CONFIGS['egx'].confirmed}e0 as confirmed_at, 0e0 as baseline_on, 1e0 as trust_on, '' as config, 0 as run from scored_egx"

_ALERTS = "select a.event_id, a.actor_id, a.step, a.label, a.phase, round(a.score, 9) as score, round(a.threshold, 9) as threshold, round(a.trust, 9) as trust, s.reasons, s.items, s.weight from alerts_egx a join scored_egx s on a.event_id = s.event_id where a.tier = "
QUERIES = {
    "abductive_rule_hits_egx": f"select event_id, actor_id, step, {', '.join(f'rule_{i}' for i in range(len(RULES)))} from hits_egx",
    "goal_probability_egx": f"select event_id, actor_id, step, {', '.join(f'p_{g}' for g in GOALS)} from goals_egx",
    "plan_tracking_egx": f"select event_id, actor_id, step, {', '.join(f'cast(n_{p} as double) / {size} as {p}' for p, (_, size) in PLANS.items())}, {_plan('n_')} as confidence from hits_egx",
    "threat_assessment_egx": "select event_id, actor_id, step, intent, plan, greatest(intent, plan) as combined from assessed_egx",
    "scored_anchors_egx": "select event_id, actor_id, step, role, anchor_email, anchor_login, login_burst, sens_burst, email_burst, after_hours, export_large, export_small, staging_export, exfil_chain, stealth_pattern, unapproved, outside_large, intent, plan, phishing, round(score_base, 9) as score_base, off, round(boost, 9) as boost, items, weight, gate, reasons from scored_egx",
    "early_alerts_egx": _ALERTS + "'early'",
    "confirmed_alerts_egx": _ALERTS + "'confirmed'",
    # alerts against the truth: actors count as found by alerts on malicious anchors, false alerts one by one
    "evaluation_egx": """, bad as (select actor_id, min(step) as first_step from security_events where phase = 'test' and label = 'malicious' group by actor_id),
        said as (select a.actor_id, a.step, a.label = 'malicious' as right_one, s.intent > 0 as told from alerts_egx a join scored_egx s on a.event_id = s.event_id where a.tier = 'confirmed' and a.phase = 'test'),
        found as (select b.actor_id, f.first_alert - b.first_step as ttd from bad b join (select actor_id, min(step) as first_alert from said where right_one group by actor_id) f on f.actor_id = b.actor_id),
        sums as (select conf_total, conf_tp, conf_total - conf_tp as conf_fp, told as tom_detections, actors_detected, actors_total, ttd_sum, ttd_max
            from (select count(*) as conf_total, coalesce(cast(sum(case when right_one then 1 else 0 end) as bigint), 0) as conf_tp, coalesce(cast(sum(case when told then 1 else 0 end) as bigint), 0) as told from said) x
            cross join (select count(*) as actors_detected, cast(sum(ttd) as bigint) as ttd_sum, coalesce(max(ttd), 0) as ttd_max from found) y cross join (select count(*) as actors_total from bad) z)
        select conf_total, conf_fp, case when conf_total > 0 then cast(conf_tp as double) / conf_total else 0e0 end as conf_precision, actors_detected, actors_total, tom_detections,
            case when actors_detected + conf_fp > 0 then cast(actors_detected as double) / (actors_detected + conf_fp) else 0e0 end as mixed_precision, case when actors_total > 0 then cast(actors_detected as double) / actors_total else 0e0 end as actor_recall,
            case when actors_detected > 0 then 2e0 * actors_detected / (actors_detected + conf_fp + actors_total) else 0e0 end as mixed_f1, case when actors_detected > 0 then cast(ttd_sum as double) / actors_detected else 0e0 end as ttd_avg, ttd_max from sums""",
}

# -- the same, written apart for DuckDB ------------------------------------------------------------------------------------

_after = lambda first, then: f"len(list_filter(codes[list_position(list_transform(codes, lambda c: contains(c, '{first}')), true) + 1:], lambda c: contains(c, '{then}'))) > 0 and len(list_filter(codes, lambda c: contains(c, '{first}'))) > 0"
_IN_ORDER = [_after(*w) if len(w) == 2 else f"len(list_filter(codes, lambda c: contains(c, '{w[0]}'))) >= {len(w)}" for w, _, _ in RULES]
_rise = lambda goal: " + ".join(f"{b / 2}e0 * h.rule_{i}::int" for i, (_, g, b) in enumerate(RULES) if g == goal)

#: Codes, goals by recursion, and what an anchor sees by joins. ``ordered`` and ``style`` come before.
APART = f"""
named as (select *, lower(coalesce(dst, '')) like '%outside%' as away, event_type || coalesce(':' || resource, '') || case event_type when 'email_send' then if(dst like '%outside', ':external', ':internal') when 'login' then if(after_hours, ':after_hours', '') || if(device_change, ':new_device', '')
    when 'data_export' then if(coalesce(destination = 'internal_staging', false) or coalesce(action like '%INTERNAL%', false), ':internal', '') else '' end as code from ordered),
last_codes as (select event_id, actor_id, step, ord, event_type = 'data_export' and ticket_id is not null as against, list(code) over (partition by actor_id order by ord rows between 19 preceding and current row) as codes,
    {", ".join(f"count(*) filter ({_hold('code', w)}) over (partition by actor_id order by ord) as n_{p}" for p, (w, _) in PLANS.items())} from named),
hits_egx as (select *, {", ".join(f"{h} as rule_{i}" for i, h in enumerate(_IN_ORDER))} from last_codes),
grown(actor_id, ord, {", ".join(f"p_{g}" for g in GOALS)}) as (
    select distinct actor_id, 0::bigint, {", ".join("0e0" for _ in GOALS)} from ordered
    union all
    select h.actor_id, h.ord, {", ".join(f"least(1e0, if(h.against, g.p_{g} * 0.85e0, g.p_{g}) + ({_rise(g)}))" for g in GOALS)} from grown g join hits_egx h on h.actor_id = g.actor_id and h.ord = g.ord + 1),
goals_egx as (select h.*, g.* exclude (actor_id, ord) from hits_egx h join grown g on g.actor_id = h.actor_id and g.ord = h.ord),
assessed_egx as (select *, greatest({", ".join(f"p_{g}" for g in GOALS)}) as intent, {_plan("n_")} as plan from goals_egx),
risky_egx as (select *, coalesce(event_type = 'email_send', false) as mail from named where (event_type = 'email_send' and away and attachment_kb > 200) or (event_type = 'login' and (takeover or device_change or (after_hours and role = 'admin')))),
ends_egx as (select a.event_id as anchor, max(o.ord) as last from risky_egx a join named o on o.actor_id = a.actor_id and o.step = a.step group by 1),
seen_egx as (select e.anchor, e.last, o.* from ends_egx e join risky_egx a on a.event_id = e.anchor join named o on o.actor_id = a.actor_id and o.ord > e.last - 48 and o.ord <= e.last),
chained_egx as (select distinct x.anchor from seen_egx x join seen_egx y on y.anchor = x.anchor and y.ord = x.ord + 1 join seen_egx z on z.anchor = x.anchor and z.ord = x.ord + 2
    where x.event_type = 'db_query' and x.resource = 'patients_table' and y.event_type = 'data_export' and z.event_type = 'email_send' and z.away and z.step - x.step <= 5),
sums_egx as (select anchor, max(last) as last, count(*) filter (event_type = 'login') as logins, count(*) filter (event_type = 'db_query' and resource = 'patients_table') as reads, count(*) filter (event_type = 'data_export') as exports,
    count(*) filter (event_type = 'email_send' and away and attachment_kb > 200) as outside_large, count(*) filter (event_type = 'email_send' and away and dst is distinct from approved_dst) as outside_unlisted, bool_or(after_hours) as late,
    max(bytes) filter ({_PATIENTS}) as most, coalesce(bool_or(event_type = 'data_export' and action in ('EXPORT_INTERNAL', 'EXPORT_STAGING')), false) as staged from seen_egx group by anchor),
written_egx as (select actor_id, step, round(phishing_trained * 3) as hits, row_number() over (partition by actor_id order by step, event_id) as nth from style),
sent_egx as (select a.event_id, max(m.nth) as upto from risky_egx a join written_egx m on m.actor_id = a.actor_id and m.step <= a.step group by 1),
mean_egx as (select s.event_id, sum(m.hits) / (3 * count(*)) as mean from sent_egx s join risky_egx a on a.event_id = s.event_id join written_egx m on m.actor_id = a.actor_id and m.nth <= s.upto and m.nth > s.upto - 10 group by 1),
plain_egx as (select a.event_id, a.ord, a.actor_id, a.step, a.label, a.phase, a.profile_role as role, a.mail, s.* exclude (anchor, last), c.anchor is not null as chained, s.late and not a.allowed_after_hours as odd, s.reads > 0 and s.outside_large > 0 and s.exports = 0 as stealth,
    if(g.intent > 0.3, g.intent, 0) as intent, if(g.plan > 0.4, g.plan, 0) as plan, if(m.mean > 0.3, m.mean, 0) as phishing
    from risky_egx a join sums_egx s on s.anchor = a.event_id left join chained_egx c on c.anchor = a.event_id join assessed_egx g on g.actor_id = a.actor_id and g.ord = s.last left join mean_egx m on m.event_id = a.event_id),
evidence_egx as (select *, [{", ".join(f"struct_pack(holds := coalesce({c}, false), w := {w})" for c, w in zip((
    "most >= 120000 or staged", "outside_unlisted > 0", "chained", "intent > 0.4", "phishing > 0.5", "odd", "outside_large >= 3 and outside_unlisted > 0", "phishing > 0.3 and outside_unlisted > 0", "outside_large >= 2", "stealth and outside_unlisted > 0"), (w for _, w in EVIDENCE)))}] as facts from plain_egx),
scored_egx as (select event_id, ord, actor_id, step, label, phase, role, if(mail, 1e0, 0e0) as anchor_email, if(mail, 0e0, 1e0) as anchor_login, if(logins > 3, 1e0, 0e0) as login_burst, if(reads > 5, 1e0, 0e0) as sens_burst, if(outside_large > 2, 1e0, 0e0) as email_burst, if(late, 1e0, 0e0) as after_hours,
    if(most >= 120000, 1e0, 0e0) as export_large, if(most < 120000, 1e0, 0e0) as export_small, if(staged, 1e0, 0e0) as staging_export, if(chained, 1e0, 0e0) as exfil_chain, if(stealth, 1e0, 0e0) as stealth_pattern, if(outside_unlisted > 0, 1e0, 0e0) as unapproved, outside_large, outside_unlisted, intent::double as intent, plan::double as plan, phishing::double as phishing,
    (1.5 + if(most >= 120000, 2.5, 0) + if(most < 120000, 1, 0) + if(staged, 2, 0) + if(late, 1.2, 0) + if(reads > 5, 1.2, 0) + if(logins > 3, 1, 0) + if(outside_large > 2, 1, 0) + if(chained, 4, 0) + if(stealth, 3, 0))::double + 3 * intent + 2.5 * plan + 2.5 * phishing as score_base,
    1e0 as mult, 1.5e0 * outside_unlisted as off, 2 * intent + 1.5 * phishing as boost, len(list_filter(facts, lambda f: f.holds)) as items, coalesce(list_sum(list_transform(list_filter(facts, lambda f: f.holds), lambda f: f.w)), 0)::double as weight, items > 1 and weight >= 2.5 as gate,
    repeat('unapproved_partner;', outside_unlisted) || if(intent > 0, 'tom;', '') || if(phishing > 0, 'forensics;', '') as reasons from evidence_egx)"""
