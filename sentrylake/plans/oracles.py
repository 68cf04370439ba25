"""Evaluation of fired alerts, and SQL written apart from the queries that it checks."""

from __future__ import annotations

from ..operators.features import POLICY, SUPPRESSED, score

_TRUTH = "select actor_id, max(case when label = 'malicious' then 1 else 0 end) as m, min(case when label = 'malicious' then step end) as first_step from security_events where phase = 'test' group by actor_id"
_RATES = """case when tp + fp > 0 then cast(tp as double) / (tp + fp) else 0e0 end as actor_precision, case when tp + fn > 0 then cast(tp as double) / (tp + fn) else 0e0 end as actor_recall,
        case when tp > 0 then 2e0 * tp / (2 * tp + fp + fn) else 0e0 end as actor_f1"""
_COUNTS = "cast(sum(m * d) as bigint) as tp, cast(sum((1 - m) * d) as bigint) as fp, cast(sum(m * (1 - d)) as bigint) as fn, cast(sum((1 - m) * (1 - d)) as bigint) as tn"
_CONFIRMED = "select actor_id, min(step) as first_alert from alerts_lsc where tier = 'confirmed' and phase = 'test' group by actor_id"

#: Configurations of the sweep (policy, baseline, trust, learning) and thresholds: fixed values. Runs are fifths of the actors.
CONFIGURATIONS = (("rules_only", 0, 0, 0, 0), ("policy", 1, 0, 0, 0), ("policy+baseline", 1, 1, 0, 0), ("policy+baseline+trust", 1, 1, 1, 0), ("full_no_ml", 1, 1, 1, 1))
_GRID = " union all ".join(f"select '{c}' as config, {p} as use_policy, {b}e0 as baseline_on, {t}e0 as trust_on, {o} as online, {x}e0 as confirmed_at" for c, p, b, t, o in CONFIGURATIONS for x in range(3, 8))
SWEEP = f"""
grid as ({_GRID}),
sweep_rows as (select concat(g.config, ':', cast(cast(g.confirmed_at as int) as varchar(9)), ':', cast(f.actor_id as varchar(20))) as fold_key, g.config, g.confirmed_at, g.baseline_on, g.trust_on, g.online, concat(g.config, ':', cast(cast(g.confirmed_at as int) as varchar(9)), ':', cast(f.actor_id % 5 as varchar(9))) as model, cast(f.actor_id % 5 as int) as run, 0e0 as boost,
    f.event_id, f.ord, f.actor_id, f.step, f.label, f.phase, f.role, f.cycles, f.login_burst, f.sens_burst, f.email_burst, f.after_hours, f.export_large, f.export_small, f.staging_export, f.anchor_email, f.anchor_login, g.use_policy * f.unapproved as unapproved, {score("lsc")} as score_base,
    case when g.use_policy = 1 then {POLICY["lsc"][0]} else 1e0 end as mult, case when g.use_policy = 1 then {POLICY["lsc"][1]} else 0e0 end as off,
    (g.use_policy = 1 and f.unapproved = 1) or export_large = 1 or anchor_login = 1 as gate
    from flags f cross join grid g where not (g.use_policy = 1 and {SUPPRESSED}))"""
_RUNS = f""", truth as (select *, cast(actor_id % 5 as int) as run from ({_TRUTH}) x),
    points as (select distinct config, confirmed_at from ({_GRID}) x),
    found as (select config, confirmed_at, actor_id, min(step) as first_alert from alerts_sweep where tier = 'confirmed' and phase = 'test' group by config, confirmed_at, actor_id),
    actors as (select p.config, p.confirmed_at, t.run, t.m, case when f.actor_id is null then 0 else 1 end as d, case when t.m = 1 then f.first_alert - t.first_step end as ttd
        from truth t cross join points p left join found f on f.config = p.config and f.confirmed_at = p.confirmed_at and f.actor_id = t.actor_id),
    by_actor as (select config, confirmed_at, run, {_COUNTS}, count(*) as actors_total, avg(cast(ttd as double)) as ttd_avg, max(ttd) as ttd_max from actors group by config, confirmed_at, run),
    by_alert as (select config, confirmed_at, run, cast(sum(case when tier = 'early' then 1 else 0 end) as bigint) as early_total, cast(sum(case when tier = 'early' and label <> 'malicious' then 1 else 0 end) as bigint) as early_fp,
        cast(sum(case when tier = 'confirmed' then 1 else 0 end) as bigint) as conf_total, cast(sum(case when tier = 'confirmed' and label <> 'malicious' then 1 else 0 end) as bigint) as conf_fp from alerts_sweep where phase = 'test' group by config, confirmed_at, run),
    metrics as (select a.config, a.confirmed_at, a.run, {_RATES}, ttd_avg, ttd_max, actors_total, coalesce(early_total, 0) as early_total, coalesce(early_fp, 0) as early_fp, coalesce(conf_total, 0) as conf_total, coalesce(conf_fp, 0) as conf_fp,
        case when early_total > 0 then cast(early_total - early_fp as double) / early_total else 0e0 end as early_precision, case when conf_total > 0 then cast(conf_total - conf_fp as double) / conf_total else 0e0 end as conf_precision
        from by_actor a left join by_alert b on a.config = b.config and a.confirmed_at = b.confirmed_at and a.run = b.run)
    """
_METRICS = ("actor_precision", "actor_recall", "actor_f1", "ttd_avg", "ttd_max", "early_precision", "early_total", "early_fp", "conf_precision", "conf_total", "conf_fp", "actors_total")

# sums of numbers with a fixed point don't depend on the order of adding
_fixed = lambda m: f"cast({m} as decimal(18, 9))"
_mean = lambda m: f"round(cast(sum({_fixed(m)}) as double) / count({m}), 9)"
_deviation = lambda m: f"round(sqrt(greatest(0e0, cast(sum(cast({_fixed(m)} * {_fixed(m)} as decimal(38, 18))) as double) / count({m}) - pow(cast(sum({_fixed(m)}) as double) / count({m}), 2))), 6)"

def evaluation(variant: str, dated: bool) -> str:
    """One row of what a variant's alerts of the test phase are worth: by actor, by alert, and time to detection. dated: pairs with a step of 0 don't count."""
    kept = "first_alert <> 0 and first_step <> 0" if dated else "true"
    tally = lambda tier, what: f"cast(coalesce(sum(case when tier = '{tier}' and {what} then 1 else 0 end), 0) as bigint)"
    return f""", bad as (select actor_id, min(step) as first_step from security_events where phase = 'test' and label = 'malicious' group by actor_id),
        said as (select * from alerts_{variant} where phase = 'test'),
        named as (select actor_id, min(step) as first_alert from said where tier = 'confirmed' group by actor_id),
        pairs as (select n.actor_id, b.first_step, n.first_alert from named n left join bad b on b.actor_id = n.actor_id),
        intents as (select g.actor_id, g.step, max(g.intent) as intent from goals_{variant} g where g.last_of_step group by g.actor_id, g.step),
        assisted as (select count(*) as n from said a join intents i on i.actor_id = a.actor_id and i.step = a.step where a.tier = 'confirmed' and i.intent > 0),
        by_actor as (select count(*) as alerted, count(first_step) as detected, cast(coalesce(sum(case when {kept} then first_alert - first_step end), 0) as bigint) as ttd_sum, count(case when {kept} then first_step end) as ttd_n, coalesce(max(case when {kept} then first_alert - first_step end), 0) as ttd_max from pairs),
        by_alert as (select {tally("confirmed", "true")} as conf_total, {tally("confirmed", "label <> 'malicious'")} as conf_fp, {tally("early", "true")} as early_total, {tally("early", "label <> 'malicious'")} as early_fp from said)
        select case when alerted > 0 then cast(detected as double) / alerted else 0e0 end as actor_precision, case when total > 0 then cast(detected as double) / total else 0e0 end as actor_recall, case when detected > 0 then 2e0 * detected / (alerted + total) else 0e0 end as actor_f1,
            case when ttd_n > 0 then cast(ttd_sum as double) / ttd_n else 0e0 end as ttd_avg, ttd_max, conf_total, conf_fp, case when conf_total > 0 then cast(conf_total - conf_fp as double) / conf_total else 0e0 end as conf_precision,
            early_total, early_fp, case when early_total > 0 then cast(early_total - early_fp as double) / early_total else 0e0 end as early_precision, total as actors_total, detected as actors_detected, s.n as tom_detected
        from by_actor cross join by_alert cross join assisted s cross join (select count(*) as total from bad) b"""


EVALUATION = {
    "evaluation_ce": evaluation("ce", False),
    "evaluation_eg": evaluation("eg", True),
    "sweep_rows": "select * from sweep_rows",
    # alerts and the states that they come from
    **{f"{tier}_alerts{'' if v == 'lsc' else '_' + v}": f"select event_id, actor_id, step, label, phase, score, threshold, trust, verdict from alerts_{v} where tier = '{tier}'" for tier in ("early", "confirmed") for v in ("lsc", "ce", "eg")},
    "ewma_baseline": "select event_id, actor_id, step, base from decided_lsc",
    "trust_update": "select event_id, actor_id, step, trust, threshold from decided_lsc",
    "alert_cooldown": "select event_id, actor_id, step, early, confirmed from decided_lsc",
    "analyst_verdict": "select event_id, actor_id, step, verdict from alerts_lsc where tier = 'confirmed'",
    "alert_payload": """select a.event_id, a.actor_id, a.step, a.tier, a.score, a.threshold, a.trust, s.score_base, s.mult, s.off, s.gate, 48 as history, case when s.anchor_email = 1 then 'email' else 'login' end as anchor,
        s.login_burst, s.sens_burst, s.email_burst, s.after_hours, s.export_large, s.export_small, s.staging_export, s.unapproved from alerts_lsc a join scored s on a.event_id = s.event_id""",
    "threat_assessment": "select event_id, actor_id, step, goal, intent, plan, completion from goals_ce",
    "threat_assessment_eg": "select event_id, actor_id, step, goal, intent, plan, completion from goals_eg",
    "goal_probability": "select event_id, actor_id, step, p_data_theft, p_exfiltration, p_staging, p_reconnaissance from goals_ce union all select event_id, actor_id, -step as step, p_data_theft, p_exfiltration, p_staging, p_reconnaissance from goals_eg",
    "plan_tracking": "select event_id, actor_id, step, plan, completion from goals_eg",
    "cognitive_features": "select actor_id, step, intent, completion, p_data_theft, p_exfiltration, p_staging, p_reconnaissance from goals_ce where last_of_step",
    "tom_feature_gate": """select 'ce' as variant, event_id, case when intent > 0.4e0 then intent else 0e0 end as intent, case when completion > 0.5e0 then completion else 0e0 end as completion from goals_ce
        union all select 'eg' as variant, event_id, case when intent > 0.30e0 then intent else 0e0 end as intent, case when completion > 0.4e0 then completion else 0e0 end as completion from goals_eg""",
    # fired alerts against the truth
    "actor_confusion": f"""select tp, fp, fn, tn, {_RATES} from (select {_COUNTS} from (
        select t.m, case when a.actor_id is null then 0 else 1 end as d from ({_TRUTH}) t left join ({_CONFIRMED}) a on t.actor_id = a.actor_id) x) y""",
    "time_to_detection": f"select a.actor_id, a.first_alert - t.first_step as ttd from ({_CONFIRMED}) a join ({_TRUTH}) t on a.actor_id = t.actor_id where t.m = 1",
    "time_to_detection_summary": f"select count(*) as detected, avg(cast(a.first_alert - t.first_step as double)) as ttd_avg, max(a.first_alert - t.first_step) as ttd_max from ({_CONFIRMED}) a join ({_TRUTH}) t on a.actor_id = t.actor_id where t.m = 1",
    "alert_precision": "select tier, count(*) as total, cast(sum(case when label = 'malicious' then 1 else 0 end) as bigint) as tp, cast(sum(case when label = 'malicious' then 0 else 1 end) as bigint) as fp, avg(case when label = 'malicious' then 1e0 else 0e0 end) as alert_precision from alerts_lsc where phase = 'test' group by tier",
    "alert_type_counts": "select tier, phase, label, count(*) as n from alerts_lsc group by tier, phase, label",
    "step_alerts": """select e.step, case when e.step >= 60 then 'test' else 'train' end as phase, e.malicious, coalesce(a.alerts, 0) as alerts from (select step, cast(sum(case when label = 'malicious' then 1 else 0 end) as bigint) as malicious from security_events group by step) e
        left join (select step, count(*) as alerts from alerts_lsc group by step) a on e.step = a.step""",
    "detected_actor_set": f"select a.actor_id from ({_CONFIRMED}) a join ({_TRUTH}) t on a.actor_id = t.actor_id where t.m = 1",
    "mixed_precision_eval": """select detected, false_alerts, cast(detected as double) / greatest(1, detected + false_alerts) as mixed_precision from (
        select count(distinct case when label = 'malicious' then actor_id end) as detected, count(case when label <> 'malicious' then 1 end) as false_alerts from alerts_eg where tier = 'confirmed' and phase = 'test') x""",
    "intent_assisted_count": "select count(*) as alerts, cast(sum(case when g.intent > 0 then 1 else 0 end) as bigint) as assisted from alerts_ce a join (select actor_id, step, intent from goals_ce where last_of_step) g on a.actor_id = g.actor_id and a.step = g.step where a.tier = 'confirmed'",
    "config_grid": "select config, confirmed_at as threshold, run, tier, count(*) as alerts, cast(sum(case when label = 'malicious' then 1 else 0 end) as bigint) as tp from alerts_sweep where phase = 'test' group by config, confirmed_at, run, tier",
    "sweep_summary": _RUNS + "select config, confirmed_at as threshold, " + ", ".join(f"{_mean(m)} as {m}" for m in _METRICS) + " from metrics group by config, confirmed_at",
    "run_average": _RUNS + "select config, " + ", ".join(f"{_mean(m)} as {m}, {_deviation(m)} as {m}_std" for m in _METRICS[:3]) + ", count(*) as runs from metrics where confirmed_at = 4 group by config",
}

#: What each anchor sees, gathered by a join instead of windows: all rows of its actor's last 48 up to the end of its step.
REFERENCE = """,
risky as (select * from ordered where (event_type = 'email_send' and dst like '%outside' and attachment_kb > 200) or (event_type = 'login' and (takeover or (after_hours and role = 'admin')))),
ends as (select a.event_id as anchor, max(o.ord) as last from risky a join ordered o on o.actor_id = a.actor_id and o.step = a.step group by 1),
seen as (select e.anchor, o.* from ends e join risky a on a.event_id = e.anchor join ordered o on o.actor_id = a.actor_id and o.ord > e.last - 48 and o.ord <= e.last),
sent_outside as (select *, ends_with(lower(dst), 'outside') as leaves, coalesce(dst = approved_dst, false) as listed from seen where event_type = 'email_send')
"""
APART = {
    "policy_cycle_discount": """select anchor as event_id, case when cycle and ticket then 0.5 else 1 end as mult_ce, case when cycle and ticket then -1.2 else 0 end as off_ce,
        case when not (cycle and ticket) then 1 when approved then 0.1575 else 0.45 end as mult_eg, case when not (cycle and ticket) then 0 when approved then -2.5 else -1.5 end as off_eg,
        1.0 as mult_egx, 1.5 * coalesce(unlisted, 0) as off_egx, case when not cycle then 1 when ticket then 0.7 else 0.85 end as mult, case when not cycle then 0 when ticket then -0.6 else -0.3 end as off
        from (select anchor, bool_or(coalesce(cycle, '') = 'partner_reporting') as cycle, bool_or(ticket_id is not null) as ticket, bool_or(event_type = 'email_send' and approved_partner) as approved from seen group by 1) s
        left join (select anchor, count(*) as unlisted from sent_outside where leaves and not listed group by 1) u using (anchor)""",
    "partner_allowlist": """select a.event_id, count(x.anchor) as outside, count(case when not (x.listed or x.approved_partner) then 1 end) as outside_neither, count(case when not x.listed then 1 end) as outside_unlisted,
        max(case when x.listed or x.approved_partner or x.anchor is null then 0 else 1 end) as unapproved,
        case when count(x.anchor) > 0 and bool_and(x.listed or x.approved_partner) then 0 when a.event_type = 'email_send' then 1 else 0 end as anchor_email
        from risky a left join (select * from sent_outside where leaves) x on x.anchor = a.event_id group by a.event_id, a.event_type""",
    "weighted_score": """, f as (select a.event_id, case when a.event_type = 'login' then 0 else 1 end as mail, count(case when s.event_type = 'login' then 1 end) as logins, count(case when s.event_type = 'db_query' and s.resource = 'patients_table' then 1 end) as reads,
            count(case when s.event_type = 'email_send' and s.dst like '%outside' and s.attachment_kb > 200 then 1 end) as large, bool_or(s.after_hours) as late, count(case when s.event_type = 'data_export' then 1 end) as exports,
            max(case when s.event_type = 'data_export' and s.resource = 'patients_table' and s.action = 'EXPORT' then s.bytes end) as most, bool_or(s.event_type = 'data_export' and s.action in ('EXPORT_INTERNAL', 'EXPORT_STAGING')) as staged
            from risky a join seen s on s.anchor = a.event_id group by all),
        chain as (select distinct x.anchor from seen x join seen y on y.anchor = x.anchor and y.ord = x.ord + 1 join seen z on z.anchor = x.anchor and z.ord = x.ord + 2
            where x.event_type = 'db_query' and x.resource = 'patients_table' and y.event_type = 'data_export' and z.event_type = 'email_send' and z.dst like '%outside' and z.step - x.step <= 5),
        g as (select f.*, most >= 120000 as big, most < 120000 as small, chain.anchor is not null as chained from f left join chain on chain.anchor = f.event_id)
        select event_id, 2.0 + 2 * coalesce(big, false)::int + coalesce(small, false)::int + staged::int + late::int + (reads >= 6)::int + (logins >= 3)::int + (large >= 3)::int as lsc,
            2.0 + 2 * coalesce(big, false)::int + coalesce(small, false)::int + 1.5 * staged::int + late::int + (reads >= 6)::int + (logins >= 3)::int + (large >= 3)::int + 3.5 * chained::int as ce,
            1.5 + 2.5 * coalesce(big, false)::int + coalesce(small, false)::int + 2 * staged::int + 1.2 * late::int + 1.2 * (reads >= 6)::int + (logins >= 3)::int + (large >= 3)::int + 4 * chained::int + 3 * (reads > 0 and large > 0 and exports = 0)::int as eg from g""",
}
INDEPENDENT: dict[str, str] = {}
