"""Queries of the engine by name, each with the SQL that both Spark and DuckDB run over the same tables.

A query is written once; ``@``-marked words stand for functions that the two dialects name differently.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bayes
from ..functions.dialect import translate
from ..operators import decisions, goals, perplexity, samples
from ..operators.features import CONTEXT, FEATURES, POLICY, SCORED, SUPPRESSED, WINDOWS, score, scored_with_context
from ..session import ship, written
from ..sources.events import actor_ctes, event_rows
from ..streaming import streams
from . import additive, corpus, extended, folds, oracles, training

TABLES = ("events", "documents", "labels")

# Word lists of the text variants.
PHISHING = {
    "ce": ("urgent", "immediately", "verify", "suspend", "account", "password", "click here", "confirm", "expire", "limited time", "act now", "winner", "congratulations", "free", "prize"),
    "eg": ("urgent", "immediately", "verify", "suspend", "password", "click here", "confirm", "expire", "act now"),
    "trained": ("urgent", "verify", "password", "click here", "confirm", "expire", "act now", "immediately", "confidential", "suspended", "unauthorized", "security alert", "account", "bank", "credit card"),
}
SENSITIVE = {
    "ce": ("confidential", "secret", "private", "ssn", "social security", "credit card", "password", "patient", "medical", "financial", "proprietary", "trade secret", "classified"),
    "eg": ("confidential", "secret", "private", "patient", "medical", "financial"),
    "trained": ("confidential", "secret", "private", "patient", "ssn", "password", "credential", "classified"),
}
URGENT = {"ce": ("urgent", "immediately", "asap", "now", "quickly", "hurry"), "eg": ("urgent", "immediately", "asap", "now"), "trained": ("urgent", "immediately", "asap", "now", "deadline", "critical"), "egx": ("urgent", "immediately", "asap", "now", "deadline")}
ATTACHMENT = ("attached", "attachment", "enclosed", "see attached", ".xls", ".doc", ".pdf")
VIOLATIONS = ("do not share", "internal only", "not for distribution", "delete after reading")

SUBJECTS = (
    "URGENT: verify your password immediately or we suspend the account. ", "Act now! Click here to confirm before it will expire!!! ",
    "For internal only use, not for distribution. ", "SALE NOW!!! BIG PRIZE for the winner. ", "See https://files.example.org/a and write to desk@example.org. ",
    "Minutes of the weekly meeting. ", "Schedule for next month. ", "Notes on the new printer. ",
)


def _hits(words, text="lower(content)") -> str:
    return "(" + " + ".join(f"case when {text} like '%{w}%' then 1 else 0 end" for w in words) + ")"


_SUBJECT = "case variant " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(SUBJECTS)) + " end"
#: Texts are measured once for each document and subject that mails have together. A mail whose document is missing, or has no text, is its subject.
_MEASURES = f"""@size(@words(content@w)) as n_words, @size(@distinct(@words(content@w))) as n_distinct, @lengths(content@l) as lengths, length(content) as n_chars, length(trim(content)) as n_solid,
    {", ".join(f"least(1e0, {_hits(PHISHING[v])} / {n}e0) as phishing_{v}" for v, n in (("ce", 5), ("eg", 4), ("trained", 3)))},
    {", ".join(f"least(1e0, {_hits(URGENT[v])} / {n}e0) as urgency_{v}" for v, n in (("ce", 3), ("eg", 2), ("trained", 2), ("egx", 2)))},
    {", ".join(f"{_hits(SENSITIVE[v])} as sensitive_{v}" for v in ("ce", "eg", "trained"))}, {_hits(VIOLATIONS)} as violations, {_hits(ATTACHMENT)} as attachments"""
SENT = """sent as (select event_id, step, actor_id, dst, attachment_kb, src_rank, k % 8 as variant, event_id % (select max(doc_id) + 1 from documents) as doc_key from security_events where event_type = 'email_send')"""
TEXTS = f"""texts as (select p.doc_key, p.variant, concat({_SUBJECT}, coalesce(d.text, '')) as content from (select @spread distinct doc_key, variant from sent) p left join documents d on d.doc_id = p.doc_key)"""
MAILS = """mails as (select e.event_id, e.step, e.actor_id, e.dst, e.attachment_kb, e.src_rank, t.content from sent e join texts t on t.doc_key = e.doc_key and t.variant = e.variant)"""
MEASURED = f"""measured as (select *, @size(lengths) as n_sentences, @sum(lengths, x@x) as n_tokens, @sum(lengths, x * x@x) as n_squares from (select doc_key, variant, {_MEASURES} from texts) x)"""
STYLE = """style as (select e.event_id, e.step, e.actor_id, e.dst, e.attachment_kb, e.src_rank, m.* from sent e join (select doc_key as m_key, variant as m_variant, * from measured) m on m_key = e.doc_key and m_variant = e.variant)"""
#: Of each mail: sentence length and richness, the sender's mails before it, and the means of the last ten of those that have them.
AUTHORS = """
authors as (select *, count(*) over p as earlier, @known(len_10@k) over p as len_before, @known(rich_10@k) over p as rich_before from (
    select event_id, step, actor_id, attachment_kb, n_chars, n_words, n_sentences, len, rich,
        case when len is not null then avg(len) over (partition by actor_id, len is null order by step, event_id rows between 9 preceding and current row) end as len_10,
        case when rich is not null then avg(rich) over (partition by actor_id, rich is null order by step, event_id rows between 9 preceding and current row) end as rich_10
    from (select *, case when n_sentences > 0 then cast(n_tokens as double) / n_sentences end as len, case when n_words > 0 then cast(n_distinct as double) / n_words end as rich from style) x) y
    window p as (partition by actor_id order by step, event_id rows between unbounded preceding and 1 preceding)),
habits as (select *, case when earlier < 3 or n_sentences = 0 then 0e0 else (coalesce(abs(len - len_before) / greatest(len_before, 1e0), 0e0) + coalesce(abs(coalesce(rich, 0e0) - rich_before) / greatest(rich_before, 0.1e0), 0e0)) / 2 end as deviation from authors)"""

_IDS = "event_id, actor_id, step"
CODE = """concat(event_type, case when resource is not null then concat(':', resource) else '' end,
        case when event_type = 'email_send' then case when dst like '%outside' then ':external' else ':internal' end else '' end,
        case when event_type = 'login' and after_hours then ':after_hours' else '' end, case when event_type = 'login' and device_change then ':new_device' else '' end,
        case when event_type = 'data_export' and (destination = 'internal_staging' or action like '%INTERNAL%') then ':internal' else '' end)"""
_snap = lambda cols: f"select actor_id, step, {cols} from snap"
_ratio = lambda a, b: f"cast({a} as double) / greatest(1, {b})"

QUERIES = {
    # scans, dimensions, order
    "scan_event_log": "select event_id, step, actor_id, event_type, resource, action, dst, bytes, attachment_kb, label, phase from security_events",
    "upsert_user_profile": "select actor_id, role, allowed_after_hours, approved_dst from profile",
    "monitor_route": "select event_id, actor_id, step, case when event_type in ('db_query', 'data_export') then 'db' when event_type = 'email_send' then 'email' else 'auth' end as source, label from security_events",
    "ingest_order": "select event_id, actor_id, step, src_rank, ord from ordered",
    # projections and predicates
    "phase_tag": "select event_id, step, case when step >= 60 then 'test' else 'train' end as phase from security_events",
    "test_phase_filter": "select e.event_id, e.phase from security_events e cross join (select max(case when phase = 'test' then 1 else 0 end) as has_test from security_events) t where e.phase = 'test' or t.has_test = 0",
    "work_hours": "select event_id, step % 24 as hour, not (step % 24 between 8 and 17) as after_hours, (step % 24 < 7 or step % 24 > 19) as odd_hours from security_events",
    "is_external": "select event_id, dst, coalesce(lower(dst) like '%outside', false) as ends_outside, coalesce(lower(dst) like '%outside%', false) as holds_outside from security_events",
    "email_anchor": f"select {_IDS}, dst, attachment_kb from security_events where event_type = 'email_send' and dst like '%outside' and attachment_kb > 200",
    "login_anchor": f"select {_IDS}, role, takeover, device_change, (after_hours and role = 'admin') or takeover as anchor from security_events where event_type = 'login' and ((after_hours and role = 'admin') or takeover or device_change)",
    "encode_action": f"""select {_IDS}, {CODE} as code from security_events""",
    "contradiction_flags": "select event_id, ticket_id is not null as has_ticket, approved_partner, coalesce(cycle = 'partner_reporting', false) as scheduled_cycle, not after_hours as work_hours, event_type = 'data_export' and ticket_id is not null as approved_export from security_events",
    # rolling windows
    "rolling_history": _snap("n, ord"),
    "login_burst": _snap("logins, case when logins >= 3 then 1 else 0 end as login_burst, case when logins >= 4 then 1 else 0 end as login_burst_egx"),
    "sens_read_burst": _snap("sensitive, case when sensitive >= 6 then 1 else 0 end as sens_read_burst"),
    "email_burst": _snap("outside_large as ext_email_count, case when outside_large >= 3 then 1 else 0 end as email_burst"),
    "after_hours_any": _snap("case when after_hours_n > 0 then 1 else 0 end as after_hours"),
    "export_size_flags": _snap("case when largest_export >= 120000 then 1 else 0 end as export_large, case when largest_export < 120000 then 1 else 0 end as export_small"),
    "staging_export": _snap("case when staged > 0 then 1 else 0 end as staging_export, case when staged_patients > 0 then 1 else 0 end as staging_export_lsc"),
    "exfil_chain_tight": _snap("case when chains > 0 then 1 else 0 end as exfil_chain"),
    "stealth_pattern": _snap("case when sensitive >= 1 and outside_large >= 1 and exports = 0 then 1 else 0 end as stealth_pattern"),
    "rich_counts": _snap("logins, queries, sensitive, exports, outside, after_hours_n"),
    "rich_ratios": _snap(f"{_ratio('sensitive', 'queries')} as sensitive_share, {_ratio('exports', 'queries')} as export_share, {_ratio('outside', 'emails')} as outside_share, {_ratio('after_hours_n', 'n')} as after_hours_share"),
    "rich_bytes": _snap("bytes_moved / 10000e0 as bytes_total, bytes_most / 10000e0 as bytes_max, cast(bytes_moved as double) / greatest(1, queries + exports) / 1000e0 as bytes_mean, moves_over_100k"),
    "rich_email": _snap("mails_over_500, outside_unapproved"),
    "read_export_email_seq": _snap("case when sequences > 0 then 1 else 0 end as sequence"),
    "event_density": _snap("cast(n as double) / greatest(1, span) as density"),
    "ticket_device_context": _snap("exports_without_ticket, device_changes"),
    "distinct_in_window": extended.LISTS + "select actor_id, step, @size(@distinct(resources)) as resources, @size(@distinct(dsts)) as dsts from lists",
    "rich_velocity": extended.LISTS + f"select actor_id, step, {extended.VELOCITY} from lists",
    "export_regularity": """select actor_id, step, event_id, n_gaps, case when n_gaps < 3 then 0.5e0 else 1 - least(sd / (mean + 0.1e0) / 1.5e0, 1e0) end as regularity from (
        select *, count(gap) over f as n_gaps, avg(cast(gap as double)) over f as mean, stddev_pop(cast(gap as double)) over f as sd from (
            select event_id, actor_id, step, ord, step - lag(step) over (partition by actor_id order by ord) as gap from ordered where event_type = 'data_export') x
        window f as (partition by actor_id order by ord rows between 48 preceding and current row)) y""",
    # scores, policies, gates
    "weighted_score": f"select event_id, {score('lsc')} as lsc, {score('ce', CONTEXT)} as ce, {score('eg', CONTEXT)} as eg from flags",
    "policy_cycle_discount": "select event_id, " + ", ".join(f"{m} as mult_{v}, {o} as off_{v}" for v, (m, o) in POLICY.items() if v != "lsc") + """,
        case when cycles > 0 then case when tickets > 0 then 0.70e0 else 0.85e0 end else 1e0 end as mult, case when cycles > 0 then case when tickets > 0 then -0.60e0 else -0.30e0 end else 0e0 end as off from flags""",
    "partner_allowlist": "select event_id, outside, outside_neither, outside_unlisted, cast(unapproved as int) as unapproved, case when outside > 0 and unapproved = 0 then 0 else cast(anchor_email as int) end as anchor_email from flags",
    "after_hours_policy": "select event_id, case when after_hours = 1 and not allowed_after_hours then 1.15e0 else 1e0 end as mult, case when after_hours = 1 and not allowed_after_hours then 0.5e0 else 0e0 end as off from flags",
    "anchor_suppression": f"select event_id from flags where not {SUPPRESSED}",
    "confirmed_threshold": "select actor_id, 4e0 + 1.2e0 * (0.70e0 - 0.5e0) as base, 4e0 + 1.2e0 * (0.70e0 - 0.5e0) + case role when 'analyst' then 0.8e0 when 'admin' then 1.2e0 else 0e0 end as with_role from profile",
    "scored_anchors": "select event_id, ord, actor_id, step, role, label, phase, login_burst, sens_burst, email_burst, after_hours, export_large, export_small, staging_export, cycles, score_base, mult, off, gate from scored",
    "confirmed_gate": "select event_id, gate from scored",
    "policy_score": "select event_id, actor_id, step, (score_base + off) * mult as score from scored",
    "evidence_gate": "select event_id, items, weight, gate as passes from scored_eg",
    "scored_ce": "select * from scored_ce",
    "scored_eg": "select * from scored_eg",
    "intent_forensics_boost": "select event_id, 'ce' as variant, boost from scored_ce union all select event_id, 'eg' as variant, boost from scored_eg",
    # beliefs
    "belief_update": """select actor_id, step, event_id, role, case when h = 0 then null else least(1e0, 0.5e0 + 0.1e0 * (h - 1)) end as works_after_hours, case when s = 0 then null else least(1e0, 0.3e0 + 0.05e0 * (s - 1)) end as accesses_sensitive_data from (
        select *, sum(case when after_hours then 1 else 0 end) over f as h, sum(case when resource = 'patients_table' then 1 else 0 end) over f as s from ordered
        window f as (partition by actor_id order by ord rows between unbounded preceding and current row)) x""",
    "belief_decay": "select event_id, pow(0.99e0, max(step) over (partition by actor_id) - step) as confidence from security_events",
    # text
    "tokenize_words_sentences": "select event_id, n_words, n_distinct, n_sentences from style",
    "phishing_keywords": "select event_id, phishing_ce as ce, phishing_eg as eg, phishing_trained as trained from style",
    "urgency_level": "select event_id, urgency_ce as ce, urgency_eg as eg, urgency_trained as trained, urgency_egx as egx from style",
    "sensitive_content": "select event_id, sensitive_ce as n_ce, sensitive_ce > 0 as ce, sensitive_eg > 0 as eg, sensitive_trained > 0 as trained from style",
    "policy_violation_phrases": "select event_id, violations as n_violations from style",
    "spam_indicators": "select event_id, length(content) - length(replace(content, '!', '')) + @upper_words(content@u) as indicators from mails",
    "entity_counts": r"select event_id, @count(content, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z|]{2,}'@c) as addresses, @count(content, 'https?://[^ \n\r\t]+'@c) as urls from mails",
    "attachment_risk": "select event_id, case when attachment_kb > 500 then least(1e0, attachment_kb / 5000e0) else 0e0 end as attachment_risk from mails",
    "empty_text_defaults": "select doc_id, case when coalesce(length(text), 0) < 20 then 50e0 end as perplexity, case when coalesce(length(text), 0) < 20 then 0.5e0 end as burstiness from documents",
    "style_metrics": "select event_id, n_words, n_sentences, cast(n_tokens as double) / n_sentences as avg_sentence_length, cast(n_distinct as double) / n_words as vocabulary_richness from style where n_solid >= 20 and n_words >= 30 and n_sentences > 0",
    "style_anomaly": """select event_id, case when n_words > 0 and n_sentences > 0 then least(1e0, (abs(cast(n_tokens as double) / n_sentences - 14.60e0) / 5 + abs(cast(n_distinct as double) / n_words - 0.633e0) / 0.15e0) / 3) else 0e0 end as style_anomaly from style""",
    "authorship_consistency": "select event_id, actor_id, case when n_chars < 20 then 1e0 else 1 - least(1e0, deviation) end as consistency from habits",
    # the trained variants take nothing from texts without a word
    "authorship_consistency_trained": "select event_id, actor_id, case when n_words = 0 then 1e0 else 1 - least(1e0, deviation) end as consistency from habits",
    "author_profile": """select event_id, actor_id, cast(count(*) over (partition by actor_id order by step, event_id) as bigint) as mails, least(50, count(len) over (partition by actor_id order by step, event_id)) as lengths, least(50, count(rich) over (partition by actor_id order by step, event_id)) as richnesses,
        case when len is not null then round(avg(len) over (partition by actor_id, len is null order by step, event_id rows between 49 preceding and current row), 9) end as avg_length,
        case when rich is not null then round(avg(rich) over (partition by actor_id, rich is null order by step, event_id rows between 49 preceding and current row), 9) end as avg_richness from authors""",
    # headers of several recipients: any one outside the internal domain counts
    "external_recipient": """select event_id, max(case when address like '%@%' and address not like '%@org%' then 1 else 0 end) = 1 as external from (
        select event_id, @explode(@split(case when event_id % 3 = 0 then concat('desk@org,', dst) when event_id % 3 = 1 then concat(dst, ', pool@org') else 'pool@org' end, ','@p)) as address from security_events where event_type = 'email_send') x group by event_id""",
    "attachment_mention": "select event_id, attachments > 0 as mentions from style",
    # evaluation
    "actor_truth": "select actor_id, max(case when label = 'malicious' then 1 else 0 end) as malicious, min(case when label = 'malicious' then step end) as first_step from security_events where phase = 'test' group by actor_id",
    "event_type_counts": "select event_type, phase, count(*) as n from security_events group by event_type, phase",
    "step_metrics": "select step, n, malicious, cast(sum(n) over (order by step) as bigint) as log_size from (select step, count(*) as n, cast(sum(case when label = 'malicious' then 1 else 0 end) as bigint) as malicious from security_events group by step) x",
    **oracles.EVALUATION,
    **corpus.QUERIES,
}

QUERIES |= extended.QUERIES
_hit = lambda wanted: ";" + "([^;]*;)*".join(w.partition(":")[0] + "[^;]*" + (w.partition(":")[2] + "[^;]*" if ":" in w else "") + ";" for w in wanted)
QUERIES["abductive_rule_hits"] = QUERIES["abductive_rule_hits"].format(joined="@joined(coalesce(code, '')@j) over (partition by actor_id order by ord rows between 19 preceding and current row)@end",
    hits=", ".join(f"@matches(codes, '{_hit(w)}') as rule_{i}" for i, (w, _, _) in enumerate(goals.RULES)))
QUERIES["coded"] = "select * from coded"
QUERIES["_alerts"] = "select event_id, actor_id, step, tier, label, score, threshold, trust from alerts_lsc"
QUERIES["_alert_counts"] = "select tier, count(*) as n, count(distinct concat(cast(actor_id as varchar(20)), ':', cast(step as varchar(20)))) as distinct_alerts from alerts_lsc group by tier"
QUERIES["anomaly_samples"], QUERIES["anomaly_samples_eg"] = samples.weighted(), samples.weighted(2, False)
QUERIES["confirmed_alerts_online"] = "select event_id, actor_id, step, label, phase, round(score, 9) as score, threshold, trust, verdict from alerts_online where tier = 'confirmed'"
QUERIES["early_alerts_online"] = "select event_id, actor_id, step, label, phase, round(score, 9) as score, threshold, trust, verdict from alerts_online where tier = 'early'"
QUERIES["online_weights"] = "select round, " + ", ".join(f"round(w{i}, 9) as {k}" for i, k in enumerate(decisions.FIRST_WEIGHTS)) + " from weights_online"
QUERIES["_sender_words"] = "select event_id, actor_id, @explode(@words(content@w)) as word from mails"
QUERIES["_vocabulary_exact"] = "select actor_id, count(distinct word) as words, true as near, true as merges from (select actor_id, @explode(@words(content@w)) as word from mails) x group by actor_id union all select null, count(distinct word), true, true from (select @explode(@words(content@w)) as word from texts) y"
#: One pass over events and alerts: counts by kind and each of type, phase, label and all of them.
QUERIES["activity_counts"] = """select kind, event_type, phase, label, grouping(event_type) as any_type, grouping(phase) as any_phase, grouping(label) as any_label, count(*) as n from (
    select 'event' as kind, event_type, phase, label from security_events union all select 'alert' as kind, tier as event_type, phase, label from alerts_lsc) x
    group by grouping sets ((kind, event_type), (kind, phase), (kind, label), (kind, event_type, phase, label), (kind))"""
QUERIES |= additive.QUERIES
QUERIES["_online_rows"] = "select * from online_rows"
#: Queries that only serve others, or as SQL of a query that Spark answers otherwise.
HELPERS = ("_alerts", "_sender_words", "_vocabulary_exact", "_alert_counts", "_online_rows", "coded", "sweep_rows", "scored_ce", "scored_eg")

_VARIANTS = ("ce", "eg")
_CODED = "coded as (select o.event_id, o.actor_id, o.step, o.ord, x.code, o.last_of_step, cast(case when o.ticket_id is not null then 1 else 0 end + case when o.approved_partner then 1 else 0 end + case when o.cycle = 'partner_reporting' then 1 else 0 end + case when o.after_hours then 0 else 1 end as bigint) as contradictions from lagged o join codes x on o.event_id = x.event_id)"


def context(variant: str) -> str:
    """What other operators say of an actor at the end of each step, for the scores of a variant; from ``intents_{variant}``."""
    rest = {
        "ce": "case when i.intent > 0.4e0 then i.intent else 0e0 end as intent, case when i.completion > 0.5e0 then i.completion else 0e0 end as plan, case when k.ph > 0.5e0 then k.ph else 0e0 end as phishing, "
              "case when k.ai > 0.5e0 then k.ai else 0e0 end as ai_text, case when k.vi > 0 then least(1e0, k.vi / 3e0) else 0e0 end as violation, 0e0 as peer_dev, 0e0 as irreg",
        "eg": "case when i.intent > 0.30e0 then i.intent else 0e0 end as intent, case when i.completion > 0.4e0 then i.completion else 0e0 end as plan, case when k.ph > 0.4e0 then k.ph else 0e0 end as phishing, "
              "0e0 as ai_text, 0e0 as violation, coalesce(q.deviation, 0e0) as peer_dev, case when k.regularity < 0.3e0 then 1 - k.regularity else 0e0 end as irreg",
    }[variant]
    peers = ("", "") if variant == "ce" else (", peers_eg as (select distinct actor_id, step, deviation from (" + extended.DEVIATION + ") x)", " left join peers_eg q on k.actor_id = q.actor_id and k.step = q.step")
    return f"""
    means_{variant} as (select event_id, avg(phishing_{variant}) over p as ph, avg(ai_{variant}) over p as ai, cast(sum(violations) over p as bigint) as vi from judged window p as (partition by actor_id order by step, event_id rows between 9 preceding and current row)),
    regular_{variant} as ({QUERIES["export_regularity"]}){peers[0]},
    known_{variant} as (select * from (select actor_id, step, last_of_step, @known(ph@k) over a as ph, @known(ai@k) over a as ai, @known(vi@k) over a as vi, @known(regularity@k) over a as regularity from (
        select o.actor_id, o.step, o.src_rank, o.event_id, o.last_of_step, m.ph, m.ai, m.vi, g.regularity from lagged o left join means_{variant} m on o.event_id = m.event_id left join regular_{variant} g on o.event_id = g.event_id) x
        window a as (partition by actor_id order by step, src_rank, event_id rows between unbounded preceding and current row)) y where last_of_step),
    context_{variant} as (select k.actor_id, k.step, {rest} from known_{variant} k left join intents_{variant} i on k.actor_id = i.actor_id and k.step = i.step{peers[1]})""" + "," + scored_with_context(variant)


#: Table expressions in order; each text may define several. What is worked out by Python in Spark is SQL for DuckDB only.
BLOCKS = [
    WINDOWS, FEATURES, SCORED, oracles.SWEEP, SENT, TEXTS, MAILS, MEASURED, STYLE, AUTHORS, corpus.COUNTED, extended.PEERS, extended.PERPLEXITY, bayes.probabilities(), extended.JUDGED, "codes as (" + QUERIES["encode_action"] + ")", _CODED,
    *(folds.goals(v) for v in _VARIANTS), *(f"intents_{v} as (select actor_id, step, intent, completion from goals_{v} where last_of_step)" for v in _VARIANTS), *(context(v) for v in _VARIANTS),
    "online_rows as (select *, 0e0 as boost, actor_id as fold_key, '' as model, '' as config, 0 as run, 4e0 as confirmed_at from scored)",
    *additive.blocks(CODE), folds.alerts("egx", "egx", additive.SOURCE),
    *(folds.alerts(v, v) for v in ("lsc", *_VARIANTS)), folds.learning("online", "select * from online_rows"),
    folds.alerts("plain", "lsc", "select * from sweep_rows where online = 0"), folds.learning("learning", "select * from sweep_rows where online = 1"),
    *(f"{x}_sweep as (select * from {x}_plain union all select * from {x}_learning)" for x in ("decided", "alerts")),
]
#: What a query of several uses is worked out once and written, in Spark.
WRITTEN = ("w", "measured", "judged")
_DEFINES = re.compile(r"(?:^|,\s*)([a-z_0-9]+)(?:\([^()]*\))? as \(", re.M)
_READS = re.compile(r"\b(?:from|join)\s+([a-z_0-9]+)")


def _defined(block: str) -> set[str]:
    return {name for name in _DEFINES.findall(block.strip()) if name not in ("window",)}


def _needed(body: str, given: set[str]) -> list[str]:
    """The blocks that a query's text reads, and those that they read in turn, in order; not those of names that are given."""
    owner = {name: i for i, b in reversed(list(enumerate(BLOCKS))) for name in _defined(b)}
    # what a text defines itself goes before the blocks' names
    given = given | (_defined(body.strip().lstrip(",")) if body.strip().startswith(",") else set())
    found: set[int] = set()
    todo = [body]
    while todo:
        for name in _READS.findall(todo.pop()):
            i = owner.get(name)
            if i is not None and name not in given and i not in found:
                found.add(i)
                todo.append(BLOCKS[i])
    return [BLOCKS[i] for i in sorted(found)]


def text(name: str, dialect: str, given: dict[str, str] | None = None) -> str:
    """The whole SQL of a query, with no more table expressions than it needs. given: views that stand for table expressions."""
    return _text(QUERIES[name], dialect, given or {})


def _text(body: str, dialect: str, given: dict[str, str]) -> str:
    blocks = _needed(body, set(given))
    whole = " ".join([body, *blocks])
    parts = [event_rows(dialect)]
    if any(re.search(rf"\b(?:from|join)\s+{t}\b", whole) for t in ("profile", "ordered")):
        parts.append(actor_ctes())
    parts += [f"{n} as (select * from {v})" for n, v in given.items() if re.search(rf"\b(?:from|join)\s+{n}\b", whole)]
    parts += [_without(b, given) for b in blocks]
    # a text that starts with a comma adds table expressions
    sql = ("with " if dialect == "spark" else "with recursive ") + ",".join(p for p in (x.strip().strip(",") for x in parts) if p) + " " + body
    return translate(sql, dialect)


def _without(block: str, given: dict[str, str]) -> str:
    """A block less the expressions at its top level that are given."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(block):
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        elif not quoted and c == "," and depth == 0:
            out.append(block[start:i])
            start = i + 1
    out.append(block[start:])
    return ",".join(x for x in out if x.strip() and x.strip().split("(")[0].split(" ")[0] not in given)


class _Session:
    """One query's work in Spark: views of the tables, of what Python works out, and of what is written for several uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.given = spark, sf_dir, {}
        for t in TABLES:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def sql(self, body: str) -> DataFrame:
        self.prepare(body)
        return self.plain(body)

    def plain(self, body: str) -> DataFrame:
        return self.spark.sql(_text(body, "spark", self.given).replace("{partitions}", self.spark.conf.get("spark.sql.shuffle.partitions")))

    def give(self, name: str, df: DataFrame) -> None:
        view = f"{name}_{uuid.uuid4().hex}"
        df.createOrReplaceTempView(view)
        self.given[name] = view

    def prepare(self, body: str) -> None:
        """Works out what the text reads and Spark's SQL can't, or shouldn't more than once."""
        reads = self.reads(body)
        if "perplexities" in reads and "perplexities" not in self.given:
            subjects = self.spark.createDataFrame(list(enumerate(SUBJECTS)), "variant int, subject string")
            documents = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
            self.give("perplexities", written(perplexity.perplexities(self.plain("select event_id, step, doc_key, variant from sent"), documents, subjects), "perplexities"))
            reads = self.reads(body)
        heavy = any(f"{x}_{v}" in reads for x in ("goals", "scored", "alerts", "decided") for v in _VARIANTS) or "judged" in reads or len(re.findall(r"\b(?:from|join)\s+snap\b", body)) > 1 or any(f"{x}_{n}" in reads for x in ("alerts", "decided", "weights") for n in ("online", "sweep"))
        if heavy:
            for name in WRITTEN:
                if name in reads and name not in self.given:
                    self.give(name, written(self.plain(f"select * from {name}"), name))
        for v in _VARIANTS:
            if f"goals_{v}" in self.reads(body) and f"goals_{v}" not in self.given:
                self.give(f"goals_{v}", written(goals.infer(self.plain("select * from coded"), v), f"goals-{v}"))
        if "goals_egx" in self.reads(body) and "goals_egx" not in self.given:
            self.give("goals_egx", written(goals.accumulate(self.plain("select * from boosted_egx"), additive.GOALS), "goals-egx"))
        if "scored_egx" in self.reads(body) and "scored_egx" not in self.given and "alerts_egx" in self.reads(body):
            self.give("scored_egx", written(self.plain("select * from scored_egx"), "scored-egx"))
        for n in ("lsc", *_VARIANTS, "egx"):
            if {f"alerts_{n}", f"decided_{n}"} & self.reads(body) and f"decided_{n}" not in self.given:
                config = decisions.CONFIGS[n]
                self._decide(n, decisions.decide(self.sql("select * from scored" if n == "lsc" else f"select * from scored_{n}"), config), config)
        if {"alerts_online", "decided_online", "weights_online"} & self.reads(body) and "decided_online" not in self.given:
            decided, weights = decisions.learn(self.sql("select * from online_rows"), decisions.CONFIGS["lsc"])
            self._decide("online", decided, decisions.CONFIGS["lsc"])
            keys = list(decisions.FIRST_WEIGHTS)
            self.give("weights_online", weights.groupBy("round").pivot("key", keys).agg(F.first("weight")).select("round", *(F.col(k).alias(f"w{i}") for i, k in enumerate(keys))))
        if {"alerts_sweep", "decided_sweep"} & self.reads(body) and "decided_sweep" not in self.given:
            self._decide("sweep", sweep(self.sql("select * from sweep_rows")), decisions.CONFIGS["lsc"])

    def _decide(self, n: str, decided: DataFrame, config) -> None:
        decided = written(decided, f"decided-{n}")
        self.give(f"decided_{n}", decided)
        self.give(f"alerts_{n}", decisions.fired(decided, config))

    def reads(self, body: str) -> set[str]:
        """Names that a text reads, itself or by what it needs."""
        return set(_READS.findall(" ".join([body, *_needed(body, set(self.given))])))


def sweep(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Decisions of all points of a sweep: plain folds, and rounds where the weights learn."""
    rows = rows.withColumn("confirmed", F.col("confirmed_at")).withColumn("use_baseline", F.col("baseline_on") > 0).withColumn("use_trust", F.col("trust_on") > 0)
    by = ("config", "confirmed_at", "run")
    plain = decisions.decide(rows.filter("online = 0"), by=by)
    return plain.unionByName(decisions.learn(rows.filter("online = 1"), by=by)[0])


def _run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return _Session(spark, sf_dir).sql(QUERIES[name])


def _query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _run(spark, sf_dir, name)

    run.__name__ = name
    return run


def _shipped(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    run.__name__ = f.__name__
    return run


def queries():
    found = {name: _query(name) for name in QUERIES if name not in HELPERS}
    return found | {name: _shipped(f) for name, f in (training.QUERIES | streams.QUERIES).items()}


def _apart(body: str) -> str:
    """DuckDB SQL of a query of the fourth variant, over the expressions that are written apart."""
    names = _defined(additive.APART)
    fold = folds.alerts("egx", "egx", additive.SOURCE) if "alerts_egx" in _READS.findall(body) else ""
    texts = [x for x in _needed("select * from style", set()) if not _defined(x) & names]
    parts = [event_rows("duckdb"), actor_ctes(), *texts, translate(additive.APART, "duckdb"), fold]
    return translate("with recursive " + ",".join(x.strip().strip(",") for x in parts if x) + " " + body, "duckdb")


def oracle_sql() -> dict[str, str]:
    found = {name: oracles.INDEPENDENT.get(name) or text(name, "duckdb") for name in QUERIES if name not in HELPERS}
    found |= {name: "with recursive " + (event_rows("duckdb") + "," + actor_ctes()).strip() + oracles.REFERENCE + sql for name, sql in oracles.APART.items()}
    found["sink_event_log"] = found["scan_event_log"].replace("select event_id, step, actor_id, event_type, resource, action, dst, bytes, attachment_kb, label, phase", "select step, event_type, actor_id, resource, action, dst, bytes, label, phase")
    found["sink_sweep_csv"] = found["sweep_summary"]
    # streams give what the batch queries give
    found["stream_ingest"] = found["monitor_route"]
    found["stream_correlate"] = text("_alerts", "duckdb")
    found["vocabulary_sketches"] = text("_vocabulary_exact", "duckdb")
    # the grid that Spark doesn't make
    found["anomaly_samples"], found["anomaly_samples_eg"] = _text(samples.by_grid(), "duckdb", {}), _text(samples.by_grid(2, False), "duckdb", {})
    found["stream_alert_sink"] = text("_alert_counts", "duckdb")
    found |= {name: _apart(QUERIES[name]) for name in additive.QUERIES}
    mails = ",".join(x.strip() for x in (event_rows("duckdb"), SENT, TEXTS))
    found |= {name: translate(f"with {mails}, {sql}", "duckdb") for name, sql in corpus.APART.items()}
    return found | training.ORACLE_SQL | streams.ORACLE_SQL
