"""More queries in the shared SQL: peer comparison, vectors, running word statistics.

A text that starts with a comma adds table expressions to the common ones.
"""

#: The last 48 events of each actor at the end of each step, as lists.
LISTS = """, lists as (select * from (select actor_id, step, last_of_step, count(*) over w48 as n, @list(resource) over w48 as resources, @list(dst) over w48 as dsts,
        @list(case when event_type = 'login' then 1 else 0 end) over w48 as logins, @list(case when event_type = 'db_query' and resource = 'patients_table' then 1 else 0 end) over w48 as reads
        from lagged window w48 as (partition by actor_id order by step, src_rank, event_id rows between 47 preceding and current row)) x where last_of_step)
    """
_HALF = "cast(floor(n / 2) as int)"
_moved = lambda x: f"cast(coalesce(@head({x}, 1, cast(n as int)@h), 0) - 2 * coalesce(@head({x}, 1, {_HALF}@h), 0) as double) / greatest(1, {_HALF})"
#: Logins and reads of the later half of the window less those of the earlier.
VELOCITY = f"{_moved('logins')} as login_velocity, {_moved('reads')} as sensitive_velocity"

# what an actor's window adds to the sums of its role, so that running sums hold every peer's latest window
PEERS = """moved as (select profile_role, step, cast(sum(exports - before) as bigint) as d1, cast(sum(exports * exports - before * before) as bigint) as d2 from (
            select profile_role, step, exports, coalesce(lag(exports) over (partition by actor_id order by step), 0) as before from snap) x group by profile_role, step),
        sums as (select profile_role, step, cast(sum(d1) over (partition by profile_role order by step) as bigint) as s1, cast(sum(d2) over (partition by profile_role order by step) as bigint) as s2 from moved),
        peers as (select role, count(*) - 1 as m from profile group by role),
        spread as (select a.event_id, a.actor_id, a.step, a.exports, p.m, cast(s.s1 - a.exports as double) / greatest(1, p.m) as mean,
            sqrt(cast(p.m * (s.s2 - a.exports * a.exports) - (s.s1 - a.exports) * (s.s1 - a.exports) as double)) / greatest(1, p.m) as sd
            from anchors a join sums s on a.profile_role = s.profile_role and a.step = s.step join peers p on a.profile_role = p.role)"""
DEVIATION = "select event_id, actor_id, step, case when m >= 3 then greatest(0e0, (exports - mean) / (sd + 0.1e0) - 2) else 0e0 end as deviation from spread"

#: Deviation of the sentences' lengths over their mean (one word at least), of two sentences or more.
SPREAD = "sqrt(cast(n_sentences * n_squares - n_tokens * n_tokens as double)) / n_sentences"
BURST = f"case when n_sentences < 2 then 0.5e0 else least(1e0, {SPREAD} / greatest(1e0, cast(n_tokens as double) / n_sentences) / 1.5e0) end"
_VARIATION = f"({SPREAD} / (cast(n_tokens as double) / n_sentences + 0.1e0))"

_SHORT = """logins, queries, sensitive, exports, outside, after_hours_n, cast(sensitive as double) / greatest(1, queries) as sensitive_share, cast(exports as double) / greatest(1, queries) as export_share,
        cast(outside as double) / greatest(1, emails) as outside_share, cast(after_hours_n as double) / greatest(1, n) as after_hours_share"""

QUERIES = {
    "feature_vector": LISTS + f"""select s.actor_id, s.step, s.logins, s.queries, s.sensitive, s.exports, s.outside, s.after_hours_n,
        cast(s.sensitive as double) / greatest(1, s.queries) as sensitive_share, cast(s.exports as double) / greatest(1, s.queries) as export_share,
        cast(s.outside as double) / greatest(1, s.emails) as outside_share, cast(s.after_hours_n as double) / greatest(1, s.n) as after_hours_share,
        s.bytes_moved / 10000e0 as bytes_total, s.bytes_most / 10000e0 as bytes_max, cast(s.bytes_moved as double) / greatest(1, s.queries + s.exports) / 1000e0 as bytes_mean, s.moves_over_100k,
        s.mails_over_500, s.outside_unapproved, case when s.sequences > 0 then 1 else 0 end as sequence, cast(s.n as double) / greatest(1, s.span) as density,
        s.exports_without_ticket, s.device_changes, d.resources, d.dsts, d.login_velocity, d.sensitive_velocity
        from snap s join (select actor_id, step, @size(@distinct(resources)) as resources, @size(@distinct(dsts)) as dsts, {VELOCITY} from lists) d on s.actor_id = d.actor_id and s.step = d.step""",
    # the shorter vectors of the second and the third variant; the second's last seven are zero by its rule
    "feature_vector_20": f"select actor_id, step, {_SHORT}, bytes_moved / 10000e0 as bytes_total, bytes_most / 10000e0 as bytes_max, large_exports, " + ", ".join(f"0e0 as zero_{i}" for i in range(7)) + " from snap",
    "feature_vector_12": f"select actor_id, step, {_SHORT}, bytes_moved / 10000e0 as bytes_total, 0e0 as zero_0 from snap",
    "peer_deviation": DEVIATION,
    # rules whose actions stand in order among the last 20 codes, as regular expressions over the joined codes
    "abductive_rule_hits": "select event_id, actor_id, step, {hits} from (select *, concat(';', {joined}, ';') as codes from coded) x",
    "vocabulary": "select distinct w as word from (select @explode(@words(content@w)) as w from texts) x",
    "burstiness": "select event_id, " + BURST + " as burstiness from style",
    # counts of a word before a step, then within it: no word's mails lie in one task
    "running_perplexity": """, mw as (select event_id, step, w, count(*) as c from (select event_id, step, @explode(@words(content@w)) as w from mails where length(content) >= 20) x group by event_id, step, w),
        word_steps as (select w, step, cast(coalesce(sum(s) over (partition by w order by step rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier
            from (select w, step, sum(c) as s from mw group by w, step) x),
        sizes as (select event_id, step, sum(c) as n from mw group by event_id, step),
        all_steps as (select step, cast(coalesce(sum(s) over (order by step rows between unbounded preceding and 1 preceding), 0) as bigint) as earlier from (select step, sum(n) as s from sizes group by step) x),
        totals as (select s.event_id, s.n, a.earlier + sum(s.n) over (partition by s.step order by s.event_id) as total from sizes s join all_steps a on s.step = a.step),
        freq as (select m.event_id, m.c, p.earlier + sum(m.c) over (partition by m.w, m.step order by m.event_id) as f from mw m join word_steps p on m.w = p.w and m.step = p.step)
        select t.event_id, least(100e0, 1e0 / greatest(0.001e0, x.weighted / cast(t.n as double) / cast(t.total as double))) as perplexity
        from totals t join (select event_id, cast(sum(c * f) as double) as weighted from freq group by event_id) x on t.event_id = x.event_id""",
    "extract_address": """select event_id, case when header like '%<%>%' then lower(trim(substring(header, instr(header, '<') + 1, instr(header, '>') - instr(header, '<') - 1)))
        when header like '%@%' then lower(trim(header)) else '' end as address from (
        select event_id, case when event_id % 3 = 0 then concat('Desk <', dst, '>') when event_id % 3 = 1 then concat(' ', upper(dst)) else 'undisclosed' end as header from security_events where event_type = 'email_send') x""",
    # ranks within 97 bands of a label, after the counts of the bands before: no label lies in one task
    "stratified_split": """, rows_ as (select doc_id, max(toxic) as toxic, doc_id % 97 as band from labels l group by doc_id),
        bands as (select toxic, band, n, sum(n) over (partition by toxic order by band) - n as earlier, sum(n) over (partition by toxic) as total from (select toxic, band, count(*) as n from rows_ group by toxic, band) x)
        select r.doc_id, r.toxic, b.earlier + row_number() over (partition by r.toxic, r.band order by r.doc_id) <= floor(0.15e0 * b.total) as test from rows_ r join bands b on r.toxic = b.toxic and r.band = b.band""",
    "reason_codes": """select event_id, concat(case when anchor_email = 1 then 'anchor_email;' else '' end, case when anchor_login = 1 then 'anchor_login;' else '' end,
        case when login_burst = 1 then 'login_burst;' else '' end, case when sens_burst = 1 then 'sens_burst;' else '' end, case when email_burst = 1 then 'email_burst;' else '' end,
        case when after_hours = 1 then 'after_hours;' else '' end, case when export_large = 1 then 'export_large;' else '' end, case when export_small = 1 then 'export_small;' else '' end,
        case when staging_export = 1 then 'staging_export;' else '' end, case when cycles > 0 then case when tickets > 0 then 'policy:partner_reporting_ticket;' else 'policy:partner_reporting_no_ticket;' end else '' end,
        case when unapproved = 1 then 'policy:unapproved_partner;' when outside > 0 then 'policy:approved_partner_email_not_anchor;' else '' end, case when after_hours = 1 and not allowed_after_hours then 'policy:after_hours_not_allowed;' else '' end) as reasons from flags""",
    "forensics_cache_mean": """select event_id, actor_id, step, avg(phishing_ce) over p as phishing_mean, avg(phishing_eg) over p as phishing_mean_eg, avg(ai_ce) over p as ai_mean, cast(sum(violations) over p as bigint) as violations, least(1e0, sum(violations) over p / 3e0) as violation_risk from judged
        window p as (partition by actor_id order by step, event_id rows between 9 preceding and current row)""",
    # samples are the steps with events of an actor; sums stand still where the window holds a partner cycle
    "clean_sample_filter": """select actor_id, step, cycles = 0 and not (large_so_far > 3 and outside_so_far > 5) as clean from (
        select actor_id, step, cycles, cast(sum(case when cycles = 0 then large_exports else 0 end) over p as bigint) as large_so_far, cast(sum(case when cycles = 0 then outside else 0 end) over p as bigint) as outside_so_far from snap
        window p as (partition by actor_id order by step rows between unbounded preceding and current row)) y""",
}

#: Counts of words up to each mail and the mail's perplexity, as table expressions.
_WORDS, _PERPLEXITY = QUERIES["running_perplexity"].rsplit("\n        select t.event_id", 1)
PERPLEXITY = _WORDS.lstrip(", ") + ", perplexities as (select t.event_id" + _PERPLEXITY + ")"
QUERIES["running_perplexity"] = "select event_id, perplexity from perplexities"

#: Of each mail: phishing by keywords and built-in classifier, and the probability that it was generated, by variant.
JUDGED = f"""
judged as (select s.event_id, s.actor_id, s.step, s.attachment_kb, greatest(s.phishing_ce, coalesce(p.ce, 0e0)) as phishing_ce, greatest(s.phishing_eg, coalesce(p.eg, 0e0)) as phishing_eg, s.phishing_trained, s.urgency_ce, s.urgency_eg, s.urgency_trained,
    s.sensitive_ce, s.sensitive_eg, s.violations, case when s.n_chars < 20 then 0e0 else h.deviation end as deviation, h.deviation as own_deviation, s.n_words, s.n_sentences, s.n_tokens, s.n_distinct,
    case when s.n_chars < 20 then 0e0 else case when coalesce(x.perplexity, 50e0) < 30 then 0.3e0 else 0e0 end + case when {BURST.replace("n_", "s.n_")} < 0.3e0 then 0.3e0 else 0e0 end + case when h.deviation > 0.5e0 then 0.2e0 else 0e0 end end as ai_ce,
    case when s.n_chars < 20 then 0e0 else case when coalesce(x.perplexity, 100e0) < 30 then 0.3e0 else 0e0 end + case when s.n_sentences >= 2 and {_VARIATION.replace("n_", "s.n_")} < 0.3e0 then 0.3e0 else 0e0 end + case when h.deviation > 0.5e0 then 0.2e0 else 0e0 end end as ai_eg,
    case when s.n_sentences >= 2 and {_VARIATION.replace("n_", "s.n_")} < 0.25e0 then 0.3e0 else 0e0 end as ai_trained
    from style s join habits h on s.event_id = h.event_id left join perplexities x on s.event_id = x.event_id left join phishing_probabilities p on p.doc_key = s.doc_key and p.variant = s.variant)"""
_ATTACHED = "case when attachment_kb > 500 then least(1e0, attachment_kb / 5000e0) else 0e0 end"
_STYLED = "case when n_words > 0 and n_sentences > 0 then least(1e0, (abs(cast(n_tokens as double) / n_sentences - 14.60e0) / 5 + abs(cast(n_distinct as double) / n_words - 0.633e0) / 0.15e0) / 3) else 0e0 end"
QUERIES["ai_text_probability"] = "select event_id, ai_ce as ai_probability, ai_eg, ai_trained, deviation from judged"
QUERIES["fused_text_risk"] = f"""select event_id, content_risk, content_risk_eg, content_risk_trained, authorship_risk, authorship_risk_eg, attachment_risk, (content_risk + authorship_risk + attachment_risk) / 3 as combined_risk,
    (content_risk_eg + authorship_risk_eg + attachment_risk) / 3 as combined_risk_eg, (content_risk_trained + phishing_trained) / 2 as combined_risk_trained from (
    select event_id, phishing_trained, phishing_ce * 0.4e0 + urgency_ce * 0.2e0 + case when sensitive_ce > 0 then 0.2e0 else 0e0 end + 0.2e0 * violations as content_risk, ai_ce * 0.5e0 + deviation * 0.3e0 as authorship_risk,
        phishing_eg * 0.4e0 + urgency_eg * 0.3e0 + case when sensitive_eg > 0 then 0.2e0 else 0e0 end as content_risk_eg, ai_eg * 0.5e0 + deviation * 0.3e0 as authorship_risk_eg,
        phishing_trained * 0.4e0 + {_STYLED} * 0.2e0 + (1 - case when n_words = 0 then 1e0 else 1 - least(1e0, own_deviation) end) * 0.2e0 + urgency_trained * 0.2e0 as content_risk_trained, {_ATTACHED} as attachment_risk from judged) x"""
QUERIES["text_classifier_prob"] = "select s.event_id, p.ce as probability_ce, p.eg as probability_eg, greatest(s.phishing_ce, p.ce) as phishing_ce, greatest(s.phishing_eg, p.eg) as phishing_eg from style s join phishing_probabilities p on p.doc_key = s.doc_key and p.variant = s.variant"
