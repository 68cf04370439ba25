"""Statistics of a mail corpus: which mails count, senders, means and shares, labelled mails by length.

A mail counts if its text has 20 characters, 30 words and a sentence. Means are sums with a fixed point, divided once, so that
no order of adding changes them; a sender's measures are kept as moments, not as lists that grow with the sender.
"""

from __future__ import annotations

# Least words of a mail that counts and of a labelled one, least mails of a sender with a profile of its own.
LEAST_WORDS, LEAST_LABELLED, LEAST_MAILS = 30, 20, 5

_fixed = lambda m: f"cast({m} as decimal(26, 12))"
mean = lambda m: f"round(cast(sum({_fixed(m)}) as double) / count({m}), 6)"
_share = lambda condition: f"100e0 * sum(case when {condition} then 1 else 0 end) / greatest(1, count(*))"

#: ``counted``: mails that count, with their measures. A mail whose document is missing or has no text can't be parsed.
COUNTED = f"""
parsed as (select s.event_id, s.actor_id, s.dst, s.attachments, s.n_words, s.n_distinct, s.n_sentences, s.n_tokens, s.n_solid, p.doc_id is not null as has_text
    from style s left join (select doc_id from documents where text is not null and text <> '') p on p.doc_id = s.m_key),
counted as (select *, cast(n_tokens as double) / n_sentences as len, cast(n_distinct as double) / n_words as rich from parsed where has_text and n_solid >= 20 and n_words >= {LEAST_WORDS} and n_sentences > 0)"""

QUERIES = {
    "sender_profiles": f"select actor_id, count(*) as n, {mean('len')} as avg_length, {mean('rich')} as avg_richness, {mean('n_words')} as avg_words, min(n_words) as least_words, max(n_words) as most_words, round(min(len), 9) as least_length, round(max(len), 9) as most_length from counted group by actor_id having count(*) >= {LEAST_MAILS}",
    "corpus_stats": f""", totals as (select count(*) as total_raw, coalesce(sum(case when has_text then 0 else 1 end), 0) as unparsed from parsed),
        senders as (select count(*) as unique_senders, coalesce(sum(case when n >= {LEAST_MAILS} then 1 else 0 end), 0) as senders_5_plus from (select actor_id, count(*) as n from counted where actor_id is not null group by actor_id) x),
        texts_counted as (select distinct m.m_key, m.variant from style m join counted c on c.event_id = m.event_id),
        words as (select count(distinct w) as vocabulary from (select @explode(@words(t.content@w)) as w from texts t join texts_counted c on c.m_key = t.doc_key and c.variant = t.variant) x),
        means as (select count(*) as processed, coalesce({mean('n_words')}, 0e0) as avg_words, coalesce({mean('len')}, 0e0) as avg_length, coalesce({mean('rich')}, 0e0) as avg_richness,
            coalesce({_share("dst like '%@%' and dst not like '%@org%'")}, 0e0) as external_share, coalesce({_share('attachments > 0')}, 0e0) as attachment_share from counted)
        select total_raw, cast(unparsed as bigint) as skipped_unparsed, cast(total_raw - unparsed - processed as bigint) as skipped_short, processed, unique_senders, cast(senders_5_plus as bigint) as senders_5_plus, vocabulary, avg_words, avg_length, avg_richness, external_share, attachment_share
        from totals cross join senders cross join words cross join means""",
    # a document with several labels is spam if one says so
    "label_filter_stats": f""", marked as (select d.doc_id, l.label, case when l.label is not null and @tokens(d.text@t) >= {LEAST_LABELLED} then 1 else 0 end as kept
            from (select doc_id, case when max(case when quality = 0 or toxic = 1 then 1 else 0 end) = 1 then 'spam' when count(quality) + count(toxic) > 0 then 'ham' end as label from labels group by doc_id) l join documents d on l.doc_id = d.doc_id where d.text is not null)
        select case when kept = 1 then label else 'skipped' end as label, count(*) as n, round(100e0 * count(*) / sum(count(*)) over (), 9) as share from marked group by case when kept = 1 then label else 'skipped' end""",
}

_white = "[\\x{9}-\\x{d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_MEASURED = f"""bodies as (select s.event_id, s.actor_id, s.dst, t.content, coalesce(d.text, '') <> '' as has_text from sent s join texts t on t.doc_key = s.doc_key and t.variant = s.variant left join documents d on d.doc_id = s.doc_key),
    parts as (select *, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') as ws, list_filter(list_transform(string_split_regex(content, '[.!?]+'), lambda s: len(list_filter(string_split_regex(s, '{_white}'), lambda t: t <> ''))), lambda n: n > 0) as lens from bodies),
    good as (select *, len(ws) as n_words, list_avg(lens) as len, len(list_distinct(ws)) / len(ws) as rich from parts where has_text and len(trim(content)) >= 20 and len(ws) >= 30 and len(lens) > 0)"""
_near = lambda m: f"round(avg({m}), 6)"
#: The same for DuckDB, written apart: each mail's text is measured by lists of its own words and sentences. ``sent`` and ``texts`` come before.
APART = {
    "sender_profiles": f"{_MEASURED} select actor_id, count(*) as n, {_near('len')} as avg_length, {_near('rich')} as avg_richness, {_near('n_words')} as avg_words, min(n_words) as least_words, max(n_words) as most_words, round(min(len), 9) as least_length, round(max(len), 9) as most_length from good group by actor_id having n > 4",
    "corpus_stats": f"""{_MEASURED} select (select count(*) from bodies) as total_raw, (select count(*) from bodies where not has_text) as skipped_unparsed, (select count(*) from bodies where has_text and event_id not in (select event_id from good)) as skipped_short,
        count(*) as processed, count(distinct actor_id) as unique_senders, (select count(*) from (select actor_id from good group by all having count(*) > 4)) as senders_5_plus, (select count(distinct w) from (select unnest(ws) as w from good)) as vocabulary,
        {_near('n_words')} as avg_words, {_near('len')} as avg_length, {_near('rich')} as avg_richness, 100 * avg((contains(dst, '@') and not contains(dst, '@org'))::int) as external_share,
        100 * avg(regexp_matches(lower(content), 'attached|attachment|enclosed|[.]xls|[.]doc|[.]pdf')::int) as attachment_share from good""",
    "label_filter_stats": """said as (select doc_id, bool_or(quality = 0) as low, bool_or(toxic = 1) as toxic, count(coalesce(quality, toxic)) as known from labels group by all),
        each_one as (select if(known > 0 and len(list_filter(string_split_regex(text, '[ \\n\\r\\t]+'), lambda t: t <> '')) >= 20, if(coalesce(low, false) or coalesce(toxic, false), 'spam', 'ham'), 'skipped') as label from said join documents using (doc_id) where text is not null)
        select label, count(*) as n, round(100 * count(*) / (select count(*) from each_one), 9) as share from each_one group by label""",
}
