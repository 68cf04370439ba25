"""Event sources: the activity log's schema, JSON-lines reader and writer, and the adapter from the ``events`` table.

The adapter is one SQL text for Spark and DuckDB; only the extraction of a JSON number and the hour since the epoch differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

META = T.StructType([
    *(T.StructField(n, T.StringType()) for n in ("role", "device_id", "cycle", "ticket_id", "destination", "reason", "subject", "content")),
    *(T.StructField(n, T.BooleanType()) for n in ("after_hours", "device_change", "on_call", "takeover", "maintenance", "approved_partner", "approved", "compliance_training", "ad_hoc_external")),
    T.StructField("attachment_kb", T.LongType()),
])
EVENT = T.StructType([
    T.StructField("step", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("actor_id", T.LongType()),
    T.StructField("resource", T.StringType()), T.StructField("action", T.StringType()), T.StructField("dst", T.StringType()),
    T.StructField("bytes", T.LongType()), T.StructField("meta", META), T.StructField("label", T.StringType()),
    T.StructField("scenario", T.StringType()), T.StructField("phase", T.StringType()),
])


def read_event_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """An activity log in JSON lines, with the fixed schema; keys it doesn't name are dropped."""
    return (spark.readStream if streaming else spark.read).schema(EVENT).json(path)


def write_event_log(events: DataFrame, path: str) -> None:
    events.write.json(path)


_K = {"spark": "cast(get_json_object(props, '$.k') as int)", "duckdb": "cast(json_extract_string(props, '$.k') as int)"}
_STEP = {
    "spark": "cast(floor((unix_micros(cast(ts as timestamp)) - 1704067200000000) / 3600000000) as bigint)",
    "duckdb": "cast(floor((epoch_us(ts) - 1704067200000000) / 3600000000) as bigint)",
}

_EVENTS = """
b as (select event_id, ts, user_id as actor_id, value, {step} as step, {k} as k,
    case event_type when 'signup' then 'login' when 'purchase' then 'data_export' when 'error' then 'email_send' else 'db_query' end as event_type
    from {events}),
c as (select *, case when actor_id % 10 = 0 then 'admin' when actor_id % 10 in (1, 2) then 'analyst' else 'staff' end as prof_role,
    (step % 24 < 8 or step % 24 > 17) as after_hours,
    case when event_type = 'email_send' then case when k < 40 then 'external@outside' when k < 60 then 'partner@outside' else 'someone@org' end end as dst
    from b),
security_events as (select event_id, ts, step, actor_id, event_type, k,
    case event_type when 'data_export' then 'patients_table' when 'db_query' then case when k < 50 then 'patients_table' when k % 2 = 0 then 'public_table' else 'project_table' end end as resource,
    case event_type when 'data_export' then case when k % 4 = 0 then 'EXPORT_INTERNAL' else 'EXPORT' end when 'db_query' then 'SELECT' end as action,
    dst,
    case when event_type in ('db_query', 'data_export') then cast(round(value * 100) as bigint) * 10 end as bytes,
    case when event_type = 'email_send' then cast(round(value * 10) as bigint) end as attachment_kb,
    prof_role as role, after_hours,
    (event_type = 'login' and k % 25 = 7) as takeover,
    (event_type = 'login' and k % 10 = 3) as device_change,
    case when k % 10 = 0 and event_type <> 'login' then 'partner_reporting' end as cycle,
    case when k % 5 = 0 and event_type <> 'login' and actor_id % 3 <> 1 then concat('TCKT-', cast(event_id as varchar(20))) end as ticket_id,
    coalesce(dst = 'partner@outside' and k % 2 = 0, false) as approved_partner,
    case when event_type = 'data_export' and k % 4 = 0 then 'internal_staging' end as destination,
    case when step >= 60 then 'test' else 'train' end as phase,
    case when step >= 60 and actor_id % 7 = 3 and ((event_type = 'email_send' and k < 40) or (event_type = 'login' and k % 25 = 7)
        or (event_type = 'data_export' and value > 80)) then 'malicious' else 'benign' end as label,
    case event_type when 'email_send' then 1 when 'login' then 2 else 0 end as src_rank
    from c)"""

_ACTORS = """
profile as (select actor_id, role, role <> 'staff' or actor_id % 8 = 0 as allowed_after_hours, case when role <> 'staff' then 'partner@outside' end as approved_dst
    from (select actor_id, max_by(role, event_id) as role from security_events group by actor_id) x),
ordered as (select s.*, p.role as profile_role, p.allowed_after_hours, p.approved_dst, row_number() over (partition by s.actor_id order by s.step, s.src_rank, s.event_id) as ord
    from security_events s join profile p on s.actor_id = p.actor_id)"""


def event_rows(dialect: str, table: str = "events") -> str:
    """Common table expressions up to security_events: each row of the table (or view) by itself."""
    return _EVENTS.format(step=_STEP[dialect], k=_K[dialect], events=table)


def actor_ctes() -> str:
    """Common table expressions profile and ordered over security_events."""
    return _ACTORS
