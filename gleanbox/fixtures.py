"""Derived outbox tables over the given events and orders, one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "messages": """
select event_id + 1 as id,
       concat('M', lpad(cast(event_id as varchar(20)), 10, '0')) as message_id,
       props as message, ts as created_at, event_type as exchange_name,
       case when event_type in ('signup','purchase') then 'topic' else 'queue' end as exchange_type,
       case when event_id % 11 = 0 then null when event_id % 101 = 0 then ' '
            else concat('G', cast(user_id as varchar(20))) end as group_id,
       case when event_id % 7 = 0 then '{}' when event_id % 5 = 0 then null else props end as custom_headers
from events where event_id % 37 <> 0
""",
    "message_meta_data": """
select event_id + 1 as id,
       concat('M', lpad(cast(event_id as varchar(20)), 10, '0')) as message_id,
       ts as created_at
from events where event_id % 41 <> 0
""",
    "responses": """
select event_id + 1 as id,
       case when event_id % 1009 = 0 then 503 when event_id % 499 = 0 then 404
            when event_id % 2003 = 0 then 0 else 200 end as status_code,
       event_id % 700 as latency_ms,
       case when event_id % 1511 = 0 then 'no route' end as error,
       case when event_id % 1009 = 0 or event_id % 499 = 0 then concat('refused ', event_type) end as body
from events
""",
    "sidelined_messages": """
select event_id + 1 as id,
       case when event_id % 11 = 0 then null when event_id % 101 = 0 then ' '
            else concat('G', cast(user_id as varchar(20))) end as group_id,
       concat('M', lpad(cast(event_id as varchar(20)), 10, '0')) as message_id,
       case when event_id % 3 = 0 then 'SIDELINED' when event_id % 3 = 1 then 'UNSIDELINED'
            else 'PROCESSING' end as status,
       ts as created_at, ts + interval '10' minute as updated_at,
       case when event_id % 2 = 0 then 500 else 0 end as http_status_code,
       case when event_id % 2 = 0 then 'HTTP_ERROR' else 'GROUP_SIDELINED' end as sideline_reason_code,
       case when event_id % 2 = 0 then 5 else 0 end as retries,
       case when event_id % 2 = 0 then 'status 500' else '' end as details
from events where event_id % 23 = 3
""",
    "sidelined_groups": """
select distinct concat('G', cast(user_id as varchar(20))) as group_id
from events
where event_id % 23 = 3 and event_id % 6 = 0 and event_id % 11 <> 0
  and event_id % 101 <> 0 and user_id % 3 <> 0
""",
    "skipped_ids": """
select event_id + 1 as id, event_id + 1 as message_seq_id,
       case when event_id % 4 = 0 then 'PROCESSING' else 'NEW' end as status,
       0 as retry_count, ts + interval '1' minute as created_at,
       ts + interval '1' minute as updated_at
from events where event_id % 37 = 0 or event_id % 41 = 0 or event_id % 43 = 0
""",
    "max_processed_message_sequence": """
select concat('Processor_default_SP_', cast(b as varchar(20))) as process_id,
       case when b = 6 then null else concat('M', lpad(cast(e as varchar(20)), 10, '0')) end as message_id,
       u as updated_at
from (select user_id % 7 as b, max(event_id) as e, max(ts) as u from events
      where event_id % 37 <> 0 and event_id % 41 <> 0 and event_id % 10 = user_id % 7
      group by user_id % 7) x
""",
    "control_tasks": """
select o_orderkey as id,
       case when o_orderkey % 4 = 0 then 'UNSIDELINE_GROUP' when o_orderkey % 4 = 1 then 'UNSIDELINE_MESSAGE'
            when o_orderkey % 4 = 2 then 'UNSIDELINE_ALL_UNGROUPED' else 'MANAGE_PARTITION' end as task_type,
       case when o_orderkey % 4 = 0 then concat('G', cast(o_custkey % 150 as varchar(20))) end as group_id,
       case when o_orderkey % 4 = 1 then concat('M', lpad(cast(o_custkey as varchar(20)), 10, '0')) end as message_id,
       case o_orderstatus when 'F' then 'DONE' when 'O' then 'NEW' else 'PROCESSING' end as status,
       o_orderdate as updated_at, o_orderdate as created_at,
       case o_orderkey % 12 when 2 then (select max(ts) from events) - interval '20' day when 6 then (select max(ts) from events) - interval '9' day end as from_date,
       case o_orderkey % 12 when 2 then (select max(ts) from events) - interval '15' day when 6 then (select max(ts) from events) - interval '8' day when 10 then (select max(ts) from events) end as to_date
from orders
""",
    "dup_messages": """
select * from messages
union all
select id + 1000000 as id, message_id, message, created_at, exchange_name, exchange_type, group_id, custom_headers
from messages where id % 50 = 0
""",
}
#: Tables whose text names other derived tables.
NEEDS = {"dup_messages": ["messages"]}


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The derived tables of one scale, in the order asked for. Base tables go by name."""
    for base in ("events", "orders"):
        spark.read.parquet(f"{sf_dir}/{base}.parquet").createOrReplaceTempView(base)
    out = []
    for name in names:
        for need in NEEDS.get(name, []):
            spark.sql(TABLES[need]).createOrReplaceTempView(need)
        out.append(spark.sql(TABLES[name]) if name in TABLES else spark.table(name))
    return out


def with_tables(sql: str, *names: str) -> str:
    """The same tables as common table expressions before a DuckDB query."""
    wanted: list[str] = []
    for name in names:
        wanted += [x for x in [*NEEDS.get(name, []), name] if x not in wanted]
    return "with " + ",\n".join(f"{n} as ({TABLES[n]})" for n in wanted) + "\n" + sql


def as_of(spark: SparkSession, sf_dir: str):
    """The last event time as a literal column of the events' own type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = events.agg(F.max("ts").cast("string").alias("t")).first()["t"]
    return F.lit(last).cast(events.schema["ts"].dataType)
