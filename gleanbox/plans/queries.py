"""The reference jobs as queries over the derived outbox tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanbox.functions import envelope, hashing, routing
from gleanbox.functions.times import ago, millis_between
from gleanbox.operators import assemble, drain, gaps, health, lanes, relay, retention, state
from gleanbox.plans.registry import bucket_sql, java_hash_sql, query
from gleanbox.schemas import OUTBOX
from gleanbox.sources import ordered, outbox

LANES = 7
SIZE = 1000
START, COUNT = 2000, 3000

# ---------------------------------------------------------------- sources

_NULL_SQL = {"bigint": "bigint", "string": "varchar", "int": "integer", "timestamp": "timestamp"}
_HAVE = {"id", "message_id", "message", "created_at", "exchange_name", "exchange_type", "group_id", "custom_headers"}
_OUTBOX_SQL = ", ".join(c if c in _HAVE else f"cast(null as {_NULL_SQL[t]}) as {c}" for c, t in OUTBOX.items())


@query("messages", f"select {_OUTBOX_SQL} from messages")
def outbox_projection(c, messages):
    return outbox.outbox_projection(messages)


@query(
    "message_meta_data",
    """select id, message_id, min(created_at) as created_at from (
      select * from message_meta_data union all select id, message_id, created_at + interval '1' minute from message_meta_data) x
    group by id, message_id""",
)
def shard_merge(c, metadata):
    copy = metadata.withColumn("created_at", F.col("created_at") + F.expr("interval '1' minute"))
    return outbox.shard_merge([metadata, copy]).select("id", "message_id", "created_at")


@query("messages message_meta_data", "select m.id, m.message_id from messages m where exists (select 1 from message_meta_data d where d.message_id = m.message_id)")
def metadata_from_messages(c, messages, metadata):
    return outbox.metadata_rows(messages, metadata)


@query(
    "messages message_meta_data",
    """select m.id, m.message_id, k.shard_key from messages m
    left join (select message_id, concat('S', cast(id % 4 as varchar)) as shard_key from message_meta_data) k on m.message_id = k.message_id""",
)
def metadata_with_shard_key(c, messages, metadata):
    keys = metadata.select("message_id", F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("shard_key"))
    return outbox.metadata_rows_with_shard(messages, messages, keys)


@query(
    "messages",
    """select id, message_id, false as relayed, cast(null as timestamp) as relayed_at, exchange_name, message, created_at, @as_of as updated_at,
      cast(null as varchar) as inbound_message_id, exchange_type, cast(null as varchar) as app_id, cast(null as varchar) as correlation_id, group_id,
      cast(null as varchar) as http_method, cast(null as varchar) as http_uri, cast(null as varchar) as reply_to, cast(null as varchar) as reply_to_http_method,
      cast(null as varchar) as reply_to_http_uri, concat('TXN-', message_id) as txn_id, cast(null as varchar) as routing_key, '' as context,
      cast(null as integer) as destination_response_status, cast(null as varchar) as relay_error, 0 as retries, custom_headers
    from messages""",
)
def legacy_projection(c, messages):
    return outbox.legacy_projection(messages, c.as_of)


@query("messages", f"select {_OUTBOX_SQL} from messages where message_id = 'M0000000123'")
def find_message(c, messages):
    return outbox.find_message(messages, "M0000000123")


# ------------------------------------------------------- batches and filters


@query("message_meta_data", f"select * from message_meta_data where id >= {START} and id < {START + COUNT}")
def metadata_batch(c, metadata):
    return assemble.metadata_batch(metadata, START, COUNT)


@query("message_meta_data", "select * from message_meta_data where created_at < @as_of - interval 86400 second")
def delayed_batch(c, metadata):
    return assemble.metadata_batch(metadata, 1, 2**62, ago(c.as_of, 86_400))


@query("messages", f"select id, message_id, message from messages where id >= {START} and id <= {START + COUNT}")
def message_range(c, messages):
    return assemble.message_range(messages, START, COUNT).select("id", "message_id", "message")


@query("messages skipped_ids", "select m.* from messages m where m.id in (select id from skipped_ids where status = 'NEW') order by m.id limit 100")
def messages_by_seq(c, messages, skipped):
    return assemble.by_sequence(messages, skipped.filter("status = 'NEW'"), 100).select(*messages.columns)


@query(
    "dup_messages sidelined_messages",
    """select message_id, max(id) as id, arg_max(message, id) as message, arg_max(group_id, id) as group_id from dup_messages
    where message_id in (select message_id from sidelined_messages) group by message_id""",
)
def messages_by_message_id(c, messages, sidelined):
    return assemble.by_message_id(messages, sidelined).select("message_id", "id", "message", "group_id")


@query("message_meta_data sidelined_messages", "select id, created_at from message_meta_data where message_id in (select message_id from sidelined_messages)")
def ids_by_message_id(c, metadata, sidelined):
    return assemble.ids_by_message_id(metadata, sidelined)


@query("message_meta_data", "select min(id) as id, arg_min(created_at, id) as created_at from message_meta_data where id >= 4000 and created_at < @as_of - interval 60 second")
def next_offset(c, metadata):
    return assemble.next_offset(metadata, 4000, ago(c.as_of, 60))


@query("control_tasks", "select * from control_tasks where status = 'NEW' order by id limit 500")
def claim_control_tasks(c, tasks):
    return state.claim_control_tasks(tasks, 500)


@query("skipped_ids", "select id, message_seq_id, status, created_at from skipped_ids where status = 'NEW' and created_at > @as_of - interval 2880 minute")
def eligible_skipped(c, skipped):
    return assemble.eligible_skipped(skipped, c.as_of, 2880).select("id", "message_seq_id", "status", "created_at")


@query("messages", "select id, message_id, case when length(message) > 8 then 'REJECTED' else 'ACCEPTED' end as gate from messages")
def payload_gate(c, messages):
    good, bad = assemble.payload_gate(messages, 8)
    return good.select("id", "message_id", F.lit("ACCEPTED").alias("gate")).unionByName(bad.select("id", "message_id", F.lit("REJECTED").alias("gate")))


# ------------------------------------------------------------------- joins

_LAST_SQL = "(select message_id, max(id) as id from {0} group by message_id)"


@query(
    "message_meta_data dup_messages",
    f"""select d.id as app_sequence_id, m.id, m.message_id, m.group_id, m.message, m.created_at
    from {_LAST_SQL.format("message_meta_data")} d join {_LAST_SQL.format("dup_messages")} l on d.message_id = l.message_id
    join dup_messages m on m.id = l.id and m.message_id = l.message_id""",
)
def outbox_batch_default(c, metadata, messages):
    return assemble.batch_default(metadata, messages).select("app_sequence_id", "id", "message_id", "group_id", "message", "created_at")


@query("message_meta_data messages", "select m.id as app_sequence_id, m.id, m.message_id, m.group_id, m.message from message_meta_data d join messages m on d.id = m.id")
def outbox_batch_sequence(c, metadata, messages):
    return assemble.batch_sequence(metadata, messages).select("app_sequence_id", "id", "message_id", "group_id", "message")


@query("messages", f"select id as app_sequence_id, id, message_id, group_id from messages where id between {START} and {START + COUNT}")
def outbox_batch_outbound(c, messages):
    return assemble.batch_outbound(assemble.message_range(messages, START, COUNT)).select("app_sequence_id", "id", "message_id", "group_id")


@query("message_meta_data messages", "select d.id, d.message_id from message_meta_data d where not exists (select 1 from messages m where m.message_id = d.message_id)")
def missing_payload(c, metadata, messages):
    return assemble.missing_payload(metadata, messages).select("id", "message_id")


@query(
    "sidelined_messages messages",
    """select m.id, m.message_id, m.group_id, m.message from messages m
    where m.message_id in (select message_id from sidelined_messages where status = 'UNSIDELINED' order by id limit 50)""",
)
def unsidelined_batch(c, sidelined, messages):
    return assemble.unsidelined_batch(assemble.claimed_unsidelined(sidelined, 50), messages).select("id", "message_id", "group_id", "message")


@query(
    "skipped_ids message_meta_data messages",
    """select f.id as app_sequence_id, f.message_id, m.message, m.id is not null as has_payload from (
      select d.id, d.message_id from message_meta_data d
      where d.id in (select id from skipped_ids where status = 'NEW' and created_at > @as_of - interval 14400 minute) order by d.id limit 200) f
    left join messages m on m.message_id = f.message_id""",
)
def skipped_recovery(c, skipped, metadata, messages):
    rows, marked = assemble.skipped_recovery(assemble.eligible_skipped(skipped, c.as_of, 14_400), metadata, messages, 200)
    found = marked.join(metadata.select("id", "message_id"), "id")
    sent = rows.select("app_sequence_id", "message", F.lit(True).alias("has_payload"))
    joined = found.withColumnRenamed("id", "app_sequence_id").join(sent, "app_sequence_id", "left")
    return joined.select("app_sequence_id", "message_id", "message", F.coalesce("has_payload", F.lit(False)).alias("has_payload"))


@query(
    "skipped_ids messages",
    """select id as app_sequence_id, message_id, message from messages
    where id in (select id from skipped_ids where status = 'NEW' and created_at > @as_of - interval 14400 minute) order by id limit 200""",
)
def skipped_recovery_outbound(c, skipped, messages):
    return assemble.skipped_recovery_outbound(assemble.eligible_skipped(skipped, c.as_of, 14_400), messages, 200).select("app_sequence_id", "message_id", "message")


_POSITIONS_SQL = """(select k.process_id, max(d.id) as id from max_processed_message_sequence k
    join message_meta_data d on d.message_id = k.message_id group by k.process_id)"""


@query("max_processed_message_sequence message_meta_data", f"select * from {_POSITIONS_SQL} p")
def checkpoint_positions(c, checkpoints, metadata):
    return lanes.checkpoint_positions(checkpoints, metadata)


@query(
    "sidelined_messages messages",
    f"select distinct (m.id - 1) // {SIZE} as partition_no from messages m join sidelined_messages s on s.message_id = m.message_id",
)
def partition_sidelined(c, sidelined, messages):
    return retention.sidelined_partitions(sidelined, messages, SIZE)


@query(
    "skipped_ids messages",
    f"select distinct (m.id - 1) // {SIZE} as partition_no from messages m join skipped_ids s on s.message_seq_id = m.id where s.status in ('NEW', 'PROCESSING')",
)
def partition_skipped(c, skipped, messages):
    return retention.skipped_partitions(skipped, messages, SIZE)


@query(
    "max_processed_message_sequence",
    """select process_id, 'STALE' as change from max_processed_message_sequence where right(process_id, 1) in ('0', '1')
    union all select 'Processor_default_SP_7', 'NEW'""",
)
def stale_checkpoints(c, checkpoints):
    # the relay now runs lanes 2 to 7
    wanted = checkpoints.select("process_id").filter("right(process_id, 1) not in ('0', '1')").unionByName(c.spark.range(7, 8).select(F.concat(F.lit("Processor_default_SP_"), F.col("id").cast("string")).alias("process_id")))
    stale = lanes.stale_checkpoints(checkpoints, wanted).select("process_id", F.lit("STALE").alias("change"))
    return stale.unionByName(lanes.new_lanes(checkpoints, wanted).select("process_id", F.lit("NEW").alias("change")))


@query(
    "sidelined_messages messages",
    """select m.id, m.message_id, m.message from messages m
    where m.message_id in (select s.message_id from sidelined_messages s join messages x on x.message_id = s.message_id)""",
)
def forced_resend(c, sidelined, messages):
    wanted = sidelined.join(messages.select("message_id"), "message_id", "left_semi")
    return assemble.forced_resend(messages, wanted.unionByName(wanted), 10_000_000, 10).select("id", "message_id", "message")


# ----------------------------------------------------- health and aggregates

_PENDING_SQL = """(select coalesce(max(id), 0) from messages) - coalesce((select max(m.id) from messages m
    where m.message_id = (select message_id from max_processed_message_sequence order by updated_at desc, process_id desc limit 1)), 0)"""
_LAG_SQL = """(select (epoch_us(@as_of) // 1000) - (epoch_us(arg_min(m.created_at, m.id)) // 1000) as min_lag_ms,
    (epoch_us(@as_of) // 1000) - (epoch_us(arg_max(m.created_at, m.id)) // 1000) as max_lag_ms
    from messages m where m.message_id in (select message_id from max_processed_message_sequence where message_id is not null))"""


_KEY_SQL = f"coalesce(group_id, cast({java_hash_sql('message_id')} as varchar))"
_BUCKETED_SQL = f"(select *, cast({bucket_sql(java_hash_sql('k'), LANES)} as integer) as bucket from (select *, {_KEY_SQL} as k from messages) q)"
_DELIVERY_SQL = f"""(select case when max(lag_ms) > 0 then max(lag_ms) end as max_lag_ms, case when max(lag_ms) > 0 then cast(sum(lag_ms) // {LANES} as bigint) end as avg_lag_ms
    from (select bucket, arg_max(latency_ms, id) as lag_ms from (
      select m.bucket, m.id, r.latency_ms from {_BUCKETED_SQL} m join responses r on r.id = m.id where r.status_code = 200) x group by bucket) y)"""


def delivered_lags(messages, responses):
    sent = lanes.with_bucket(messages, LANES).join(responses.filter("status_code = 200"), "id")
    return sent.select("bucket", "id", F.col("latency_ms").alias("lag_ms"))


@query("messages max_processed_message_sequence", f"select cast({_PENDING_SQL} as bigint) as pending")
def pending_count(c, messages, checkpoints):
    return health.pending_count(messages, checkpoints)


@query("messages max_processed_message_sequence", f"select * from {_LAG_SQL} x")
def processed_lag(c, messages, checkpoints):
    return health.processed_lag(messages, checkpoints, c.as_of)


@query(
    "messages sidelined_messages sidelined_groups max_processed_message_sequence responses",
    f"""select t.max_id, t.max_id as last_id, s.n as n_sidelined, g.n as n_sidelined_groups, k.n as n_checkpoints, k.started as n_started,
      cast({_PENDING_SQL} as bigint) as pending, l.min_lag_ms, l.max_lag_ms, d.max_lag_ms as max_delivery_lag_ms, d.avg_lag_ms as avg_delivery_lag_ms, t.n as n_processed, cast((t.max_id // {SIZE} + 1) * {SIZE} as bigint) as max_partition_id,
      cast((t.max_id // {SIZE} + 1) * {SIZE} - t.max_id as bigint) as headroom
    from (select max(id) as max_id, count(*) as n from messages) t, {_DELIVERY_SQL} d, (select count(*) as n from sidelined_messages where status = 'SIDELINED') s,
      (select count(*) as n from sidelined_groups) g, (select count(*) as n, count(message_id) as started from max_processed_message_sequence) k, {_LAG_SQL} l""",
)
def health_snapshot(c, messages, sidelined, groups, checkpoints, responses):
    outcome = relay.relay_outcome(messages, responses, groups)
    return health.health_snapshot(messages, sidelined, groups, checkpoints, outcome, delivered_lags(messages, responses), LANES, c.as_of, SIZE)


#: Tables of four relays, told apart by what a row has anyway; r2 is not active, r9 has nothing.
_RELAY_SQL = {
    "m": "(select concat('r', cast(id % 3 as varchar(9))) as relayer_id, * from messages)",
    "s": "(select concat('r', cast(id % 3 as varchar(9))) as relayer_id, * from sidelined_messages)",
    "g": "(select concat('r', cast(length(group_id) % 3 as varchar(9))) as relayer_id, * from sidelined_groups)",
    "k": "(select p.*, concat('r', cast(m.id % 3 as varchar(9))) as relayer_id from max_processed_message_sequence p left join messages m on m.message_id = p.message_id)",
}


@query(
    "messages sidelined_messages sidelined_groups max_processed_message_sequence",
    f"""select a.relayer_id, (select max(id) from {_RELAY_SQL["m"]} m where m.relayer_id = a.relayer_id) as max_id,
      (select count(*) from {_RELAY_SQL["m"]} m where m.relayer_id = a.relayer_id) as n_messages,
      (select count(*) from {_RELAY_SQL["s"]} s where s.relayer_id = a.relayer_id and s.status = 'SIDELINED') as n_sidelined,
      (select count(*) from {_RELAY_SQL["g"]} g where g.relayer_id = a.relayer_id) as n_sidelined_groups,
      (select count(*) from {_RELAY_SQL["k"]} k where k.relayer_id = a.relayer_id) as n_checkpoints,
      (select count(message_id) from {_RELAY_SQL["k"]} k where k.relayer_id = a.relayer_id) as n_started,
      cast(coalesce((select max(id) from {_RELAY_SQL["m"]} m where m.relayer_id = a.relayer_id), 0) - coalesce((select max(m.id) from {_RELAY_SQL["m"]} m
        where m.relayer_id = a.relayer_id and m.message_id = (select arg_max(k.message_id, struct_pack(u := k.updated_at, p := k.process_id)) from {_RELAY_SQL["k"]} k where k.relayer_id = a.relayer_id)), 0) as bigint) as pending,
      (select (epoch_us(@as_of) // 1000) - (epoch_us(arg_min(m.created_at, m.id)) // 1000) from {_RELAY_SQL["m"]} m join {_RELAY_SQL["k"]} k on k.message_id = m.message_id and k.relayer_id = m.relayer_id where m.relayer_id = a.relayer_id) as min_lag_ms,
      (select (epoch_us(@as_of) // 1000) - (epoch_us(arg_max(m.created_at, m.id)) // 1000) from {_RELAY_SQL["m"]} m join {_RELAY_SQL["k"]} k on k.message_id = m.message_id and k.relayer_id = m.relayer_id where m.relayer_id = a.relayer_id) as max_lag_ms
    from (select 'r0' as relayer_id union all select 'r1' union all select 'r9') a""",
)
def relay_snapshots(c, messages, sidelined, groups, checkpoints):
    of = lambda n: F.concat(F.lit("r"), (n % 3).cast("string"))
    with_relay = [t.withColumn("relayer_id", of(F.col("id"))) for t in (messages, sidelined)]
    owner = checkpoints.join(messages.select("message_id", of(F.col("id")).alias("relayer_id")), "message_id", "left")
    active = c.spark.range(10).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("relayer_id")).filter("relayer_id in ('r0', 'r1', 'r9')")
    return health.relay_snapshots(active, *with_relay, groups.withColumn("relayer_id", of(F.length("group_id"))), owner, c.as_of)


@query("messages responses", f"select * from {_DELIVERY_SQL} d")
def delivery_lag(c, messages, responses):
    return health.delivery_lag(delivered_lags(messages, responses), LANES)


_SENT_SQL = """(select m.*, r.error, r.body, case when r.error is not null then 0 else coalesce(r.status_code, 500) end as code,
      r.error is not null or coalesce(r.status_code, 500) // 100 <> 2 as failed, trim(coalesce(m.group_id, '')) = '' as alone
      from messages m left join responses r on r.id = m.id)"""
_OUTCOME_SQL = f"""(select m.id, m.message_id, m.group_id,
      case when held then 'SIDELINED' when failed then 'SIDELINED' else 'RELAYED' end as outcome,
      case when held then 'GROUP_SIDELINED' when error is not null then 'RELAYER_ERROR' when failed then 'HTTP_ERROR' end as reason,
      cast(case when held then 0 when failed then code end as integer) as http_status_code,
      cast(case when held or error is not null then 0 when failed then 5 end as integer) as retries,
      case when held then '' when failed then coalesce(error, body, '') end as details
    from (select f.*, coalesce(not alone and (g.group_id is not null or f.id > first_fail), false) as held from (
        select e.*, min(case when failed and not alone then id end) over (partition by case when alone then message_id else group_id end, alone) as first_fail from {_SENT_SQL} e) f
      left join sidelined_groups g on g.group_id = f.group_id) m)"""


@query("messages responses sidelined_groups", f"select * from {_OUTCOME_SQL} o")
def relay_outcome(c, messages, responses, groups):
    return relay.relay_outcome(messages, responses, groups)


@query(
    "messages responses sidelined_groups",
    f"""select o.id, o.message_id, coalesce(o.reason, '') <> 'GROUP_SIDELINED' as sent,
      cast(case when coalesce(o.reason, '') <> 'GROUP_SIDELINED' then coalesce(r.status_code, 500) end as integer) as status_code
    from {_OUTCOME_SQL} o left join responses r on r.id = o.id""",
)
def ordered_delivery(c, messages, responses, groups):
    """What reaches a sender that answers as the responses table says."""
    told = messages.join(responses.select("id", "status_code", "error"), "id", "left")
    work = told.select("group_id", "id", "message_id", F.lit("NEW").alias("kind"), F.lit(3).alias("kind_rank"), F.coalesce("status_code", F.lit(500)).alias("status_code"), "error")
    state_ = groups.select("group_id", F.lit("SIDELINED").alias("status"), F.lit(-1).cast("bigint").alias("last_id"))
    return ordered.deliver_in_order(work, lambda part: part[["status_code", "error"]], state_).select("id", "message_id", "sent", "status_code")


@query(
    "messages responses sidelined_groups",
    f"select b.bucket, count(*) as n_processed from {_OUTCOME_SQL} o join {_BUCKETED_SQL} b on b.id = o.id where o.outcome <> 'IGNORED' group by b.bucket",
)
def processed_count(c, messages, responses, groups):
    outcome = relay.relay_outcome(messages, responses, groups)
    return health.processed_count(outcome.join(lanes.with_bucket(messages, LANES).select("id", "bucket"), "id"))


@query(
    "responses",
    """select count(*) filter (where status_code // 100 = 4) as n_4xx, count(*) filter (where status_code // 100 = 5) as n_5xx,
      count(*) filter (where status_code = 499) as n_timeout, count(*) as n_sent,
      quantile_cont(latency_ms, 0.5) as p50_ms, quantile_cont(latency_ms, 0.95) as p95_ms, quantile_cont(latency_ms, 0.99) as p99_ms from responses""",
)
def delivery_errors(c, responses):
    return health.delivery_errors(responses)


@query(
    "max_processed_message_sequence message_meta_data",
    """select cast(coalesce(min(id), 0) as bigint) as id, arg_min(created_at, id) as created_at from message_meta_data
    where message_id in (select message_id from max_processed_message_sequence where message_id is not null)""",
)
def resume_offset(c, checkpoints, metadata):
    return lanes.resume_offset(checkpoints, metadata)


@query(
    "messages",
    f"""select p as partition_no, p * {SIZE} + 1 as start_id, (p + 1) * {SIZE} as end_id, count(*) as n_rows, arg_max(created_at, id) as last_created_at
    from (select *, (id - 1) // {SIZE} as p from messages) x group by p""",
)
def partition_stats(c, messages):
    return retention.partition_stats(messages, SIZE)


@query("messages", "select ((epoch_us(@as_of) // 1000) - (epoch_us(created_at) // 1000)) // 3600000 * 3600000 as bucket_start, count(*) as n from messages group by 1")
def lag_histogram(c, messages):

    return health.lag_histogram(messages.select(millis_between(c.as_of, F.col("created_at")).alias("lag_ms")), "lag_ms", 3_600_000)


@query("sidelined_messages", "select distinct group_id from sidelined_messages where updated_at between @as_of - interval 864000 second and @as_of - interval 432000 second")
def groups_between(c, sidelined):
    return state.groups_between(sidelined, ago(c.as_of, 864_000), ago(c.as_of, 432_000))


# ---------------------------------------------------------- windows and lanes

_GAPS_SQL = """(select prev + 1 as gap_start, id as gap_end from (
      select id, lag(id) over (order by id) as prev from (select d.id from message_meta_data d join messages m on m.message_id = d.message_id) j) x where id - prev > 1)"""


@query("message_meta_data messages", f"select * from {_GAPS_SQL} g")
def sequence_gaps(c, metadata, messages):
    joined = metadata.select("id", "message_id").join(messages.select("message_id"), "message_id", "left_semi")
    return gaps.sequence_gaps(joined, block=512)


@query(
    "message_meta_data messages",
    f"select id, id as message_seq_id, 'NEW' as status, 0 as retry_count from (select unnest(generate_series(gap_start, gap_end - 1)) as id from {_GAPS_SQL} g) x",
)
def skipped_ids_new(c, metadata, messages):
    return gaps.skipped_ids(sequence_gaps(c, metadata, messages))


@query(
    "messages events",
    """select min(id) as start_id, max(id) + 1 as end_id, 'NEW' as status from (
      select id, id - row_number() over (order by id) as run from (
        select event_id + 1 as id from events) x
      where id not in (select id from messages) and id > (select min(id) from messages) and id < (select max(id) from messages) and id % 3 <> 0) y
    group by run""",
)
def late_intervals(c, messages, events):
    """Gaps of the message table as intervals, after every third id has turned up."""
    found = gaps.intervals_of(gaps.sequence_gaps(messages.select("id")), c.as_of)
    arrived = events.select((F.col("event_id") + 1).alias("id")).filter("id % 3 = 0")
    late = gaps.located(found, arrived)
    left = gaps.split_intervals(found, late)
    return found.join(late.select("start_id").distinct(), "start_id", "left_anti").unionByName(left).select("start_id", "end_id", "status")


@query("dup_messages", "select * from dup_messages qualify row_number() over (partition by message_id order by id desc) = 1")
def dedup_messages(c, messages):
    return assemble.last_by_message(messages).select(*messages.columns)


@query("messages", f"select id, message_id, {java_hash_sql('k')} as key_hash, bucket from {_BUCKETED_SQL} b")
def lane_bucket(c, messages):
    placed = lanes.with_bucket(messages, LANES)
    return placed.select("id", "message_id", hashing.java_hash(hashing.sequencing_key(F.col("group_id"), F.col("message_id"))).alias("key_hash"), "bucket")


_MD5_SQL = "cast('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) as bigint)"


@query(
    "messages",
    f"""select id, case when u >= 2147483648 then u - 4294967296 else u end as key_hash,
      cast(case when u = 2147483648 then 0 else abs(case when u >= 2147483648 then u - 4294967296 else u end) % {LANES} end as integer) as bucket
    from (select id, {_MD5_SQL} as u from (select id, md5(coalesce(group_id, '')) as h from messages) x) y""",
)
def lane_bucket_md5(c, messages):
    return messages.select("id", hashing.md5_hash(F.col("group_id")).alias("key_hash"), hashing.bucket(F.col("group_id"), LANES, "md5").alias("bucket"))


@query("messages", f"select concat('Processor_default_SP_', cast(bucket as varchar)) as process_id, arg_max(message_id, id) as message_id from {_BUCKETED_SQL} b group by bucket")
def lane_checkpoints(c, messages):
    return lanes.lane_checkpoints(lanes.with_bucket(messages, LANES))


@query("messages", "select id, group_id, row_number() over (partition by group_id order by id) as group_seq from messages where trim(coalesce(group_id, '')) <> ''")
def group_order(c, messages):
    return lanes.group_order(messages).select("id", "group_id", "group_seq")


@query(
    "max_processed_message_sequence message_meta_data messages",
    f"""select b.id, b.message_id, b.bucket from {_BUCKETED_SQL} b left join {_POSITIONS_SQL} p on p.process_id = concat('Processor_default_SP_', cast(b.bucket as varchar))
    where b.id >= (select min(id) from {_POSITIONS_SQL} x) and b.id < (select max(id) from {_POSITIONS_SQL} y) and (p.id is null or b.id > p.id)""",
)
def replay_set(c, checkpoints, metadata, messages):
    return lanes.replay_set(lanes.checkpoint_positions(checkpoints, metadata), messages, LANES).select("id", "message_id", "bucket")


BATCH = 8_000


@query(
    "control_tasks sidelined_messages skipped_ids messages",
    f"""select * from (with c as (select id from control_tasks where status = 'NEW' order by id limit {BATCH}), u as (select id from sidelined_messages where status = 'UNSIDELINED' order by id limit {BATCH}),
      s as (select id from skipped_ids where status = 'NEW' order by id limit {BATCH}), n as (select id from messages order by id limit {BATCH}),
      z as (select (select count(*) from c) < {BATCH} as c, (select count(*) from u) < {BATCH} as u, (select count(*) from s) < {BATCH} as s)
      select 0 as kind_rank, 'CONTROL' as kind, cast(id as bigint) as id from c
      union all select 1, 'UNSIDELINED', u.id from u, z where z.c
      union all select 2, 'SKIPPED', s.id from s, z where z.c and z.u union all select 3, 'NEW', n.id from n, z where z.c and z.u and z.s) q""",
)
def work_queue(c, tasks, sidelined, skipped, messages):
    """A read batch: what one cycle takes up."""
    return assemble.work_queue(tasks.filter("status = 'NEW'"), sidelined.filter("status = 'UNSIDELINED'"), skipped.filter("status = 'NEW'"), messages, BATCH)


# ------------------------------------------------------------- relay and state


#: Each group's rows one after the other: a recursive query carries the group's state from row to row.
_DRAIN_SQL = """(with recursive work as (
      select m.group_id, m.id, m.message_id, m.error, m.code, m.failed, case when s.status = 'UNSIDELINED' then 'UNSIDELINED' when k.id is not null then 'SKIPPED' else 'NEW' end as kind
      from {sent} m left join sidelined_messages s on s.message_id = m.message_id left join skipped_ids k on k.id = m.id
      where not m.alone and (s.status is null or s.status <> 'PROCESSING')),
    placed as (select *, row_number() over (partition by group_id order by case kind when 'UNSIDELINED' then 1 when 'SKIPPED' then 2 else 3 end, id) as place from work),
    begun as (select g.group_id, 'UNSIDELINED' as st, coalesce(max(s.id), -1) as la from sidelined_groups g left join sidelined_messages s on s.group_id = g.group_id group by g.group_id),
    walk as (
      select p.*, b.st, cast(b.la as bigint) as la from placed p left join begun b on b.group_id = p.group_id where p.place = 1
      union all
      select p.*, case when w.st is not null and w.id > coalesce(w.la, -1) then w.st when w.failed then 'SIDELINED' when w.st is not null and w.id = coalesce(w.la, -1) then null else w.st end,
        case when w.st is not null and w.id > coalesce(w.la, -1) then w.id when w.failed then w.id when w.st is not null and w.id = coalesce(w.la, -1) then null else w.la end
      from walk w join placed p on p.group_id = w.group_id and p.place = w.place + 1)
    select group_id, id, message_id, kind, case when held then 'HELD' when failed then 'SIDELINED' else 'RELAYED' end as outcome,
      case when held then case when st = 'SIDELINED' then 'GROUP_SIDELINED' else 'GROUP_SEQ_MAINTENANCE' end when error is not null then 'RELAYER_ERROR' when failed then 'HTTP_ERROR' end as reason,
      cast(case when held then 0 when failed then code end as integer) as http_status_code,
      cast(case when held then 0 when error is not null and kind <> 'UNSIDELINED' then 0 when failed then 5 end as integer) as retries,
      case when held then case when st = 'SIDELINED' then 'SIDELINED' else 'UNSIDELINED' end when failed then 'SIDELINED' end as status
    from (select *, st is not null and id > coalesce(la, -1) as held from walk) h)""".replace("{sent}", _SENT_SQL)


def _drained(messages, responses, groups, sidelined, skipped):
    """Released, skipped and new messages of one cycle; groups that were sidelined have been released."""
    kind = F.when(F.col("s.status") == "UNSIDELINED", "UNSIDELINED").when(F.col("k.id").isNotNull(), "SKIPPED").otherwise("NEW")
    rows = messages.alias("m").join(sidelined.select("message_id", "status").alias("s"), "message_id", "left").join(skipped.select("id").alias("k"), F.col("m.id") == F.col("k.id"), "left")
    work = rows.filter("s.status is null or s.status <> 'PROCESSING'").select("m.group_id", "m.id", "message_id", kind.alias("kind"))
    work = work.withColumn("kind_rank", F.when(F.col("kind") == "UNSIDELINED", 1).when(F.col("kind") == "SKIPPED", 2).otherwise(3))
    last = sidelined.groupBy("group_id").agg(F.max("id").alias("last_id"))
    start = groups.join(last, "group_id", "left").select("group_id", F.lit("UNSIDELINED").alias("status"), F.coalesce("last_id", F.lit(-1)).cast("bigint").alias("last_id"))
    return drain.group_drain(drain.with_responses(work, responses), start)[0]


@query("messages responses sidelined_groups sidelined_messages skipped_ids", f"select * from {_DRAIN_SQL} d")
def group_drain(c, messages, responses, groups, sidelined, skipped):
    return _drained(messages, responses, groups, sidelined, skipped)


@query(
    "messages responses sidelined_groups skipped_ids",
    f"select s.* from skipped_ids s where s.id not in (select id from {_OUTCOME_SQL} o where o.outcome <> 'IGNORED')",
)
def skipped_outcome(c, messages, responses, groups, skipped):
    # the outcome of a skipped message depends on its whole group
    return relay.skipped_left(skipped, relay.relay_outcome(messages, responses, groups))


@query(
    "messages responses sidelined_groups sidelined_messages skipped_ids",
    f"""select s.id, s.group_id, s.message_id, case when o.outcome in ('SIDELINED', 'HELD') then o.status else s.status end as status, s.created_at, s.updated_at,
      cast(case when o.outcome in ('SIDELINED', 'HELD') then o.http_status_code else s.http_status_code end as integer) as http_status_code,
      case when o.outcome in ('SIDELINED', 'HELD') then o.reason else s.sideline_reason_code end as sideline_reason_code,
      cast(case when o.outcome in ('SIDELINED', 'HELD') then o.retries else s.retries end as integer) as retries, s.details
    from sidelined_messages s left join (
      select message_id, outcome, status, reason, http_status_code, retries from {_DRAIN_SQL} d where kind = 'UNSIDELINED'
      union all select o.message_id, o.outcome, 'SIDELINED', o.reason, o.http_status_code, case when o.outcome = 'SIDELINED' then 5 end from {_OUTCOME_SQL} o
        where trim(coalesce(o.group_id, '')) = '' and o.message_id in (select message_id from sidelined_messages where status = 'UNSIDELINED')) o
      on o.message_id = s.message_id where o.outcome is null or o.outcome <> 'RELAYED'""",
)
def unsidelined_outcome(c, messages, responses, groups, sidelined, skipped):
    grouped = _drained(messages, responses, groups, sidelined, skipped).filter("kind = 'UNSIDELINED'").select("message_id", "outcome", "status", "reason", "http_status_code", "retries")
    alone = messages.filter(hashing.is_ungrouped(F.col("group_id"))).join(sidelined.filter("status = 'UNSIDELINED'").select("message_id"), "message_id", "left_semi")
    # a released row that fails again has used all its retries
    alone = relay.relay_outcome(alone, responses, groups).select("message_id", "outcome", F.lit("SIDELINED").alias("status"), "reason", "http_status_code", F.when(F.col("outcome") == "SIDELINED", relay.MAX_RETRIES).alias("retries"))
    return relay.unsidelined_left(sidelined, grouped.unionByName(alone))


@query("messages responses", "select m.message_id, cast(case when coalesce(r.status_code, 500) // 100 = 2 then 200 else coalesce(r.status_code, 500) end as integer) as destination_response_status from messages m left join responses r on r.id = m.id")
def forced_status(c, messages, responses):
    return relay.forced_status(messages, responses)


_SIDELINED = "id, group_id, message_id, status, created_at, updated_at, http_status_code, sideline_reason_code, retries, details"


@query(
    "messages responses sidelined_groups sidelined_messages",
    f"""select coalesce(s.id, o.id) as id, case when s.id is not null then s.group_id else o.group_id end as group_id, coalesce(s.message_id, o.message_id) as message_id,
      case when o.id is not null then 'SIDELINED' else s.status end as status, coalesce(s.created_at, @as_of) as created_at,
      case when o.id is not null then @as_of else s.updated_at end as updated_at,
      cast(case when o.id is not null then o.http_status_code else s.http_status_code end as integer) as http_status_code,
      case when o.id is not null then o.reason else s.sideline_reason_code end as sideline_reason_code,
      cast(case when o.id is not null then o.retries else s.retries end as integer) as retries, case when o.id is not null then o.details else s.details end as details
    from sidelined_messages s full join (select o.* from {_OUTCOME_SQL} o where o.outcome = 'SIDELINED') o on o.message_id = s.message_id""",
)
def sideline_upsert(c, messages, responses, groups, sidelined):
    outcome = relay.relay_outcome(messages, responses, groups).filter("outcome = 'SIDELINED'")
    changes = outcome.select("message_id", "group_id", "id", F.lit("SIDELINED").alias("status"), F.col("reason").alias("sideline_reason_code"), "http_status_code", "retries", "details")
    return state.sideline_upsert(sidelined, changes, c.as_of)


@query(
    "messages responses sidelined_groups",
    f"select distinct group_id from (select group_id from sidelined_groups union all select group_id from {_OUTCOME_SQL} o where outcome = 'SIDELINED' and group_id is not null) x",
)
def sidelined_groups_after(c, messages, responses, groups):
    outcome = relay.relay_outcome(messages, responses, groups).filter("outcome = 'SIDELINED'")
    return state.sidelined_groups_after(groups, outcome.select("group_id", F.col("reason").alias("sideline_reason_code")))


@query(
    "sidelined_messages sidelined_groups control_tasks",
    f"""select {_SIDELINED.replace("status, created", "case when group_id in (select group_id from control_tasks where task_type = 'UNSIDELINE_GROUP' and status = 'NEW') then 'UNSIDELINED' else status end as status, created")}
    from sidelined_messages""",
)
def release_groups(c, sidelined, groups, tasks):
    return state.release_groups(sidelined, groups, tasks.filter("task_type = 'UNSIDELINE_GROUP' and status = 'NEW'"))[0]


@query(
    "sidelined_messages sidelined_groups control_tasks",
    """select group_id from sidelined_groups where group_id not in (select group_id from (
      select * from control_tasks where status = 'NEW' order by id limit 100) t where task_type = 'UNSIDELINE_GROUP' and group_id is not null)""",
)
def released_group_rows(c, sidelined, groups, tasks):
    claimed = state.claim_control_tasks(tasks, 100)
    return state.release_groups(sidelined, groups, claimed.filter("task_type = 'UNSIDELINE_GROUP'"))[1]


@query(
    "sidelined_messages control_tasks",
    f"""select {_SIDELINED.replace("status, created", "case when message_id in (select message_id from control_tasks where task_type = 'UNSIDELINE_MESSAGE') then 'UNSIDELINED' else status end as status, created")}
    from sidelined_messages""",
)
def release_messages(c, sidelined, tasks):
    return state.release_messages(sidelined, tasks.filter("task_type = 'UNSIDELINE_MESSAGE'"))


_PERIOD = "updated_at between @as_of - interval 864000 second and @as_of - interval 86400 second"


@query("sidelined_messages", f"select {_SIDELINED.replace('status, created', f'''case when group_id is null and {_PERIOD} then 'UNSIDELINED' else status end as status, created''')} from sidelined_messages")
def release_ungrouped(c, sidelined):
    return state.release_ungrouped(sidelined, ago(c.as_of, 864_000), ago(c.as_of, 86_400))


@query(
    "sidelined_messages",
    """select 'UNSIDELINE_GROUP' as task_type, group_id, 'NEW' as status, @as_of - interval 1 year as from_date, @as_of + interval 1 year as to_date
    from (select distinct group_id from sidelined_messages where group_id is not null and updated_at between @as_of - interval 1 year and @as_of + interval 1 year) x
    union all select 'UNSIDELINE_ALL_UNGROUPED', null, 'NEW', @as_of - interval 1 year, @as_of + interval 1 year""",
)
def release_tasks_by_default(c, sidelined):
    return state.release_tasks(sidelined, *state.release_period(c.as_of))


@query(
    "sidelined_messages",
    f"""select 'UNSIDELINE_GROUP' as task_type, group_id, 'NEW' as status, @as_of - interval 864000 second as from_date, @as_of - interval 86400 second as to_date
    from (select distinct group_id from sidelined_messages where group_id is not null and {_PERIOD}) x
    union all select 'UNSIDELINE_ALL_UNGROUPED', null, 'NEW', @as_of - interval 864000 second, @as_of - interval 86400 second""",
)
def release_tasks(c, sidelined):
    return state.release_tasks(sidelined, ago(c.as_of, 864_000), ago(c.as_of, 86_400))


#: A read batch: so many tasks are claimed, by id.
CLAIM = 10_000
_CLAIMED = f"(select * from control_tasks where status = 'NEW' order by id limit {CLAIM})"
_NEW = "(select {0} from " + _CLAIMED + " c where task_type = '{1}' and {0} is not null)"


@query(
    "sidelined_messages control_tasks",
    f"""select {_SIDELINED.replace("status, created", f"case when group_id in {_NEW.format('group_id', 'UNSIDELINE_GROUP')} or message_id in {_NEW.format('message_id', 'UNSIDELINE_MESSAGE')} or (group_id is null and exists (select 1 from {_CLAIMED} t where t.task_type = 'UNSIDELINE_ALL_UNGROUPED' and sidelined_messages.updated_at between t.from_date and t.to_date)) then 'UNSIDELINED' else status end as status, created")}
    from sidelined_messages""",
)
def apply_control_tasks(c, sidelined, tasks):
    return state.apply_control_tasks(sidelined, state.claim_control_tasks(tasks, CLAIM))


@query("control_tasks", "select id, task_type, case when task_type = 'MANAGE_PARTITION' then 'FAILED' else 'DONE' end as status from control_tasks where status = 'NEW'")
def finished_control_tasks(c, tasks):
    return state.finished_tasks(tasks.filter("status = 'NEW'"), ["MANAGE_PARTITION"]).select("id", "task_type", "status")


@query("control_tasks", "select * from control_tasks where not (status = 'DONE' and updated_at < (select cast(max(o_orderdate) as date) from orders) - 700)")
def purge_control_tasks(c, tasks):
    last = c.spark.table("orders").agg(F.max("o_orderdate").cast("date").cast("string").alias("d")).first()["d"]
    return state.purge_control_tasks(tasks, F.lit(last).cast("date"), 700)


@query(
    "sidelined_messages sidelined_groups",
    f"""select {_SIDELINED.replace("status, created", '''case when (select count(*) from sidelined_groups) = 0 then case when status = 'PROCESSING' then 'UNSIDELINED' else status end
      when group_id is null then 'UNSIDELINED' when status = 'PROCESSING' and group_id in (select group_id from sidelined_groups) then 'SIDELINED'
      when status = 'PROCESSING' then 'UNSIDELINED' else status end as status, created''')} from sidelined_messages""",
)
def reset_processing(c, sidelined, groups):
    return state.reset_processing(sidelined, groups)


@query("skipped_ids", "select id, case when status = 'PROCESSING' then 'NEW' else status end as status from skipped_ids")
def reset_skipped(c, skipped):
    return state.reset_to_new(skipped).select("id", "status")


@query(
    "skipped_ids message_meta_data messages",
    f"""select coalesce(s.id, n.id) as id, coalesce(s.message_seq_id, n.id) as message_seq_id, coalesce(s.status, 'NEW') as status, coalesce(s.retry_count, 0) as retry_count,
      coalesce(s.created_at, @as_of) as created_at, case when n.id is not null then @as_of else s.updated_at end as updated_at
    from skipped_ids s full join (select unnest(generate_series(gap_start, gap_end - 1)) as id from {_GAPS_SQL} g) n on n.id = s.id""",
)
def skipped_upsert(c, skipped, metadata, messages):
    return state.skipped_upsert(skipped, skipped_ids_new(c, metadata, messages), c.as_of)


@query(
    "max_processed_message_sequence messages",
    f"""select coalesce(k.process_id, n.process_id) as process_id, coalesce(n.message_id, k.message_id) as message_id, case when n.process_id is not null then @as_of else k.updated_at end as updated_at
    from max_processed_message_sequence k full join (
      select concat('Processor_default_SP_', cast(bucket as varchar)) as process_id, arg_max(message_id, id) as message_id from {_BUCKETED_SQL} b group by bucket) n
      on n.process_id = k.process_id""",
)
def checkpoint_upsert(c, checkpoints, messages):
    changes = lanes.lane_checkpoints(lanes.with_bucket(messages, LANES))
    return state.checkpoint_upsert(checkpoints, changes, c.as_of)


# ---------------------------------------------------------------- retention

#: So small that some partitions have no sidelined row.
ARCHIVE_SIZE = 10
_STATS_SQL = f"""(select p as partition_no, p * {ARCHIVE_SIZE} + 1 as start_id, (p + 1) * {ARCHIVE_SIZE} as end_id, count(*) as n_rows, arg_max(created_at, id) as last_created_at
      from (select *, (id - 1) // {ARCHIVE_SIZE} as p from messages) x group by p)"""
_ARCHIVABLE_SQL = f"""(select partition_no, start_id, end_id, n_rows, last_created_at from (
      select s.*, max(case when date_diff('microsecond', last_created_at, @as_of) // 3600000000 < 240 or end_id >= (select max(id) from messages) then 1 else 0 end)
        over (order by start_id) as stopped from {_STATS_SQL} s) q
    where stopped = 0 and not coalesce((select min(m.id) from messages m join old_checkpoints k on k.message_id = m.message_id) < end_id, false)
      and partition_no not in (select (m.id - 1) // {ARCHIVE_SIZE} from messages m join sidelined_messages s on s.message_id = m.message_id))"""
_OLD_SQL = "old_checkpoints as (select * from max_processed_message_sequence where message_id is not null)"


def _archivable(c, messages, sidelined, checkpoints):
    return retention.archivable_partitions(messages, sidelined, checkpoints, c.as_of, 240, ARCHIVE_SIZE)


@query("messages sidelined_messages max_processed_message_sequence", f"select a.* from (with {_OLD_SQL} select * from {_ARCHIVABLE_SQL} z) a")
def archivable_partitions(c, messages, sidelined, checkpoints):
    return _archivable(c, messages, sidelined, checkpoints)


@query(
    "messages sidelined_messages max_processed_message_sequence message_meta_data",
    f"""select d.* from message_meta_data d, (with {_OLD_SQL} select max(end_id) as gone from {_ARCHIVABLE_SQL} z) a
    where a.gone is null or ((d.id - 1) // {ARCHIVE_SIZE} + 1) * {ARCHIVE_SIZE} > a.gone""",
)
def retained_rows(c, messages, sidelined, checkpoints, metadata):
    return retention.retained_rows(metadata, _archivable(c, messages, sidelined, checkpoints), ARCHIVE_SIZE, is_metadata=True)


@query(
    "messages sidelined_messages max_processed_message_sequence skipped_ids",
    f"""select k.id, k.status from skipped_ids k, (with {_OLD_SQL} select max(end_id) as gone from {_ARCHIVABLE_SQL} z) a
    where a.gone is null or ((k.id - 1) // {ARCHIVE_SIZE} + 1) * {ARCHIVE_SIZE} > a.gone""",
)
def retained_skipped(c, messages, sidelined, checkpoints, skipped):
    return retention.retained_rows(skipped, _archivable(c, messages, sidelined, checkpoints), ARCHIVE_SIZE).select("id", "status")


@query(
    "messages",
    f"""select cast(k * {SIZE} + 11999 as bigint) as end_id from (select unnest(generate_series(1, n)) as k from (
      select 25 - cast(trunc((11999 - ((max(id) // {SIZE} + 1) * {SIZE} - 1)) / {SIZE}) as bigint) - 1 as n from messages) x where n > 0) y""",
)
def partition_plan(c, messages):
    return retention.partition_plan(messages, 11_999, SIZE, 25)


# ------------------------------------------------------- routing and envelope

_PATTERNS = [("cl.*", "red"), ("view|error", "blue"), ("sign", "never")]


@query(
    "messages",
    """select id, cluster, concat(coalesce(cluster || '_', ''), 'messages') as messages_table, concat(coalesce(cluster || '_', ''), 'message_meta_data') as metadata_table
    from (select id, case when exchange_name like 'cl%' then 'red' when exchange_name in ('view', 'error') then 'blue' end as cluster from messages) x""",
)
def shard_route(c, messages):
    routed = messages.select("id", routing.shard_by_exchange(F.col("exchange_name"), _PATTERNS, None).alias("cluster"))
    messages_table, metadata_table = routing.shard_tables(F.col("cluster"))
    return routed.select("id", "cluster", messages_table.alias("messages_table"), metadata_table.alias("metadata_table"))


_WEEK_SQL = """case when year(cast({0} as date) + (6 - cast(dayofweek({0}) as integer))) > year({0}) then 1
    else (dayofyear({0}) + dayofweek(date_trunc('year', {0})) - 1) // 7 + 1 end"""


@query(
    "orders",
    f"""select o_orderkey, strftime(o_orderdate, 'h_%Y%m%d%H') as h, strftime(o_orderdate, 'd_%Y%m%d') as d, strftime(o_orderdate, 'm_%Y%m') as m,
      concat('w_', strftime(o_orderdate, '%Y'), lpad(cast({_WEEK_SQL.format("o_orderdate")} as varchar), 2, '0')) as w from orders""",
)
def time_shard(c, orders):
    return orders.select("o_orderkey", *[routing.shard_by_time(F.col("o_orderdate"), u).alias(u) for u in "hdmw"])


@query(
    "messages",
    """select id, shard, concat('outbound_messages', coalesce('_' || shard, '')) as legacy_table from (
      select id, case when id % 3 = 0 then strftime(created_at, 'd_%Y%m%d') when id % 3 = 1 then concat(exchange_name, '_', strftime(created_at, 'd_%Y%m%d')) else exchange_name end as shard from messages) x""",
)
def mixed_shard(c, messages):
    part = F.when(F.col("id") % 3 == 0, " ").otherwise(F.col("exchange_name"))
    time = F.when(F.col("id") % 3 < 2, routing.shard_by_time(F.col("created_at"), "d"))
    mixed = messages.select("id", routing.mixed_shard(part, time).alias("shard"))
    return mixed.select("id", "shard", routing.legacy_table(F.col("shard")).alias("legacy_table"))


@query(
    "messages",
    """select id, concat('http://relay/', exchange_type, 's/', exchange_name, '/messages') as uri, 'POST' as method,
      case when custom_headers is null or custom_headers = '{}' then 'j' else 'j' end as content, json_extract_string(custom_headers, '$.k') as k from messages""",
)
def relay_request(c, messages):
    row = outbox.outbox_projection(messages)
    headers = envelope.request_headers(F.create_map(F.lit("content"), F.lit("j")), F.col("custom_headers"))
    made = row.select("id", envelope.request_uri("http://relay/", F.col("exchange_type"), F.col("exchange_name")).alias("uri"), envelope.request_method(F.col("http_method")).alias("method"), headers.alias("h"))
    return made.select("id", "uri", "method", F.try_element_at("h", F.lit("content")).alias("content"), F.try_element_at("h", F.lit("k")).alias("k"))


@query(
    "messages",
    "select id, case when exchange_type = 'topic' then concat('E', json_extract_string(message, '$.k')) end as event_name, case when exchange_type = 'topic' then exchange_name end as topic_name from messages",
)
def topic_headers(c, messages):
    payload = F.concat(F.lit('{"event": "E'), F.get_json_object("message", "$.k"), F.lit('"}'))
    event, topic = envelope.topic_headers(F.upper("exchange_type"), F.col("exchange_name"), payload)
    return messages.select("id", event.alias("event_name"), topic.alias("topic_name"))


@query("messages", "select id, coalesce(upper(group_id), message_id) as group_id, concat('TXN-', message_id) as txn_id, '' as context, 0 as retries from messages")
def message_defaults(c, messages):
    return messages.select("id", envelope.default_group(F.col("group_id"), F.col("message_id")).alias("group_id"), envelope.transaction_id(F.col("message_id")).alias("txn_id"), F.lit("").alias("context"), F.lit(0).alias("retries"))


@query(
    "messages",
    """select id, concat(url, case when url like '%&%' then '&' else '?' end, 'messageIdQueryParam=', message_id) as reply_url from (
      select id, message_id, coalesce(case when id % 3 = 0 then concat('http://r/', exchange_name, '?a=1&b=2') when id % 3 = 1 then concat('http://r/', exchange_name) end, 'http://fallback/') as url from messages) x""",
)
def reply_url(c, messages):
    base = F.concat(F.lit("http://r/"), F.col("exchange_name"))
    url = F.when(F.col("id") % 3 == 0, F.concat(base, F.lit("?a=1&b=2"))).when(F.col("id") % 3 == 1, base)
    return messages.select("id", envelope.reply_url(url, F.lit("http://fallback/"), F.col("message_id")).alias("reply_url"))


