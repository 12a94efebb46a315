"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.llm import audit, chat, clustering, decontaminate, fingerprints, html, language, licenses, lines, mixing, neardup, suffixtree, tokens
from gleanbox.llm.common import load


def op1_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(load(spark, sf_dir, "pages"))


def op2_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf_dir, "documents"))


def op3_minmax_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(load(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_recurring_lines(load(spark, sf_dir, "documents"))


def op5_whole_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(load(spark, sf_dir, "documents"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(load(spark, sf_dir, "documents"))


def op7_language_bitmasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held_out))
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = suffixtree.is_held_out(F.col("doc_id"))
    return suffixtree.score_texts(docs, held_out)


def op9_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_contingency_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(audit.filter_cells(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def op12_orchard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(load(spark, sf_dir, "embeddings"))


#: A conversation that is full of what other templates mark turns with.
_ODD = r"""select -7l as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, r'\### Assistant: </turn> ok' as text from range(2)"""


def op13_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(_ODD))
    return chat.record_digests(chat.format_conversations(turns))


QUERIES = (
    op1_page_differencing,
    op2_license_join,
    op3_minmax_hashing,
    op4_line_templates,
    op5_whole_tokens,
    op6_closed_syncmers,
    op7_language_bitmasks,
    op8_suffix_tree,
    op9_bm25_wand,
    op10_sainte_lague_mix,
    op11_contingency_audit,
    op12_orchard_search,
    op13_relational_chat,
)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*QUERIES, pipeline)}


#: op3 in SQL: sets of 3-word shingles, pairs by shared shingles, and all that can be reached.
_OP3 = r"""
with recursive docs as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') as w
  from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2]))) end as s
  from docs),
shingles as (select doc_id, len(s) as n, unnest(s) as x from sets),
pairs as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links as (select a, b from pairs union all select b, a from pairs),
reached(doc_id, other) as (
  select doc_id, doc_id from sets union select r.doc_id, l.b from reached r join links l on l.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sets s join (select doc_id, min(other) as component_id from reached group by doc_id) c on c.doc_id = s.doc_id
"""


#: op4 in SQL: distinct texts in place of hashes, and all pairs of texts in place of buckets for copies.
_OP4 = r"""
with texts as (select t, row_number() over () as k from (select distinct text as t from documents where text is not null)),
split as (select k, unnest(string_split(t, chr(10))) as raw, generate_subscripts(string_split(t, chr(10)), 1) - 1 as pos from texts),
plain as (select k, pos, raw, trim(regexp_replace(raw, '[ \t-\r]+', ' ', 'g'), ' ') as p from split),
masked as (select k, pos, length(raw) as chars, regexp_replace(p, '[^ ]*[0-9][^ ]*', '<*>', 'g') as line from plain),
lines as (select *, string_split(line, ' ') as tokens from masked),
holders as (select distinct k, line, tokens, len(tokens) as n, case when len(tokens) >= 40 then 3 else 10 end as need from lines where len(tokens) >= 3),
wordings as (select line, tokens, n, need, count(*) as n_texts from holders group by all),
tokens as (
  select line, n, need, tokens[1:3] as leaf, n_texts, unnest(tokens) as token, generate_subscripts(tokens, 1) - 1 as pos from wordings),
constants as (select n, leaf, pos, token, sum(n_texts) as c from tokens group by all),
words as (
  select t.line, t.n, t.need, t.pos, t.token, case when t.pos < 3 or c.c >= t.need then t.token else '<*>' end as word
  from tokens t join constants c on c.n = t.n and c.leaf = t.leaf and c.pos = t.pos and c.token = t.token),
templates as (
  select line, n, need, string_agg(word, ' ' order by pos) as template from words group by line, n, need
  having 5 * count(*) filter (word = '<*>' and token <> '<*>') <= n and 2 * count(*) filter (word = '<*>') <= n),
recurring as (
  select template from templates join holders using (line) group by template, templates.need having count(distinct k) >= templates.need),
hits as (select l.k, l.pos, t.template, l.chars from lines l join templates t on t.line = l.line join recurring r on r.template = t.template),
shares as (select k, template, sum(chars) as chars from hits group by k, template),
sizes as (select k, sum(chars) as every from lines group by k),
flagged as (
  select s.k, s.template, s.chars, z.every from shares s join sizes z on z.k = s.k
  where (select sum(o.chars) from shares o where o.k = s.k) >= 0.8::double * z.every),
copies as (
  select a.k from flagged a join flagged b on a.template = b.template and a.k <> b.k
  group by a.k, b.k, a.every, b.every having sum(least(a.chars, b.chars)) >= 0.8::double * greatest(a.every, b.every)),
drops as (select k, list(pos) as places from hits where k not in (select k from copies) group by k),
kept as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, x.places,
    list_filter(string_split(d.text, chr(10)), lambda line, i: not list_contains(x.places, i - 1)) as stay
  from documents d left join texts t on t.t = d.text left join drops x on x.k = t.k)
select doc_id, lang, source,
  case when places is null then text else array_to_string(stay, chr(10)) end as text,
  case when places is null then n_chars else cast(length(array_to_string(stay, chr(10))) as bigint) end as n_chars,
  cast(case when length(text) > 0 then len(string_split(text, chr(10))) else 0 end as bigint) as n_lines,
  cast(coalesce(len(places), 0) as bigint) as n_dropped
from kept
"""

#: op10 in SQL: every quotient of every source and shard is ranked, not only those that decide.
_OP10 = r"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) as bigint) as size,
    cast('0x' || substr(md5(concat_ws('|', '20240', cast(doc_id as varchar), coalesce(text, ''))), 1, 15) as bigint) as h
  from documents),
weighed as (
  select source, count(*) as n_docs, cast(sum(size) as bigint) as source_size, 3 * cast(sum(size) as double) as most,
    cast(1 + (row_number() over (order by source nulls last) - 1) % 3 as double) as weight
  from sized group by source),
levels as (
  select a.most / a.weight as ratio,
    ((select sum(source_size) from weighed) - coalesce(sum(b.most) filter (b.most / b.weight < a.most / a.weight), 0))
      / sum(b.weight) filter (b.most / b.weight >= a.most / a.weight) as level
  from weighed a cross join weighed b group by a.source, a.most, a.weight),
level as (select coalesce(min_by(level, ratio) filter (level <= ratio), max(ratio)) as level from levels),
sources as (select source, n_docs, source_size, least(most, level * weight) as target from weighed cross join level),
total as (select cast(round(sum(target) / 16) as bigint) as blocks from sources),
source_asks as (
  select source, row_number() over (order by target / (2 * k + 1) desc, source nulls last, k) as place
  from (select source, target, unnest(range(blocks)) as k from sources cross join total where target > 0)),
source_blocks as (select source, count(*) as blocks from source_asks where place <= (select blocks from total) group by source),
dealt as (
  select d.*, s.source_size, s.target, coalesce(b.blocks, 0) as blocks, d.h % cast(ceil(s.n_docs / 4096) as bigint) as shard
  from sized d join sources s on s.source is not distinct from d.source left join source_blocks b on b.source is not distinct from d.source),
shards as (select source, shard, blocks, sum(size) as shard_size from dealt group by all),
shard_asks as (
  select source, shard, blocks, row_number() over (partition by source order by shard_size / (2 * k + 1) desc, shard, k) as place
  from (select *, unnest(range(blocks)) as k from shards where shard_size > 0)),
quotas as (
  select s.source, s.shard, s.shard_size, least(16 * count(a.place), 3 * s.shard_size) as quota
  from shards s left join shard_asks a on a.source is not distinct from s.source and a.shard = s.shard and a.place <= a.blocks
  group by s.source, s.shard, s.shard_size),
streams as (
  select d.*, q.shard_size, q.quota,
    coalesce(sum(d.size) over (partition by d.source, d.shard order by d.h, d.doc_id nulls first rows between unbounded preceding and 1 preceding), 0) as before
  from dealt d join quotas q on q.source is not distinct from d.source and q.shard = d.shard)
select doc_id, size, source_size, target,
  cast(case when shard_size = 0 then 0 else (quota // shard_size) * size + least(greatest(quota % shard_size - before, 0), size) end as bigint) as taken
from streams
"""

#: op11 in SQL: every document is put through every order; no tensors.
_OP11 = r"""
with words as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as w from documents),
firsts as (select text, min(doc_id) as first_id from words group by text),
marks as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
failing as (
  select w.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
    concat(case when len(w.w) < 50 then 'A' else '' end, case when 100 * len(list_distinct(w.w)) < 65 * len(w.w) then 'B' else '' end,
      case when 100 * length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) > 5 * length(w.text) then 'C' else '' end,
      case when regexp_matches(w.text, '[#$%&*|]') then 'D' else '' end, case when w.doc_id > f.first_id then 'E' else '' end) as fails
  from words w join firsts f on f.text = w.text left join marks m on m.doc_id = w.doc_id),
cells as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failing group by part, fails),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as c),
orders as (
  select concat(a.c, b.c, c.c, d.c, e.c) as filter_order from letters a, letters b, letters c, letters d, letters e
  where a.c <> b.c and c.c not in (a.c, b.c) and d.c not in (a.c, b.c, c.c) and e.c not in (a.c, b.c, c.c, d.c)),
steps as (select filter_order, s as step, substr(filter_order, s, 1) as filter, substr(filter_order, 1, s - 1) as earlier from orders, (select unnest(range(1, 6)) as s)),
met as (
  select s.*, c.part, c.n, c.good, c.toxic, contains(c.fails, s.filter) as hit, c.fails = s.filter as only_hit,
    length(translate(c.fails, s.earlier, '')) < length(c.fails) as gone
  from steps s cross join cells c),
figures as (
  select part, filter_order, step, filter,
    coalesce(sum(n) filter (not gone and not hit), 0) as kept, coalesce(sum(n) filter (not gone and hit), 0) as removed,
    coalesce(sum(n) filter (gone and hit), 0) as redundant, coalesce(sum(n) filter (only_hit), 0) as unique_fails,
    coalesce(sum(good) filter (not gone and hit), 0) as good_lost, coalesce(sum(toxic) filter (not gone and hit), 0) as toxic_lost
  from met group by all)
select part, filter_order, cast(step as int) as step, filter, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, filter) as bigint) as shapley
from figures
"""


def _op12() -> str:
    """op12 in SQL: in each round every vector is compared with every centroid."""
    near = """near{r} as materialized (
  select id, vec_id, v, arg_min(c, (d, c)) as cluster, min(d) as distance
  from (select x.id, x.vec_id, x.v, m.c, list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from vecs x cross join mids{r} m)
  group by id, vec_id, v)"""
    moved = """sums{r} as (
  select cluster, pos, sum(x)::bigint as s, count(*) as n from (select cluster, unnest(v) as x, generate_subscripts(v, 1) as pos from near{r}) group by cluster, pos),
mids{s} as materialized (
  select m.c, coalesce(t.v, m.v) as v from mids{r} m
  left join (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by pos) as v from sums{r} group by cluster) t on t.cluster = m.c)"""
    rounds = [part.format(r=r, s=r + 1) for r in range(clustering.ROUNDS) for part in (near, moved)]
    return (
        """
with vecs as materialized (
  select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * x::double) as bigint)) as v
  from embeddings where len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(embedding) = 64),
mids0 as materialized (select row_number() over (order by h nulls last, v) - 1 as c, v from (select sha256(concat('1:', vec_id::varchar)) as h, v from vecs order by h, v limit 16)),
"""
        + ",\n".join([*rounds, near.format(r=clustering.ROUNDS)])
        + f"""
select n.vec_id, cast(n.cluster as int) as cluster, cast(n.distance as bigint) as distance,
  cast(sum(n.distance) over (partition by n.cluster) as bigint) as cluster_inertia, cast(sum(n.distance) over () as bigint) as inertia,
  sha256(array_to_string(m.v, ',')) as centroid_sha256
from near{clustering.ROUNDS} n join mids{clustering.ROUNDS} m on m.c = n.cluster
"""
    )


#: op13 in SQL: digests of the turns themselves; the formatted length from the template's marks.
_OP13 = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
    coalesce(lag(role) over (partition by conv_id order by turn nulls first, role, text) = role, false) as goes_on,
    length(regexp_replace(text, '<(\\*)\|', '<\\\\\1|', 'g')) as text_chars, length(regexp_replace(role, '<(\\*)\|', '<\\\\\1|', 'g')) as role_chars
  from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(text_chars + case when goes_on then length('<|more|>') else role_chars + length(concat('<|turn|>', '<|says|>', '<|end|>', chr(10))) end) as bigint) as formatted_chars
from placed group by conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_minmax_hashing": _OP3, "op4_line_templates": _OP4, "op10_sainte_lague_mix": _OP10, "op11_contingency_audit": _OP11, "op12_orchard_search": _op12(), "op13_relational_chat": _OP13}
