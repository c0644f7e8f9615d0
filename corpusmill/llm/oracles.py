"""DuckDB SQL for the queries that SQL can express."""

ORACLES = {
    "op2_exact_dedup": r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       doc_id = min(doc_id) over (partition by text_sha256) as kept, text_sha256
from t
""",
    "op5_bit_sliced_top_k": """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from s)
select query_id, cast(n as integer) as rank, vec_id, score from r where n <= 20
""",
    "op12_hard_negatives": """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
         cast(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as n from s where same),
r as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as n
  from p join s on p.anchor_id = s.anchor_id
  where p.n <= 5 and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select anchor_id, positive_id, cast(n as integer) as rank, negative_id, positive_score, negative_score from r where n <= 10
""",
    "op9_ngram_join": r"""
with recursive words as (
  select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from (
    select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents where text is not null)),
runs as (
  select doc_id, i, count(*) over (partition by doc_id) as n,
         concat_ws(' ', word, lead(word) over o, lead(word, 2) over o) as gram
  from words window o as (partition by doc_id order by i)),
grams as (select distinct doc_id, gram from runs where i <= greatest(1, n - 2)),
sizes as (select doc_id, count(gram) as n_shingles from documents left join grams using (doc_id) group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from grams a join grams b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from common join sizes x on a = x.doc_id join sizes y on b = y.doc_id
  where 100 * c >= 90 * (x.n_shingles + y.n_shingles - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id as node, doc_id as least from documents
  union
  select l.b, r.least from reach r join both_ways l on l.a = r.node)
select doc_id, n_shingles, min(least) as component_id
from sizes join reach on doc_id = node group by doc_id, n_shingles
""",
}
