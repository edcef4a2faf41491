"""SQL that DuckDB runs for the queries of this package that SQL can express; the names are those of queries.py."""

from __future__ import annotations

#: Vectors that take part in op11, as whole numbers.
_WHOLE = """
select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
from embeddings
where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
"""

HARD_NEGATIVES = f"""
with whole as materialized ({_WHOLE}),
scored as materialized (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from whole a join whole b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select p.anchor_id, p.positive_id, (row_number() over w)::int as rank, s.other as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.other)
qualify row_number() over w <= 3
"""

EXACT_DEDUP = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by body) as group_size, row_number() over w = 1 as kept, sha256(body) as text_sha256
from t window w as (partition by body order by doc_id nulls last)
"""

#: The table of crc32 by its rule, then one step for each byte.
SPELLING = r"""
with recursive step0 as (select b::ubigint as b, b::ubigint as c, 0 as k from range(256) t(b)),
steps as (
  select * from step0 union all
  select b, case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end, k + 1 from steps where k < 8),
crc as materialized (select list(c order by b) as t from steps where k = 8),
runs as materialized (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents) group by all),
bytes as (
  select doc_id, run, n, list_transform(string_split(regexp_replace(hex(encode(coalesce(doc_id::varchar, '') || ':' || run)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h: ('0x' || h)::ubigint) as bytes from runs),
coded as materialized (
  select run, n, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255)::int + 1]), 4294967295::ubigint), 4294967295::ubigint) as code from bytes, crc),
words as materialized (
  select word, sum(n)::bigint as n from (
    select case when code % 97 = 0 then left(run, (code % length(run))::int) || substr(run, (code % length(run))::int + 2) else run end as word, n from coded)
  where length(word) >= 5 group by word having sum(n) >= 3),
less as materialized (select word, n, length(word) as size, i, left(word, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as materialized (
  select distinct a.word, b.word as other, b.n from less a join less b on a.i = b.i and a.rest = b.rest and a.size = b.size and a.word <> b.word
  union select a.word, b.word, b.n from less a join words b on b.word = a.rest
  union select b.word, a.word, a.n from less a join words b on b.word = a.rest),
best as (select word, count(*) as n_near, max(n) as top, min(other) filter (n = most) as form from (select *, max(n) over (partition by word) as most from near) group by word),
formed as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when top >= 2 * w.n then form end as form, case when top >= 2 * w.n then top end as form_n from words w left join best using (word)),
chain as (
  select word, form as root, 1 as k from formed where form is not null union all
  select c.word, f.form, k + 1 from chain c join formed f on f.word = c.root where f.form is not null)
select word, n, n_near, form, form_n, coalesce(root, word) as root
from formed left join (select word, arg_max(root, k) as root from chain group by word) using (word)
"""

NGRAM_JOIN = r"""
with recursive words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
sized as materialized (select doc_id, len(s) as n, s from sets),
flat as materialized (select doc_id, n, unnest(s) as x from sized),
links as materialized (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.x = b.x and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reached(node, root) as (select distinct a, a from links union select l.b, r.root from reached r join links l on l.a = r.node)
select s.doc_id, s.n as n_shingles, coalesce(r.root, s.doc_id) as component_id from sized s left join (select node, min(root) as root from reached group by node) r on r.node = s.doc_id
"""

EMBEDDING_DEDUP = """
with recursive vectors as materialized (
  select vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reached(node, root) as (select distinct a, a from links union select l.b, r.root from reached r join links l on l.a = r.node),
roots as (select node, min(root) as root from reached group by node), counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(root, vec_id) as component_id, coalesce(root, vec_id) = vec_id as kept from embeddings left join roots on node = vec_id left join counts on a = vec_id
"""
