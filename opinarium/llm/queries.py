"""One query for each operator, over its whole table, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpacking, hnsw, lexical, media, minhash, packing, pieces, pii, quality, repeats, spelling, urls, wrappers
from .common import table

# The rules of op3, and the hosts that its list blocks.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
LISTED = [f"{name}.example.{top}/" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]


def op1_embedding_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.link_vectors(table(spark, sf_dir, "embeddings"))


def op2_subword_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.entries(spark, RULES, LISTED)).select("page_id", "host", "path", "rule", "verdict")


def op4_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wrappers.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.MediaStore(table(spark, sf_dir, "documents")).verified()


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpacking.pack(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_embedding_graphs, op2_subword_transducer, op3_url_filter, op4_suffix_arrays, op5_wrappers, op6_minhash, op7_packing, op8_media_chunks, op9_pii, op10_quality, op11_lexical_search, op12_spelling_variants, op13_best_fit_packing)}

_FITS = "({0} = split_part(r.key, '/', 1) or ends_with({0}, '.' || split_part(r.key, '/', 1))) and starts_with({1}, substr(r.key, strpos(r.key, '/')))"
_NAMED, _LISTED = _FITS.format("p.host", "p.path"), _FITS.format("p.plain", 'p."full"')

ORACLES: dict[str, str] = {
    "op1_embedding_graphs": """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
near as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach(node, other) as (
  select vec_id, vec_id from embeddings union select r.node, near.b from reach r join near on near.a = r.other),
counts as (select a, count(*) as n from near group by a),
low as (select node, min(other) as component_id from reach group by node)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join low l on l.node = e.vec_id left join counts c on c.a = e.vec_id""",
    "op3_url_filter": f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
p as (select *, regexp_replace(host, '^.*@|\\.?(:[0-9]*)?$', '', 'g') as plain, case when path = '' then '/' else path end as "full" from u),
r(key, action, named) as (values {', '.join([f"('{key}', '{action}', true)" for action, key in RULES] + [f"('{key}', 'block', false)" for key in LISTED])})
select page_id, host, path,
  (select r.key from r where named and {_NAMED} order by length(r.key) desc limit 1) as rule,
  coalesce((select r.action from r where named and {_NAMED} order by length(r.key) desc limit 1),
           (select 'block' from r where not named and p.host <> '' and {_LISTED} limit 1), 'allow') as verdict
from p""",
    "op4_suffix_arrays": r"""
with t as materialized (
  select doc_id, coalesce(text, '') as x, row_number() over () as r, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, '')))::bigint as n from documents),
w as (select r, unnest(range(0, n - 399)) as s, h from t where n >= 400),
k as (select r, s, md5_number(substr(h, 2 * s + 1, 800)) as k from w),
hit as (select r, s from (select r, s, count(*) over (partition by k) as c from k) where c > 1),
run as (select r, s, s > lag(s, 1, -401) over (partition by r order by s) + 400 as fresh from hit),
span as (select r, min(s) as a, max(s) + 400 as b from (select r, s, sum(fresh::int) over (partition by r order by s) as g from run) group by r, g),
gaps as (select r, b as a, lead(a, 1, null) over (partition by r order by a) as b from span union all select r, 0, min(a) from span group by r),
kept as (select t.r, string_agg(substr(h, 2 * gaps.a + 1, 2 * (coalesce(gaps.b, n) - gaps.a)), '' order by gaps.a) as h from gaps join t using (r) group by t.r),
gone as (select r, sum(b - a)::bigint as n_removed, count(*) as n_spans from span group by r),
ws as (select r, list_filter(regexp_split_to_array(x, '[ \t\n\x0b\f\r]+'), lambda w: w <> '') as w from t),
wk as (select r, unnest(range(1, len(w) - 48)) as s, w from ws where len(w) >= 50),
wh as (select r, s, count(*) over (partition by md5_number(array_to_string(w[s:s + 49], ' '))) as c from wk),
wc as (select r, least(50, s - lag(s, 1, -50) over (partition by r order by s)) as more from wh where c > 1),
wn as (select r, sum(more)::bigint as n from wc group by r)
select doc_id, t.n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(kept.h, t.h))) as kept_sha256, coalesce(wn.n, 0)::bigint as n_repeated_words
from t left join gone using (r) left join kept using (r) left join wn using (r)""",
    "op6_minhash": r"""
with recursive t as (
  select text, min(doc_id) as node,
         list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as w
  from (select doc_id, coalesce(text, '') as text from documents) group by text),
s as (
  select distinct node, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as shingle
  from t where len(w) > 0),
n as (select node, count(*) as n from s group by node),
links as (
  select a.node as a, b.node as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.node <> b.node group by a.node, b.node),
near as (
  select a, b from links join n x on x.node = a join n y on y.node = b where c >= 0.8 * (x.n + y.n - c)),
reach(node, other) as (
  select node, node from t union select r.node, near.b from reach r join near on near.a = r.other)
select d.doc_id, min(r.other) as class_id, d.doc_id = min(r.other) as kept
from documents d join t on t.text = coalesce(d.text, '') join reach r on r.node = t.node
group by d.doc_id""",
    "op8_media_chunks": r"""
with tab as materialized (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
t as (select doc_id, row_number() over () as r, octet_length(encode(coalesce(text, '')))::bigint as n, hex(encode(coalesce(text, ''))) as h from documents),
p as materialized (select doc_id, r, n, greatest(64, (n + 63) // 64 * 64) as m, h || repeat('00', (greatest(64, (n + 63) // 64 * 64) - n)::bigint) as h from t),
b as (select r, unnest(range(0, m)) as i, h from p),
x as (select r, i, ('0x' || substr(h, 2 * i + 1, 2))::bigint - 128 as v from b),
f as (select r, printf('mean=%.4f;rms=%.4f;crossings=%d', sum(v) / count(*)::double, sqrt(sum(v * v) / count(*)::double), count_if((v < 0) <> (before < 0))) as feature
  from (select *, lag(v) over (partition by r order by i) as before from x) group by r),
le as (select r, printf('%02x%02x%02x%02x', m & 255, (m >> 8) & 255, (m >> 16) & 255, m >> 24) as size, printf('%02x%02x%02x%02x', (m + 36) & 255, ((m + 36) >> 8) & 255, ((m + 36) >> 16) & 255, (m + 36) >> 24) as riff from p)
select doc_id, n as n_bytes, m as payload_bytes, sha256(unhex(h)) as payload_sha256,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(m - 64, m), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) as tail_crc32,
  m + 44 as media_bytes,
  sha256(unhex('52494646' || riff || '57415645666d7420' || '10000000' || '0100' || '0100' || '401f0000' || '401f0000' || '0100' || '0800' || '64617461' || size || h)) as media_sha256, feature
from p join f using (r) join le using (r) cross join tab""",
    "op11_lexical_search": r"""
with d as (select doc_id, row_number() over () as r, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
tf as materialized (select r, any_value(doc_id) as doc_id, term, count(*) as tf from d group by r, term),
len as materialized (select r, sum(tf)::bigint as n from tf group by r),
total as (select count(*)::bigint as nd, sum(n)::bigint as nt from len),
df as (select term, count(*) as df from tf group by term),
i as (select item_id, row_number() over () as q, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
w as (select item_id, q, term, floor(1000 * ln((2 * nd + 2)::double / (2 * df + 1)::double))::bigint as w from i join df using (term) cross join total),
s as (
  select q, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // nt))))::bigint as score
  from w join tf using (term) join len using (r) cross join total group by q, r),
ranked as (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50""",
    "op12_spelling_variants": r"""
with recursive tab as materialized (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
runs as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
each as (select id, run, count(*) as c from runs group by id, run),
bytes as (select run, c, hex(encode(id || ':' || run)) as h from each),
sums as (select run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) as h from bytes cross join tab),
shortened as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, c from sums),
words as materialized (select word, sum(c)::bigint as n from shortened where length(word) >= 5 group by word having sum(c) >= 3),
cut as materialized (select distinct word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
pairs as materialized (
  select a.word, b.word as other, b.n as m from cut a join cut b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from cut a join words b on a.rest = b.word
  union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
best as materialized (
  select w.word, w.n, count(p.other) as n_near, arg_min(p.other, struct_pack(less := -p.m, other := p.other)) as other, max(p.m) as m
  from words w left join pairs p using (word) group by w.word, w.n),
judged as materialized (select word, n, n_near, case when m >= 2 * n then other end as form, case when m >= 2 * n then m end as form_n from best),
led(word, root, depth) as (select word, word, 0 from judged union all select led.word, j.form, depth + 1 from led join judged j on j.word = led.root where j.form is not null),
last as (select word, arg_max(root, depth) as root from led group by word)
select word, form, root, n, n_near, form_n from judged join last using (word)""",
}
