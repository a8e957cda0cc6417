"""Registered queries of the operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, decontam, embed_dedup, langid, minmax, packing, quality, token_count, token_matrix, warc
from ._common import ready


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op2_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = token_matrix.pack_matrix(table(spark, sf_dir, "documents"), width=2048)
    return m.select(
        "sequence_id", F.col("n_tokens").cast("long").alias("n_tokens"), F.size("doc_ids").cast("long").alias("n_segments"), "doc_ids", "pieces", "starts", "cu_seqlens",
        F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"),
    )


def op5_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=4096)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    joined = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"), size=3, num=85, den=100)


#: Time units between a page's capture, a failed capture and its revisit in op9's records.
FAILED_AFTER, REVISIT_AFTER = 2500, 5000


def page_records(pages: DataFrame) -> DataFrame:
    """Each page as a full response at time page_id, a failed response FAILED_AFTER later and a not-modified revisit REVISIT_AFTER later.

    Pages whose digest begins with 0 to 7 have an entity tag, all have a date, here made of their length. As record_id the page's id stands for all three."""
    digest = F.md5("html")
    tag = F.when(F.substring(digest, 1, 1) < "8", F.concat(F.lit('"'), digest, F.lit('"')))
    length = F.octet_length("html").cast("string")
    row = lambda kind, status, later, headers, body: pages.select(F.col("page_id").alias("record_id"), "url", (F.col("page_id") + later).alias("time"), F.lit(kind).alias("kind"), F.lit(status).alias("status"), headers.alias("headers"), body.alias("body"))
    fields = lambda *pairs: F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    none = F.lit(None).cast("string")
    full = fields(("ETag", tag), ("Last-Modified", length), ("Content-Length", length), ("Date", F.col("page_id").cast("string")), ("Server", F.lit("a")))
    again = fields(("etag", F.concat(F.lit("W/"), tag)), ("last-modified", length), ("Content-Length", F.lit("0")), ("date", (F.col("page_id") + REVISIT_AFTER).cast("string")), ("Expires", F.lit("never")))
    failed = row("response", 503, FAILED_AFTER, fields(("Server", F.lit("down"))), F.lit("unavailable"))
    some = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    return row("response", 200, 0, some(full), F.col("html")).unionByName(failed).unionByName(row("revisit", 304, REVISIT_AFTER, some(again), none))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = warc.resolve_revisits(page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    h = F.col("headers")
    return r.select(
        F.col("record_id").alias("page_id"), "canonical_url", F.col("base_id").alias("base_page_id"), "state",
        F.md5("body").alias("body_md5"), h["date"].alias("date"), h["content-length"].alias("content_length"), h["expires"].alias("expires"), h["server"].alias("server"), h["etag"].alias("etag"),
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), limit=512)


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_attention_lm, op3_language_id, op4_token_matrix, op5_swap_packing, op6_decontamination, op7_quality, op8_minmax_dedup, op9_warc_revisit, op10_token_counts)}

_CANONICAL = r"""
  with a as (select page_id, html, regexp_replace(trim(url), '#.*$', '') as f from pages),
  a2 as (select page_id, html, lower(regexp_extract(f, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, regexp_replace(f, '^[A-Za-z][A-Za-z0-9+.-]*://', '') as u from a),
  b as (select page_id, html, scheme, regexp_replace(lower(regexp_extract(u, '^[^/?]*', 0)), '^www[.]', '') as host, regexp_replace(u, '^[^/?]*', '') as rest from a2),
  c as (select page_id, html, case when scheme in ('', 'http') then regexp_replace(host, ':80$', '') when scheme = 'https' then regexp_replace(host, ':443$', '') else host end as host, regexp_replace(regexp_replace(rest, '([?&])(utm_[^&]*|ref=[^&]*)', '\1', 'g'), '&+', '&', 'g') as rest from b),
  p as (select page_id, html, case when substring(md5(html), 1, 1) < '8' then md5(html) end as tag, md5(html) as h, strlen(html) as n, host || regexp_replace(regexp_replace(regexp_replace(rest, '[?]&', '?', 'g'), '[?&]$', ''), '/$', '') as u from c)
"""

ORACLE = {
    "op1_embedding_dedup": """
  with recursive v as (
    select vec_id, label, list_transform(embedding, lambda x: x::double) as e,
           coalesce(label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) as ok
    from embeddings where vec_id is not null),
  u as (select vec_id, label, len(e) as d, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v where ok),
  l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) >= 0.93),
  r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on l.a = r.b),
  n as (select a, count(*) as n from l group by a),
  m as (select a, min(b) as c from r group by a)
  select m.a as vec_id, coalesce(n.n, 0)::bigint as n_links, m.c as component_id, m.a = m.c as kept from m left join n on n.a = m.a""",
    "op6_decontamination": r"""
  with d as materialized (select doc_id, r, text, list_filter(regexp_split_to_array(lower_ascii, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
             from (select doc_id, row_number() over () as r, text, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
  b as (select item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark where text is not null and item_id is not null),
  g as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as s from (select item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
  k as (select distinct n from g),
  o as (select r, i, n, item_id from (select r, n, unnest(range(1, len(w) - n + 2)) as i, w from d, k where len(w) >= n) x join g using (n) where g.s = array_to_string(x.w[i:i + n - 1], ' ')),
  w as (select distinct r, p from (select r, unnest(range(i, i + n)) as p from o)),
  h as (select r, count(*) as n_hit from w group by r),
  y as (select r, unnest(t) as s, unnest(range(len(t))) as k from (select r, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from d where r in (select r from h))),
  c as (select r, regexp_matches(s, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]') as is_word, length(s) as l, sum(regexp_matches(s, '^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]')::int) over (partition by r order by k) as p, sum(length(s)) over (partition by r order by k) as e from y),
  f as (select r, min(e - l)::bigint as a, max(e)::bigint as b from (select c.*, c.p - row_number() over (partition by r order by p) as run from c join w using (r, p) where is_word) group by r, run),
  x as (select r, string_agg(a || '-' || b, ',' order by a) as spans from f group by r),
  t as (select r, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as s from (select distinct r, item_id from o) group by r)
  select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(spans, '') as spans
  from d left join h using (r) left join t using (r) left join x using (r)""",
    "op8_minmax_dedup": r"""
  with recursive t as materialized (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents where doc_id is not null),
  g as materialized (select distinct doc_id, array_to_string(w[i:i + 2], ' ') as s from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) as i from t where len(w) > 0)),
  n as materialized (select doc_id, count(*) as n from g group by 1),
  p as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by all),
  l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
  e as materialized (select a, b from l union all select b, a from l),
  r as (select doc_id as a, doc_id as b from t union select r.a, e.b from r join e on e.a = r.b),
  m as (select a, min(b) as c from r group by a)
  select m.a as doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, m.a = m.c as kept from m left join n on n.doc_id = m.a""",
    "op9_warc_revisit": _CANONICAL
    + f""",
  m as (select q.page_id, max(p.page_id) as base from p q join p on p.u = q.u and p.page_id < q.page_id + {REVISIT_AFTER} group by q.page_id),
  s as (select q.page_id, q.u as canonical_url, m.base as base_page_id, b.h, b.n, b.tag as btag, q.tag as qtag,
          case when q.u is null then 'no_url' when b.page_id is null then 'no_base' when q.tag is not null and b.tag is not null then case when q.tag = b.tag then 'resolved' else 'mismatch' end
               when q.n is not null and b.n is not null then case when q.n = b.n then 'resolved' else 'mismatch' end else 'no_validator' end as state
        from p q left join m on m.page_id = q.page_id left join p b on b.page_id = m.base)
  select page_id, canonical_url, base_page_id, state,
    case when state = 'resolved' then h end as body_md5, case when state = 'resolved' then (page_id + {REVISIT_AFTER})::varchar end as date, case when state = 'resolved' then n::varchar end as content_length,
    case when state = 'resolved' then 'never' end as expires, case when state = 'resolved' then 'a' end as server, case when state = 'resolved' then coalesce('W/"' || qtag || '"', '"' || btag || '"') end as etag from s""",
}
