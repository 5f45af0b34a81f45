"""One query per operator, over its whole table, with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import ann, binary_records, bpe, html_extract, line_dedup, packing, quality, sharding, simhash, warc
from millrace.llm.common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.captures_of(read_table(spark, sf_dir, "pages")), stretch=10_000)
    header = lambda name: F.element_at("headers", name)
    return resolved.select(
        "record_id",
        "key",
        "base_id",
        "outcome",
        F.col("status").cast("bigint").alias("status"),
        header("etag").alias("etag"),
        header("content-type").alias("content_type"),
        header("x-fetch").alias("x_fetch"),
        F.md5("payload").alias("payload_md5"),
        F.length("payload").cast("bigint").alias("payload_chars"),
    )


OP2_SQL = r"""
with captures as (
  select 2 * page_id as record_id, url, 10 * page_id as captured, true as is_full,
         '"' || md5(html) || '"' as etag, 'day ' || cast(page_id // 97 as varchar) as modified, html
  from pages
  union all
  select 2 * page_id + 1,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^http://', 'https://')
           || case when contains(url, '?') then '&' else '?' end || 'utm_medium=revisit#again',
         10 * page_id + 25, false,
         case when page_id % 11 = 0 then null when page_id % 7 = 0 then '"new"' else 'W/"' || md5(html) || '"' end,
         'day ' || cast(page_id // 97 as varchar), null
  from pages
),
bare as (
  select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.\-]*://', '') as b from captures
),
parts as (
  select *, regexp_replace(regexp_replace(lower(regexp_extract(b, '^[^/?]*')), '^[^@]*@', ''), '^www\.', '') as host,
         regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') as path,
         list_filter(list_sort(string_split(regexp_extract(b, '\?(.*)$', 1), '&')),
           lambda x: x <> '' and not regexp_matches(lower(x), '^(?:utm_[^=&]*|gclid|fbclid|msclkid|ref|sessionid|phpsessid)(?:=.*)?$')) as params
  from bare
),
keyed as (
  select *, regexp_replace(host, ':(80|443)$', '') || path
    || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as key
  from parts
),
based as (
  select *, last_value(case when is_full then record_id end ignore nulls) over (
    partition by key order by captured, record_id rows between unbounded preceding and 1 preceding) as base_id
  from keyed
),
joined as (
  select r.record_id, r.key, r.base_id, r.etag as own, r.modified as own_modified, f.etag as stored, f.modified as stored_modified, f.html
  from based r left join keyed f on f.record_id = r.base_id and f.is_full where not r.is_full
),
judged as (
  select *, case when base_id is null then 'orphan'
    when own is not null and stored is not null then case when regexp_replace(own, '^W/', '') = stored then 'etag' else 'mismatch' end
    when own_modified = stored_modified then 'last-modified' else 'mismatch' end as outcome
  from joined
)
select record_id, key, base_id, outcome,
  cast(case when outcome in ('etag', 'last-modified') then 200 else 304 end as bigint) as status,
  case when outcome in ('etag', 'last-modified') then coalesce(own, stored) else own end as etag,
  case when outcome in ('etag', 'last-modified') then 'text/html' else 'text/plain' end as content_type,
  '2' as x_fetch,
  case when outcome in ('etag', 'last-modified') then md5(html) end as payload_md5,
  cast(case when outcome in ('etag', 'last-modified') then length(html) end as bigint) as payload_chars
from judged
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_hash_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_rows(read_table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    manifest = binary_records.write_records(docs, public_tokenizers.path("word_bpe_49k.json"))
    back = binary_records.read_records(spark, manifest)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html_extract.extract_pages(read_table(spark, sf_dir, "pages"))
    text = F.array_join("blocks", "\n")
    return blocks.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"))


def op7_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    return judged.drop("n_lines", "n_marks", "n_upper", "group_rows")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.encode(read_table(spark, sf_dir, "documents"), path, decoded=True)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_simhash_near_dedup, op2_warc_revisits, op3_best_fit_packing, op4_hash_ring_sharding, op5_binary_records, op6_wrapper_extraction, op7_projected_neighbours, op8_fuzzy_line_dedup, op9_quality_rules, op10_byte_bpe]
    return {query.__name__: query for query in named}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_revisits": OP2_SQL}
