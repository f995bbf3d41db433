"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptive_quality, bm25_packing, feistel, html_text, language_id, licenses, rlz, simhash, string_tiling, url_lists
from .common import table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many words, how many of them lie in passages of 20 or more that also start earlier, and a digest of the rest."""
    parsed = rlz.parse_corpus(table(spark, sf_dir, "documents"), layout="words")
    return parsed.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP1_SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 18)) as i,
         unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i + 19], ' ')))) as h
  from words where len(w) >= 20
), copies as (
  select doc_id, i from windows qualify row_number() over (partition by h order by doc_id, i) > 1
), gone as (
  select distinct doc_id, i + k as at from copies, range(20) t(k)
), each_word as (
  select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from words
), kept as (
  select e.doc_id, count(g.at) as n_removed, string_agg(e.word, ' ' order by e.at) filter (where g.at is null) as kept
  from each_word e left join gone g on g.doc_id = e.doc_id and g.at = e.at group by e.doc_id
)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(coalesce(k.n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from words w left join kept k using (doc_id)
"""

def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its main text and the text's length."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in documents, with how they differ from the template that compresses them best."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its counts, whether the base rules fail, and whether it stays within the fences of its language and source."""
    judged = adaptive_quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RATE_SQL = {x: f"(({top} * {scale}) // greatest({bottom}, 1))" for x, (top, bottom, scale, _, _) in adaptive_quality.RATES.items()}


def _bucket_sql(x: str) -> str:
    low = f"greatest(length(bin({x})) - {adaptive_quality.BITS}, 0)"
    return f"((({x}) >> {low}) << {low})"


def _fence_sql(by: list[str], tag: str) -> str:
    """Common table expressions for the fences by some keys."""
    key = ", ".join(by)
    lead = key + ", " if by else ""
    over = f"partition by {lead}rate"
    cols = []
    for x, (_, _, _, below, margin) in adaptive_quality.RATES.items():
        width = f"greatest(3 * (q3 - q1), {margin})"
        cols.append(f"max(case when rate = '{x}' then q3 + {width} end) as {x}_high")
        if below:
            cols.append(f"max(case when rate = '{x}' then q1 - {width} end) as {x}_low")
    return f"""
ranked_{tag} as (
  select {lead}rate, value, sum(n) over ({over} order by value) as upto, sum(n) over ({over}) as total
  from (select {lead}rate, value, sum(n) as n from sketch group by {lead}rate, value)
), quartiles_{tag} as (
  select {lead}rate, min(value) filter (where upto * 4 >= total) as q1, min(value) filter (where upto * 4 >= total * 3) as q3, max(total) as size
  from ranked_{tag} group by {lead}rate
), fences_{tag} as (
  select {lead}max(size) as size, {", ".join(cols)} from quartiles_{tag}{" group by " + key if by else ""}
)"""


def _bound(name: str) -> str:
    least = adaptive_quality.LEAST_GROUP
    return f"case when b.size >= {least} then b.{name} when l.size >= {least} then l.{name} else a.{name} end"


OP6_SQL = rf"""
with words as (
  select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select doc_id, unnest(range(1, len(w) - 6)) as i,
         unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) as h
  from words where len(w) >= 8
), repeated as (
  select doc_id, i from windows qualify count(*) over (partition by doc_id, h) > 1
), covered as (
  select doc_id, count(distinct i + k) as n_repeat_words from repeated, range(8) t(k) group by doc_id
), facts as (
  select doc_id, lang, source, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words
  from words left join covered using (doc_id)
), based as (
  select *, n_words < {adaptive_quality.LEAST_WORDS} or 100 * n_repeat_words > {adaptive_quality.MOST_REPEATED} * n_words as base_failed from facts
), sketch as (
  {" union all ".join(f"select lang, source, '{x}' as rate, {_bucket_sql(e)} as value, count(*) as n from based where not base_failed group by all" for x, e in _RATE_SQL.items())}
), {_fence_sql(["lang", "source"], "both")}, {_fence_sql(["lang"], "lang")}, {_fence_sql([], "all")}
select d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(f"coalesce({e} <= {_bound(x + '_high')}, true)" + (f" and coalesce({e} >= {_bound(x + '_low')}, true)" if adaptive_quality.RATES[x][3] else "") for x, e in _RATE_SQL.items())} as kept
from based d
left join fences_both b on d.lang is not distinct from b.lang and d.source is not distinct from b.source
left join fences_lang l on d.lang is not distinct from l.lang
cross join fences_all a
"""


_FETCHED_ON = "date_add(date '2024-01-01', cast(page_id % 366 as int))"


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the list entry in force on the day of its fetch; the tables hold no fetch day, so page_id sets one of 2024."""
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_FETCHED_ON).alias("fetched_on"))
    entries = spark.createDataFrame(url_lists.entry_rows(), "pattern string, list_name string, action string, since string")
    return url_lists.evaluate(captures, entries.withColumn("since", F.col("since").cast("date")))


_ENTRY_SQL = ", ".join(f"('{p}', '{n}', '{a}', date '{d}')" for p, n, a, d in url_lists.entry_rows())
OP7_SQL = rf"""
with entries(pattern, list_name, action, since) as (values {_ENTRY_SQL}),
day as (
  select pattern, list_name, since, max(case action when 'block' then 2 when 'allow' then 1 else 0 end) as strength
  from entries group by pattern, list_name, since
), valid as (
  select *, lead(since) over (partition by pattern, list_name order by since) as until from day qualify strength > 0
), captures as (
  select page_id, url, cast(date '2024-01-01' + cast(page_id % 366 as int) as date) as fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) as path
  from pages
), met as (
  select c.page_id, v.*, row_number() over (
    partition by c.page_id
    order by len(string_split(v.pattern, '/')) desc, len(string_split(string_split(v.pattern, '/')[1], '.')) desc, v.since desc, v.strength desc, v.list_name
  ) as place
  from captures c join valid v
    on c.fetched_on >= v.since and (v.until is null or c.fetched_on < v.until)
   and case when contains(v.pattern, '/') then starts_with(c.host || regexp_replace(c.path, '/+', '/', 'g') || '/', v.pattern || '/')
            else c.host = v.pattern or ends_with(c.host, '.' || v.pattern) end
)
select c.page_id, c.url, c.fetched_on, case m.strength when 2 then 'block' when 1 then 'allow' else 'none' end as verdict,
       m.pattern, m.list_name, m.since as valid_from
from captures c left join met m on m.page_id = c.page_id and m.place = 1
"""


def op8_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens, filled with lexical neighbours."""
    return bm25_packing.pack(table(spark, sf_dir, "documents"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its SimHash in hexadecimal and the smallest doc_id that links within two bits lead to."""
    near = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op2_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item at least half of whose words the document has under tiles."""
    return string_tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its shard and slot in a reproducible shuffle; shards differ by one row at most."""
    placed = feistel.shards(table(spark, sf_dir, "documents"), shards=OP3_SHARDS, key=OP3_KEY)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


OP3_SHARDS, OP3_KEY = 8, 20240229
_OP3_KEYS = ", ".join(f"{int(k)}::ubigint" for k in feistel.Permutation(2, OP3_KEY).keys)
_OP3_CRC = ", ".join(str(c) for c in feistel.crc_table())


def _xor_shift(x: str, bits: int) -> str:
    return f"xor({x}, {x} >> {bits})"


def _times(x: str, factor: int) -> str:
    """A product modulo 2^64."""
    return f"(({x})::uhugeint * {factor}::uhugeint % 18446744073709551616::uhugeint)::ubigint"


OP3_SQL = rf"""
with recursive raw as (
  select doc_id, strlen(coalesce(text, '')) as bytes, hex(encode(coalesce(text, ''))) as h from documents
), facts as (
  select doc_id, cast(bytes + 1 as bigint) as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::bigint)),
                         lambda c, b: xor(c >> 8, [{_OP3_CRC}][(xor(c, b) & 255) + 1])), 4294967295::bigint) as text_crc32
  from raw
), numbered as (
  select *, cast(row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as bigint) as row_number, count(*) over () as n from facts
), domain as (
  select *, greatest(1, (length(bin(greatest(n, 2) - 1)) + 1) // 2)::int as half from numbered
), start as (
  select row_number, n, half, ((1::ubigint << half) - 1)::ubigint as mask from domain
), net as (
  select row_number, n, half, mask, row_number::ubigint >> half as l, row_number::ubigint & mask as r, 0 as round, -1::bigint as place from start
  union all
  select row_number, n, half, mask,
         case when round < {feistel.ROUNDS} then r else r_out >> half end,
         case when round < {feistel.ROUNDS} then xor(l, {_xor_shift("m", 31)} & mask) else r_out & mask end,
         case when round < {feistel.ROUNDS} then round + 1 else 0 end,
         case when round < {feistel.ROUNDS} then -1 when r_out < n then r_out::bigint else -1 end
  from (
    select *, {_times(_xor_shift("m1", 27), 0x94D049BB133111EB)} as m from (
      select *, {_times(_xor_shift("z", 30), 0xBF58476D1CE4E5B9)} as m1, (r << half) | l as r_out from (
        select *, xor(r, [{_OP3_KEYS}][least(round, {feistel.ROUNDS - 1}) + 1]) as z from net where place < 0
      )
    )
  )
)
select d.doc_id, d.size, d.text_crc32, 'rows' as law, cast(p.place % {OP3_SHARDS} as int) as shard, p.place // {OP3_SHARDS} as slot,
       cast(null as double) as grown_shard, d.row_number
from numbered d join net p on p.row_number = d.row_number and p.place >= 0
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the language whose dictionary compresses it best, learnt from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()).select("text", "lang"))
    return language_id.classify(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_benchmark_leaks": op2_benchmark_leaks,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_html_text": op4_html_text,
    "op5_license_scan": op5_license_scan,
    "op6_adaptive_quality": op6_adaptive_quality,
    "op7_url_lists": op7_url_lists,
    "op8_bm25_packing": op8_bm25_packing,
    "op9_simhash_components": op9_simhash_components,
    "op10_language_id": op10_language_id,
}
ORACLE: dict[str, str] = {"op1_substring_dedup": OP1_SQL, "op3_feistel_shards": OP3_SQL, "op6_adaptive_quality": OP6_SQL, "op7_url_lists": OP7_SQL}
