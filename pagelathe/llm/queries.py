"""The operators' queries over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelathe.llm import capfilter, divergence, licenses, linefreq, mixing, ngrams, packing, secrets, simhash, substrings, toxicity, warc, whitening


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cap_filter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilter.embedding_links(read(spark, sf_dir, "embeddings"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linefreq.quality(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "left_words", "base_failed", "kept"
    )


def op4_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op5_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(read(spark, sf_dir, "documents"))


def op7_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op9_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.queue(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_license_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op11_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(read(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: All pairs in double precision, and components by the smallest id that is reached.
OP1_SQL = """with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
 u as (select *, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) as unit from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and list_inner_product(e, e) > 0),
 l as (select a.r, b.r as to_r from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.r <> b.r and list_inner_product(a.unit, b.unit) >= 0.93),
 reach as (select r, r as to_r from v union select reach.r, l.to_r from reach join l on reach.to_r = l.r),
 c as (select reach.r, min(v.vec_id) as component_id from reach join v on reach.to_r = v.r group by 1),
 n as (select r, count(*) as n_links from l group by 1)
 select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from v join c using (r) left join n using (r)"""

WORDS = r"'[^\x20\x09-\x0D]+'"
OP3_SQL = rf"""with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, text as raw, regexp_extract_all(coalesce(text, ''), {WORDS}) as ws from documents),
 w as (select r, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as a from d),
 g as (select r, i, a || ' ' || lead(a) over (partition by r order by i) || ' ' || lead(a, 2) over (partition by r order by i) as g from w),
 t as (select r, i, count(*) over (partition by r, g) as n from g where g is not null),
 rep as (select r, count(distinct i + k) as n_repeat_words from t, (values (0), (1), (2)) as o(k) where n > 1 group by 1),
 x as (select r, source, raw, line, regexp_replace(array_to_string(regexp_extract_all(lower(line), {WORDS}), ' '), '[0-9]+', '0', 'g') as h, len(regexp_extract_all(line, {WORDS})) as n from (select r, source, raw, unnest(string_split(text, chr(10))) as line from d)),
 y as (select * from x where n > 0),
 hosts as (select source, count(*) as host_documents from d group by 1),
 counts as (select source, h, count(distinct raw) as documents from y group by 1, 2 having count(distinct raw) >= 20),
 above as (select c.source, h from counts c join hosts b on c.source is not distinct from b.source where documents >= 0.005 * host_documents),
 removed as (select r, sum(n) as removed from y join above a on y.source is not distinct from a.source and y.h = a.h group by 1),
 dup as (select r, count(*) - count(distinct line) as n_dup_lines from y group by 1),
 f as (select doc_id, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda z: length(z))), 0)::bigint as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, (len(ws) - coalesce(removed, 0))::bigint as left_words from d left join rep using (r) left join dup using (r) left join removed using (r))
 select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and left_words >= 0.3 * n_words as kept from f"""

OP8_SQL = """with p as (select page_id, url, sha1(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes, count(*) over w as n, max(page_id) over w as last from pages window w as (partition by coalesce(html, '')))
 select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type, case when payload_bytes >= 1000 and page_id <> last then last end as refers_to, url from p"""


#: Windows as text, the smallest id that each starts in, and the words that no window of a larger id covers.
OP12_SQL = r"""with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') as ws from documents),
 w as (select r, doc_id, unnest(range(1, len(ws) - 11)) as i, ws from d where len(ws) >= 13),
 g as (select r, doc_id, i, array_to_string(ws[i:i+12], ' ') as g from w),
 h as (select *, min(doc_id) over (partition by g) as least from g),
 x as (select r, list(distinct i + k) as gone from h, (select unnest(range(13)) as k) where least < doc_id group by 1),
 y as (select doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed, list_filter(list_transform(ws, lambda z, j: case when gone is not null and list_contains(gone, j) then null else z end), lambda z: z is not null) as kept from d left join x using (r))
 select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from y"""

#: Every kept term of every group, with whole numbers of 128 bits.
OP13_SQL = r"""with d as (select row_number() over () as r, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
 t as (select r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from d),
 lt as (select lang, term, count(*)::hugeint as lc from t group by 1, 2 having count(distinct r) >= 3),
 l as (select lang, count(*)::hugeint as v, sum(lc)::hugeint as ln from lt group by 1),
 s as (select distinct lang, source from d),
 c as (select t.lang, source, term, count(*)::hugeint as c from t join lt using (lang, term) group by 1, 2, 3),
 n as (select s.lang, s.source, coalesce(sum(c), 0)::hugeint as n from s left join c on s.lang = c.lang and s.source = c.source group by 1, 2),
 p as (select n.lang, n.source, lt.term, coalesce(c.c, 0) as c, 1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (n + v) as p, 1 + (1000000000 * (lc + 1)) // (ln + v) as q
  from n join l on n.lang = l.lang join lt on n.lang = lt.lang left join c on n.lang = c.lang and n.source = c.source and lt.term = c.term),
 f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
 u as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value from s a join s b on a.lang = b.lang and a.source <> b.source left join f on a.lang = f.lang and a.source = f.source and b.source = f.item
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where c > 0 and p > q)
 select lang, source, part, item, value::bigint as value, rank::int as rank from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from u) where part = 'pair' or rank <= 200"""


def oracle_sql() -> dict[str, str]:
    """SQL for those of the queries that it can express: the others need XXH64, a tokenizer, CRC32, trained trees, eigenvectors or hundreds of patterns."""
    return {
        "op1_cap_filter_links": OP1_SQL,
        "op3_line_frequency": OP3_SQL,
        "op8_warc_transactions": OP8_SQL,
        "op12_substring_dedup": OP12_SQL,
        "op13_source_divergence": OP13_SQL,
    }
