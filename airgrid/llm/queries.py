"""Registered queries of this subpackage and the DuckDB SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_digests
from .decontaminate import contamination
from .host_reputation import judge_urls, junk_outcome
from .jaccard_join import near_duplicates
from .language import identify
from .merkle import manifest
from .mixing import mix
from .repetition import judge_repetition
from .sharding import shard_by_bytes
from .token_files import token_digests
from .toxicity import fit, score_toxicity
from .warc import derive, record_text, responses
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = mix(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "first_slot")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge_repetition(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("item_ids", ",").cast("binary"), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


def op6_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shard_by_bytes(_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = derive(responses(_table(spark, sf_dir, "pages")))
    sha = F.sha2(record_text().cast("binary"), 256)
    return got.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "content_length", sha.alias("record_sha256"))


#: Action, host and path of each rule.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, junk_outcome(pages["html"])).select("page_id", "host", "path", "rule", "verdict")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = identify(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))
    return got.withColumn("confidence", F.round("confidence", 6))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return manifest(docs, tampered=F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_files": op2_token_files,
    "op3_repetition": op3_repetition,
    "op4_decontamination": op4_decontamination,
    "op5_warc_derivatives": op5_warc_derivatives,
    "op6_shard": op6_shard,
    "op7_host_reputation": op7_host_reputation,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language": op10_language,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_whitening": op13_whitening,
}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

_PART = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF = "sha256(" + " || ".join([*(_PART.format(f"{c}::varchar") for c in ("doc_id", "source", "lang", "n_chars")), _PART]) + ")"

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": f"""
with recursive d as (select doc_id, source, {_LEAF.format("text")} leaf,
  case when doc_id is not null and xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: unicode(c)::bigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 5 = 0 then {_LEAF.format(_LOWER.format("text"))} else {_LEAF.format("text")} end odd from documents),
r as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 number, dense_rank() over (order by source nulls first) - 1 tree from d),
lv(tree, level, idx, digest, n) as (select tree, 0, number, leaf, count(*) over (partition by tree) from r
  union all select tree, level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (n + 15) // 16 from lv where n > 1 group by tree, level, idx // 16, n),
s as (select tree, level deep, digest from lv where n = 1),
tp(level, idx, digest, n) as (select 0, tree, digest, count(*) over () from s
  union all select level + 1, idx // 16, sha256(string_agg(digest, '' order by idx)), (n + 15) // 16 from tp where n > 1 group by level, idx // 16, n),
u as (select tree, level, idx // 16 up, list(digest order by idx) g from lv where n > 1 group by all),
tu as (select level, idx // 16 up, list(digest order by idx) g from tp where n > 1 group by all),
c(tree, number, level, idx, h, sib) as (select tree, number, 0, number, odd, '' from r
  union all select c.tree, number, c.level + 1, idx // 16, sha256(array_to_string(list_concat(g[1:idx % 16], [h], g[idx % 16 + 2:]), '')), sib || array_to_string(list_concat(g[1:idx % 16], g[idx % 16 + 2:]), '')
  from c join u on u.tree = c.tree and u.level = c.level and u.up = c.idx // 16),
e(tree, number, level, idx, h, sib) as (select c.tree, number, 0, c.tree, h, sib from c join s on s.tree = c.tree and s.deep = c.level
  union all select e.tree, number, e.level + 1, idx // 16, sha256(array_to_string(list_concat(g[1:idx % 16], [h], g[idx % 16 + 2:]), '')), sib || array_to_string(list_concat(g[1:idx % 16], g[idx % 16 + 2:]), '')
  from e join tu on tu.level = e.level and tu.up = e.idx // 16)
select r.doc_id, r.leaf, s.digest subroot, z.digest root, sha256(sib) proof_sha256, h folded_root, h = z.digest verified
from r join s using (tree) join e on e.tree = r.tree and e.number = r.number and e.level = (select max(level) from tp), (select digest from tp where n = 1) z""",
    "op1_mix_sources": f"""
with recursive d as (select doc_id, source, len({_WORDS.format("text")})::bigint size from documents),
s as (select source, sum(size)::double n, row_number() over (order by source nulls last) - 1 k from d group by source),
w as (select *, case k % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double w, 3 * n cap from s),
r as (select *, coalesce(sum(cap) over (order by cap / w, k rows between unbounded preceding and 1 preceding), 0) capped,
      sum(w) over (order by cap / w, k rows between current row and unbounded following) open, (select sum(n) from s) total from w where n > 0),
lv as (select (total - capped) / open level from r where (total - capped) / open <= cap / w order by cap / w, k limit 1),
t as (select w.source, w.n, case when n = 0 then 0 when (select level from lv) is null then cap else least(cap, w * (select level from lv)) end target from w),
g as (select source, n::bigint source_size, target, least(floor(target + 0.5), floor(3 * n))::bigint take from t),
gs as (select *, (take + 255) // 256 slots, sum((take + 255) // 256) over (order by source nulls last) - (take + 255) // 256 lo from g),
tot as (select sum(slots)::bigint n, greatest(1, round(sum(slots) / ((1 + sqrt(5)) / 2)))::bigint m0 from gs),
cf(x, a, b, s) as (select x, n, x, 0::bigint from tot, unnest(range(m0, m0 + 64)) r(x) union all select x, b, a % b, s + a // b from cf where b > 0),
st as (select n, (select x from cf where b = 0 and a = 1 order by s, x limit 1) m from tot),
sl as (select i slot, (i::hugeint * m % n)::bigint point from st, range((select n from tot)) r(i)),
sb as (select slot, source, row_number() over (partition by source order by slot) - 1 block from sl join gs on point >= lo and point < lo + slots),
o as (select d.*, g.source_size, g.target, g.take, coalesce(sum(size) over (partition by g.source order by
      substr(md5(concat_ws('|', d.doc_id::varchar, d.size::varchar, '7')), 1, 32), d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint pos
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, round(target, 6) target,
  (case when size = 0 then 0 else (take // source_size) * size + greatest(0, least(pos + size, take % source_size) - pos) end)::bigint taken, sb.slot::bigint first_slot
  from o left join sb on o.source is not distinct from sb.source and sb.block = o.pos // 256 and o.size > 0 and o.pos < o.take""",
    "op3_repetition": rf"""
with d as (select doc_id, coalesce(text, '') t, {_WORDS.format("text")} w from documents),
g as (select doc_id, p, list_slice(w, p, p + 4) x from d, unnest(range(1, len(w) - 3)) u(p)),
f as (select doc_id, p from g qualify count(*) over (partition by doc_id, x) > 1),
rw as (select doc_id, count(distinct q) n from f, unnest(range(p, p + 5)) u(q) group by 1),
l as (select doc_id, unnest(string_split(t, chr(10))) line from d),
dl as (select doc_id, sum(c - 1) n from (select doc_id, line, count(*) c from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1, 2) group by 1),
k as (select doc_id, w, greatest(50, len(w) // 10) + 1 m from d),
lg as (select distinct doc_id from (select doc_id, list_slice(w, p, p + m - 1) x from k, unnest(range(1, len(w) - m + 2)) u(p) where len(w) >= m) group by doc_id, x having count(*) > 1),
b as (select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  coalesce(dl.n, 0)::bigint n_dup_lines, coalesce(rw.n, 0)::bigint n_repeat_words from d left join rw using (doc_id) left join dl using (doc_id))
select b.*, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lg.doc_id is null kept from b left join lg using (doc_id)""",
    "op4_decontamination": rf"""
with i as (select item_id, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
iw as (select distinct item_id, n, list_slice(w, p, p + n - 1) x from (select item_id, w, least(10, len(w)) n from i where len(w) > 0) z, unnest(range(1, len(w) - n + 2)) u(p)),
d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
dw as (select doc_id, n, p, list_slice(w, p, p + n - 1) x from d, (select distinct n from iw) z, unnest(range(1, len(w) - n + 2)) u(p) where len(w) >= n),
h as (select doc_id, dw.n, p, item_id from dw join iw using (x)),
c as (select doc_id, count(distinct q) n_hit from h, unnest(range(p, p + n)) u(q) group by 1),
t as (select doc_id, count(*) n_items, string_agg(v, ',' order by v) ids from (select distinct doc_id, item_id::varchar v from h) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join c using (doc_id) left join t using (doc_id)""",
    "op9_near_duplicates": rf"""
with recursive d as (select doc_id, {_WORDS.format(_LOWER.format("text"))} w from documents),
s as (select distinct doc_id, array_to_string(list_slice(w, p, p + 4), ' ') x from d, unnest(range(1, greatest(2, len(w) - 3))) u(p) where len(w) > 0),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 80 * (na.n + nb.n - k)),
r(a, b) as (select doc_id, doc_id from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, m.component_id from d left join n using (doc_id) join (select a doc_id, min(b) component_id from r group by 1) m using (doc_id)""",
    "op5_warc_derivatives": r"""
with p as (select page_id, coalesce(url, '') u, coalesce(html, '') h from pages),
a as (select *, regexp_replace(h, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') x from p),
b as (select *, regexp_replace(regexp_replace(x, '(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|td|th|table|article|section|nav|header|footer|main|aside|br|hr|title|blockquote|pre|dl|dt|dd|form)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') y from a),
c as (select *, replace(replace(replace(replace(replace(replace(replace(replace(y, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') z from b),
t as (select page_id, u, h, regexp_replace(regexp_replace(regexp_replace(z, '[ \t\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') txt,
  regexp_replace(regexp_extract(h, '(?is)<title[^>]*>(.*?)</title', 1), '[\r\n\t ]+', ' ', 'g') title, md5('response|' || coalesce(page_id::varchar, '') || '|' || u) m, 'sha256:' || sha256(h) pd, chr(13) || chr(10) nl from c),
r as (select *, '<urn:uuid:' || concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) || '>' rid from t),
k as (select *, 'metadata' warc_type, 'application/warc-fields' mime, 'source-digest: ' || pd || nl || 'title: ' || title || nl || 'outlinks: ' || len(regexp_extract_all(h, '(?i)<a\b[^>]*\bhref=')) || nl
  || 'text-lines: ' || len(regexp_extract_all(txt, '[^\n]+')) || nl || 'text-digest: sha256:' || sha256(txt) || nl || 'source-http: HTTP/1.1 200 OK' || nl || 'source-http: Content-Type: text/html; charset=utf-8' || nl
  || 'source-http: Content-Length: ' || strlen(h) || nl block from r union all select *, 'conversion', 'text/plain', txt from r),
i as (select *, md5(warc_type || '|' || rid) m2, 'sha256:' || sha256(block) bd, strlen(block)::bigint n from k),
j as (select *, '<urn:uuid:' || concat_ws('-', m2[1:8], m2[9:12], m2[13:16], m2[17:20], m2[21:32]) || '>' record_id from i)
select page_id, warc_type, record_id, rid refers_to, u target_uri, pd payload_digest, bd block_digest, n content_length,
  sha256('WARC/1.1' || nl || 'WARC-Type: ' || warc_type || nl || 'WARC-Record-ID: ' || record_id || nl || 'WARC-Refers-To: ' || rid || nl || 'WARC-Target-URI: ' || replace(replace(u, chr(13), '%0D'), chr(10), '%0A') || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl
  || 'WARC-Source-Payload-Digest: ' || pd || nl || 'WARC-Block-Digest: ' || bd || nl || 'Content-Type: ' || mime || nl || 'Content-Length: ' || n || nl || nl || block || nl || nl) record_sha256 from j""",
    "op7_host_reputation": r"""
with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[a-zA-Z]+;', '', 'g') t from pages),
q as (select *, case when t is null then null when 10 * len(regexp_extract_all(t, '[#*$%&|<>]')) > len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) then 1 else 0 end bad from p),
h as (select host, count(bad)::double n, coalesce(sum(bad), 0)::double k, case when regexp_matches(host, '^([0-9]+(\.[0-9]+)+|\[.*\])(:[0-9]+)?$') then regexp_replace(host, ':[0-9]+$', '') when regexp_matches(host, '(^|\.)(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z][a-z](:[0-9]+)?$') then array_to_string(string_split(regexp_replace(host, ':[0-9]+$', ''), '.')[-3:], '.') else array_to_string(string_split(regexp_replace(host, ':[0-9]+$', ''), '.')[-2:], '.') end domain, case when regexp_matches(host, '^([0-9]+(\.[0-9]+)+|\[.*\])(:[0-9]+)?$') then '' when regexp_matches(host, '(^|\.)(ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z][a-z](:[0-9]+)?$') then array_to_string(string_split(regexp_replace(host, ':[0-9]+$', ''), '.')[-2:], '.') else array_to_string(string_split(regexp_replace(host, ':[0-9]+$', ''), '.')[-1:], '.') end suffix from q group by host),
g as (select case when sum(n) > 0 then (sum(k) + 0.5::double) / (sum(n) + 1) else 0.5 end m from h),
s0 as (select suffix, sum(n) n, sum(k) k, any_value(g.m) m from h, g group by suffix),
s1 as (select 1 / least(greatest(case when sum(n * (n - 1) * m * (1 - m)) <> 0 then sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) else 0 end, 0.001::double), 0.5::double) - 1 s from s0),
s2 as (select suffix, (k + s * m) / (n + s) m from s0, s1),
d0 as (select suffix, domain, sum(n) n, sum(k) k, any_value(s2.m) m from h join s2 using (suffix) group by suffix, domain),
d1 as (select 1 / least(greatest(case when sum(n * (n - 1) * m * (1 - m)) <> 0 then sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) else 0 end, 0.001::double), 0.5::double) - 1 s from d0),
d2 as (select domain, (k + s * m) / (n + s) m from d0, d1),
h0 as (select h.*, d2.m from h join d2 using (domain)),
h1 as (select 1 / least(greatest(case when sum(n * (n - 1) * m * (1 - m)) <> 0 then sum((k - n * m) ** 2 - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) else 0 end, 0.001::double), 0.5::double) - 1 s from h0),
h2 as (select host, n, s, (k + s * m) / (n + s) rate from h0, h1),
r as (select q.*, rate - 1.645::double * sqrt(rate * (1 - rate) / (n + s + 1)) lower, '.' || q.host x from q join h2 using (host))
select page_id, host, path, case when x like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/' when x like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
  when x like '%.net' and starts_with(path, '/es/') then 'net/es/' when x like '%.net' and starts_with(path, '/fr/') then 'net/fr/' when x like '%.com' and starts_with(path, '/') then 'com/' end rule,
  case when x like '%.www.example.com' and starts_with(path, '/en/') then 'allow' when x like '%.example.com' and starts_with(path, '/en/') then 'block'
  when x like '%.net' and (starts_with(path, '/es/') or starts_with(path, '/fr/')) then 'block' when x like '%.com' and starts_with(path, '/') then 'allow' when lower > 0.1 then 'block' else 'allow' end verdict from r""",
}
