"""The operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, language_id, license_scan, line_dedup, lm_scoring, mixing, near_dup, packing, quality_rules, sharding, token_counts, whitening
from .common import read


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(read(spark, sf_dir, "documents"), tokenizer(), tokenizer("byte_bpe_50k.tiktoken"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.find_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer(), tokenizer("byte_bpe_50k.tiktoken"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(read(spark, sf_dir, "documents"), shards=24)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", "removed", "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = quality_rules.judge(docs, read(spark, sf_dir, "labels"))
    return found.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "rule")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer(), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_near_dup, op3_lm_scoring, op4_sharding, op5_line_dedup, op6_quality_rules, op7_license_scan, op8_language_id, op9_decontamination, op10_token_counts, op11_mixing, op12_collocations, op13_whitening)
    return {f.__name__: f for f in found}


#: Sizes, ranks and weights of sources; shares that stop at three times a source's size, found in the order in which they would stop; then three
#: passes over a source's documents in the order of the digest of seed and id.
MIXING_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size, substr(md5('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as k from documents),
 s as (select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
 r as (select *, row_number() over (order by 3 * source_size / w, source nulls last) as i from s),
 c as (select *, cast((sum(source_size) over ()) - 3 * coalesce(sum(source_size) over (order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as rest, cast(sum(w) over (order by i rows between current row and unbounded following) as bigint) as ws from r),
 l as (select rest, ws from c where rest * w <= 3 * source_size * ws order by i limit 1),
 t as (select c.source, c.source_size, case when l.rest * c.w > 3 * c.source_size * l.ws then cast(3 * c.source_size as double) else cast(l.rest * c.w as double) / l.ws end as target,
   case when l.rest * c.w > 3 * c.source_size * l.ws then 3 * c.source_size else (l.rest * c.w) // l.ws end as quota from c, l),
 b as (select *, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d),
 x as (select b.*, t.source_size, t.target, cast(greatest(0, least(b.size, t.quota - b.before)) + greatest(0, least(b.size, t.quota - t.source_size - b.before)) + greatest(0, least(b.size, t.quota - 2 * t.source_size - b.before)) as bigint) as taken
   from b join t on b.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target, taken, source, case when size > 0 then taken // size end as repeats from x
"""
#: All phrases of all pieces, counted; parts joined to candidates; the best cut; what longer candidates cover goes.
COLLOCATIONS_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
 w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
 n as (select lang, cast(sum(len(ws)) as bigint) as n from w group by lang),
 m as (select lang, ws, m, unnest(range(1, len(ws) - m + 2)) as i from w, (values (1), (2), (3), (4)) y(m) where len(ws) >= m),
 f as (select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase, count(*) as f from m group by all having count(*) >= 30),
 c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1),
 o as (select lang, a, ws, m, k, unnest(range(1, m - k + 2)) as i from c, (values (2), (3)) y(k) where k < m),
 v as (select lang, array_to_string(ws[i:i + k - 1], ' ') as phrase, max(a) as longer from o group by all),
 q as (select c.*, unnest(range(1, m)) as k from c left join v using (lang, phrase) where longer is null or 100 * longer < 80 * a),
 z as (select q.lang, q.phrase, q.a, q.k, l.f as l, r.f as r, cast((2000000::hugeint * q.a) // (l.f + r.f) as bigint) as score from q
   join f l on l.lang = q.lang and l.phrase = array_to_string(q.ws[1:q.k], ' ') join f r on r.lang = q.lang and r.phrase = array_to_string(q.ws[q.k + 1:q.m], ' ')),
 e as (select * from z qualify row_number() over (partition by lang, phrase order by score, k) = 1),
 g as (select e.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from e)
select g.lang, g.rank, g.phrase, g.a, g.l, g.r, n.n, g.score from g join n using (lang) where g.rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_mixing": MIXING_SQL, "op12_collocations": COLLOCATIONS_SQL}
