"""The corpus operators' queries: each applies its operator to its whole table and derives the columns asked for."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, extract, idstore, lmscore, minhash, nbest, packing, pii, quality, ranking, sharding, spotsigs
from .common import cut, shared_dir, table


def op1_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_nbest_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.digests(table(spark, sf_dir, "documents"))


def op3_shard_by_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pack_by_nnls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_content_addressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    idstore.write(table(spark, sf_dir, "documents"), path)
    return idstore.digests(spark, path)


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), written=True)


def op8_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(fixed).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = cut(chat.format_conversations(rows), "chat")
    return chat.read_back(formatted)


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), written=True)


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_edits(table(spark, sf_dir, "documents"))


def op11_interval_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


def op12_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op13_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def spots_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search part of SpotSigs: every document's class of near signature sets."""
    return spotsigs.near_classes(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii_semi_markov, op2_nbest_pieces, op3_shard_by_splitters, op4_risk_controlled_quality, op5_pack_by_nnls, op6_content_addressed_ids, op7_stupid_backoff, op8_chat_masks, op9_weighted_minhash, op10_spotsigs, op11_interval_coalescing, op12_site_templates, op13_range_maximum_search, spots_near_classes)}


def _quality_sql() -> str:
    """op4 in SQL: the same measures, exact binomial tests and choice of cutoffs."""
    share = quality.LIMIT / len(quality.RULES)
    each = len(quality.RULES) * len(quality.CUTOFFS)
    least = math.ceil(math.log(quality.DELTA / each) / math.log1p(-share))
    ratios = " union all ".join(f"select doc_id, stratum, '{r}' as rule, {e.replace(' / ', '::double / ')} as ratio from m where not base_failed" for r, e in quality.RULES.items())
    return f"""
with d as (select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') as w from documents),
tri as (select doc_id, i, x, count(*) over (partition by doc_id, x) as c from (select doc_id, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as x from d where len(w) > 2)),
rep as (select doc_id, count(distinct i + k) as n from tri, (values (0), (1), (2)) o(k) where c > 1 group by doc_id),
l as (select doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as lines from d),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from (
  select d.doc_id, stratum, len(w) as n_words, length(regexp_replace(t, '[ \\t-\\r]+', '', 'g')) as word_chars, length(t) - length(translate(t, '{quality.SYMBOLS}', '')) as n_symbols, length(t) - length(translate(t, '{quality.CAPITALS}', '')) as n_upper,
    len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from d join l using (doc_id) left join rep using (doc_id))),
r as ({ratios}),
known as (select distinct doc_id, quality > 0 as good from labels where quality is not null),
g as (select stratum, count(*) filter (good) as n_good from m join known using (doc_id) where not base_failed group by stratum having count(*) filter (good) >= {least}),
t as (select stratum, rule, c, n_good, count(*) filter (ratio > c and good) as k, count(*) filter (ratio > c and not good) as bad from r join known using (doc_id) join g using (stratum), (select unnest([{', '.join(map(str, quality.CUTOFFS))}]::double[]) as c) group by all),
p as (select *, list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({share}::double) + (n_good - i) * ln(1 - {share}::double)))) as tail from t where bad > 0),
cut as (select stratum, rule, c from p where tail <= {quality.DELTA} / ((select count(*) from g) * {each}) qualify row_number() over (partition by stratum, rule order by k, bad desc, c desc) = 1),
out as (select distinct doc_id from r join cut using (stratum, rule) where ratio > c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and doc_id not in (select doc_id from out) as kept from m
"""


#: op13 in SQL: every document's score for every item.
_RANKING_SQL = """
with d as (select row_number() over () as row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms from documents where text is not null),
c as (select row, doc_id, len(terms)::bigint as n, terms from d where len(terms) > 0),
s as (select count(*) as docs, sum(n)::bigint as total from c),
t as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(terms) as term from c) group by all),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from t group by term), s),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark),
r as (select item_id, row, any_value(doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))))::bigint as score from q join t using (term) join w using (term), s group by item_id, row)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id nulls last))::int as rank, doc_id, score from r where score > 0 qualify rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_risk_controlled_quality": _quality_sql(), "op13_range_maximum_search": _RANKING_SQL}
