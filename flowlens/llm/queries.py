"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import (byte_bpe, conversation_repair, host_reputation, license_rules, quotation_links,
                          source_divergence, warc_index)
from flowlens.llm.bestfit_packing import pack_documents
from flowlens.llm.minmax_dedup import near_duplicates
from flowlens.llm.nn_descent import nearest
from flowlens.llm.paragraph_dedup import repeated_passages
from flowlens.llm.quotation_links import linked_conversations
from flowlens.llm.string_tiling import contaminated_pairs
from flowlens.llm.subword_classifier import quality_scores


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations without quotes, linked and in reply order."""
    return linked_conversations(table(spark, sf_dir, "conversations"))


def op2_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url. The outcome of a page is the quality
    label with its id: the only labelled outcomes that the tables hold."""
    outcomes = table(spark, sf_dir, "labels").selectExpr("doc_id as page_id", "quality as good")
    return host_reputation.url_verdicts(table(spark, sf_dir, "pages"), outcomes)


def op4_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of every embedding whose vec_id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


def op6_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived as WARC records and read back through the index."""
    return warc_index.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines and runs of 50 words that repeat in the documents, and which stay."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences found in all documents."""
    return license_rules.licenses(table(spark, sf_dir, "documents"))


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold at least half of a benchmark item's words."""
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again: digests of the ids and of the bytes."""
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"))))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as stated, and their cheapest repairs."""
    convs = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(convs, conversation_repair.damage(convs))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all sources of a language and the terms that set each apart."""
    return source_divergence.divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quotation_links, op2_bestfit_packing, op3_host_reputation, op4_nn_descent, op5_minmax_dedup,
    op6_warc_index, op7_paragraph_dedup, op8_license_rules, op9_string_tiling, op10_subword_classifier,
    op11_byte_bpe, op12_conversation_repair, op13_source_divergence)}

# Words of a text, its distinct 2-word shingles (or the whole short sequence),
# links of all pairs that share a shingle, and components by reachability.
_OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select doc_id, list_distinct(case when len(ws) >= 2
    then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) as sh
  from w),
n as (select doc_id, len(sh) as n from s),
e as (select doc_id, unnest(sh) as x from s),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as i from e a join e b on a.x = b.x and a.doc_id < b.doc_id
  group by 1, 2),
link as (
  select a, b from common join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * i >= 80 * (na.n + nb.n - i)),
sym as (select a, b from link union all select b, a from link),
reach as (
  select a as doc_id, b as r from sym
  union
  select reach.doc_id, sym.b from reach join sym on reach.r = sym.a),
c as (select doc_id, min(r) as r from reach group by 1)
select n.doc_id, n.n as n_shingles, least(n.doc_id, coalesce(c.r, n.doc_id)) as component_id,
       n.doc_id = least(n.doc_id, coalesce(c.r, n.doc_id)) as kept
from n left join c on c.doc_id = n.doc_id
"""

# The same over lines of 50 words and their 5-word shingles; and every window of
# 50 words of the running text that an earlier document has, or an earlier place.
_OP7_SQL = r"""
with recursive l as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 as paragraph
  from documents where text is not null),
w as (
  select doc_id, paragraph, regexp_extract_all(translate(line,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from l),
p as (
  select doc_id, paragraph, ws,
    sum(len(ws)) over (partition by doc_id order by paragraph) - len(ws) as start_word from w),
s as (
  select row_number() over (order by doc_id, paragraph) as id, doc_id, start_word, len(ws) as n_words,
    list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) as sh
  from p where len(ws) >= 50),
n as (select id, len(sh) as n from s),
e as (select id, unnest(sh) as x from s),
common as (
  select a.id as a, b.id as b, count(*) as i from e a join e b on a.x = b.x and a.id < b.id group by 1, 2),
link as (
  select a, b from common join n na on na.id = a join n nb on nb.id = b where 100 * i >= 80 * (na.n + nb.n - i)),
sym as (select a, b from link union all select b, a from link),
reach as (
  select a as id, b as r from sym union select reach.id, sym.b from reach join sym on reach.r = sym.a),
c as (select id, least(id, min(r)) as r from reach group by id),
t as (
  select doc_id, text, min(doc_id) over (partition by text) as rep, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents where text is not null),
win as (
  select doc_id, i, md5(array_to_string(ws[i + 1:i + 50], ' ')) as k
  from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from t where doc_id = rep and len(ws) >= 50)),
f as (select k, min((doc_id, i)) as first from win group by k having count(*) > 1),
cut as (
  select doc_id, i, first[1] as first_doc_id from win join f using (k) where (doc_id, i) <> first),
mark as (
  select *, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as fresh from cut),
isle as (select *, sum(fresh) over (partition by doc_id order by i) as g from mark)
select 'line' as unit, s.doc_id, cast(s.start_word as bigint) as start_word, s.n_words, o.doc_id as first_doc_id,
  s.id = o.id as kept
from c join s on s.id = c.id join s o on o.id = c.r
union all
select 'run', doc_id, min(i), max(i) + 50 - min(i), arg_min(first_doc_id, i), false from isle group by doc_id, g
union all
select 'run', doc_id, 0, len(ws), rep, false from t where doc_id <> rep and len(ws) >= 50
"""

ORACLE = {
    "op1_quotation_links": quotation_links.ORACLE_SQL,
    "op3_host_reputation": host_reputation.oracle_sql(),
    "op5_minmax_dedup": _OP5_SQL,
    "op6_warc_index": warc_index.ORACLE_SQL,
    "op7_paragraph_dedup": _OP7_SQL,
    "op8_license_rules": license_rules.oracle_sql(),
    "op13_source_divergence": source_divergence.ORACLE_SQL,
}
