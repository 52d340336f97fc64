"""The registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, htmltext, images, langid, linedup, mixing, neardup, pii, quality, subword, tokencount, variants


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = neardup.near_duplicates(docs).withColumnRenamed("id", "doc_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokencount.recount(tokencount.count_tokens(tokencount.masking_edits(docs)), "edits")
    return out.select("doc_id", "tokens.n_pretokens", "tokens.n_tokens", "recounted.n_edits", "recounted.n_encoded", F.col("recounted.n_tokens").alias("n_tokens_after"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = subword.encode(docs, check="round_trip")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality(docs).drop("text", "lang")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linedup.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_spans(docs)
    return out.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", F.sha2("pii.base", 256).alias("base_sha256"), "pii.spans")


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    langs, logp = langid.train(docs.filter(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), langs, logp).drop("text")


def op9_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.find_copies(images.media_of_vectors(table(spark, sf_dir, "embeddings")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    plan = mixing.draw_plan(docs)
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", mixing.mix_column(F.col("draws"), F.col("size")).alias("taken"), F.transform("draws", lambda d: d["shard"]).alias("shards"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "hit_spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_templates": op1_site_templates,
    "op2_edit_aware_counts": op2_edit_aware_counts,
    "op3_minhash_forest": op3_minhash_forest,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_quality_rules": op5_quality_rules,
    "op6_line_dedup": op6_line_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_mix_sources": op8_mix_sources,
    "op9_image_copies": op9_image_copies,
    "op10_language_mixture": op10_language_mixture,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_benchmark_decontamination": op13_benchmark_decontamination,
}

#: White space at line ends as DuckDB's trim() takes it.
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _words13(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_filter(regexp_split_to_array({low}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"


SQL: dict[str, str] = {
    "op6_line_dedup": f"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents),
 x as (select doc_id, unnest(l) line, generate_subscripts(l, 1) pos from d),
 k as (select doc_id, pos, line, translate(trim(line, {_WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from x),
 r as (select key, min(doc_id) first_id from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
 m as (select k.doc_id, pos, line, coalesce(k.doc_id <> first_id, false) gone from k left join r on k.key = r.key)
select doc_id, count(*) n_lines, cast(sum(case when gone then 1 else 0 end) as bigint) n_dropped,
 sha256(coalesce(string_agg(case when gone then null else line end, chr(10) order by pos), '')) kept_sha256
from m group by doc_id""",
    "op13_benchmark_decontamination": f"""
with d as materialized (select row_number() over () rid, doc_id, {_words13("text")} w from documents),
 i as (select item_id, {_words13("text")} w from benchmark),
 k as (select item_id, w, least(len(w), 10) n from i where len(w) > 0),
 iw as materialized (select distinct item_id, n, array_to_string(w[p:p + n - 1], ' ') win from (select *, unnest(range(1, len(w) - n + 2)) p from k)),
 dw as (select rid, n, p, array_to_string(w[p:p + n - 1], ' ') win from (select rid, n, w, unnest(range(1, len(w) - n + 2)) p from d, (select distinct n from iw) where len(w) >= n)),
 h as materialized (select rid, p, dw.n, item_id from dw join iw on dw.win = iw.win),
 c as (select rid, count(distinct x) n_hit from (select rid, unnest(range(p, p + n)) x from (select distinct rid, p, n from h)) group by rid),
 t as (select rid, count(*) n_items, sha256(string_agg(s, ',' order by s)) items from (select distinct rid, cast(item_id as varchar) s from h) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items, sha256('')) items_sha256,
 n_hit is not null contaminated
from d left join c on d.rid = c.rid left join t on d.rid = t.rid""",
}
