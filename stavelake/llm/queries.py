"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import table


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.warc import archive_round_trip

    return archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.toxicity import held_out, score_column, train

    docs = table(spark, sf_dir, "documents")
    machine = train(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(machine).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.binary_records import record_round_trip

    return record_round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.decontam import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.ngram_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


def op6_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.duck_bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.suffix_dedup import dedup_report

    return dedup_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.token_count import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", counted["n_tokens"] > 512)


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.preference import preferences

    return preferences(table(spark, sf_dir, "conversations"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stavelake.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


SQL = {
    "op1_warc_salvage": """
        with p as (select page_id, url, coalesce(html, '') as h from pages),
        g as (select *, case when octet_length(encode(h)) >= 1000 then max(page_id) over (partition by h) end as last_id from p)
        select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(h) as payload_digest,
          case when last_id > page_id then 'revisit' else 'response' end as record_type,
          case when last_id > page_id then last_id end as refers_to, url
        from g
    """,
    "op9_preference_format": """
        with t as (
          select conv_id, turn, replace(coalesce(role, ''), '<|', '< |') as role, replace(coalesce(text, ''), '<|', '< |') as text
          from conversations where conv_id is not null
        ), n as (
          select *, row_number() over (partition by conv_id order by turn, role, text) as i from t
        ), l as (
          select conv_id, max(i) as n, row_number() over (order by conv_id) - 1 as r from n where role = 'assistant' group by conv_id
        ), p as (
          select a.conv_id as pair_id, b.conv_id as partner_id, a.n as own_n, b.n as other_n, ('0x' || substr(md5(a.conv_id::varchar), 1, 8))::bigint % a.n as cut
          from l a join l b on b.r = xor(a.r, 1)
        ), chosen as (
          select pair_id, i, role, text from p join n on conv_id = pair_id and i <= own_n
        ), rejected as (
          select pair_id, i, role, text from p join n on conv_id = pair_id and i <= cut
          union all select pair_id, i, role, text from p join n on conv_id = partner_id and i > cut and i <= other_n
          union all select pair_id, cut + 1, role, text from p join n on conv_id = partner_id and i = other_n and other_n <= cut
        ), apart as (
          select pair_id, min(i) - 1 as common from (
            select coalesce(a.pair_id, b.pair_id) as pair_id, coalesce(a.i, b.i) as i
            from chosen a full join rejected b on a.pair_id = b.pair_id and a.i = b.i where (a.role = b.role and a.text = b.text) is not true
          ) group by pair_id
        ), both_sides as (
          select pair_id, 'c' as side, i, role, text from chosen union all select pair_id, 'r', i, role, text from rejected
        ), numbered as (
          select s.*, coalesce(common, (select max(i) from both_sides x where x.pair_id = s.pair_id)) as common,
            '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as shown
          from both_sides s left join apart using (pair_id)
        ), placed as (
          select *, coalesce(sum(length(shown)) over (partition by pair_id, side order by i rows between unbounded preceding and 1 preceding), 0) + 13 + length(role) as begins
          from numbered where i > common
        ), done as (
          select pair_id, side, string_agg(shown, '' order by i) as shown,
            string_agg(case when role = 'assistant' then begins::varchar || '-' || (begins + length(text) + 10)::varchar end, ',' order by i) as mask
          from placed group by pair_id, side
        ), prompts as (
          select pair_id, max(common) as common, string_agg(case when side = 'c' and i <= common then shown end, '' order by i) as prompt from numbered group by pair_id
        )
        select pair_id, partner_id, 'paired' as status, common::bigint as prompt_turns, coalesce(prompt, '') as prompt, coalesce(c.shown, '') as chosen, coalesce(r.shown, '') as rejected,
          coalesce(c.mask, '') as chosen_mask, coalesce(r.mask, '') as rejected_mask
        from p join prompts using (pair_id) left join (from done where side = 'c') c using (pair_id) left join (from done where side = 'r') r using (pair_id)
        union all
        select conv_id, null, case when bool_or(role = 'assistant') then 'unpaired' else 'no_assistant' end, null, null, null, null, null, null
        from t where conv_id not in (select pair_id from p) group by conv_id
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
