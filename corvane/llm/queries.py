"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, decontam, html, minhash, quality, secrets, simhash, suffixes, tokens, toxicity
from corvane.llm.arrowtext import SINGLES, SPACES
from corvane.operators.shared import widened


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return widened(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated(_table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(_table(spark, sf_dir, "documents"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.output(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_suffixes": op2_suffixes,
    "op3_secrets": op3_secrets,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_quality": op6_quality,
    "op7_bpe": op7_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_tokens": op9_tokens,
    "op10_html": op10_html,
}

#: Windows of 50 words, those that occur again, and the runs of words that they cover.
def _ranges(of: tuple[tuple[int, int], ...]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in of)


_OP2 = r"""
with words as (
  select distinct doc_id::bigint as doc_id, text, regexp_extract_all(text, '[SINGLES]|[^SPACESSINGLES]+') as w
  from documents where doc_id is not null and text is not null
), windows as (
  select doc_id, text, s - 1 as s, array_to_string(w[s : s + 49], ' ') as passage
  from (select doc_id, text, w, unnest(range(1, len(w) - 48)) as s from words)
), again as (
  select *, row_number() over (partition by passage order by doc_id, s) > 1 as extra from windows
  qualify count(*) over (partition by passage) > 1
), marked as (
  select *, coalesce(s > lag(s) over (partition by doc_id, text, extra order by s) + 50, true)::int as new from again
), runs as (
  select *, sum(new) over (partition by doc_id, text, extra order by s) as run from marked
)
select doc_id, min(s)::integer as start_word, (max(s) + 50)::integer as end_word, extra from runs group by doc_id, text, extra, run
""".replace("SINGLES", _ranges(SINGLES)).replace("SPACES", _ranges(SPACES))



def _secrets_sql() -> str:
    """Matches of each rule, and their places from the lengths of what lies between them."""
    each = " union all ".join(f"select doc_id, text, '{n}' as rule, regexp_extract_all(text, '{q}') as m, regexp_split_to_array(text, '{q}') as gap from documents where regexp_matches(text, '{q}')" for n, q in ((n, p.replace("'", "''")) for n, p in secrets.RULES.items()))
    return f"""
with found as ({each}),
spread as (select doc_id, rule, m, gap, unnest(range(1, len(m) + 1)) as i from found),
placed as (
  select doc_id, rule, m[i] as secret,
    list_sum(list_transform(gap[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0) as start
  from spread
)
select doc_id::bigint as doc_id, rule, start::integer as start_char, (start + length(secret))::integer as end_char, sha256(secret) as sha256 from placed
"""


ORACLE_SQL: dict[str, str] = {"op2_suffixes": _OP2, "op3_secrets": _secrets_sql()}
