"""The corpus operators' queries and SQL, by the names under which the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_mixing, op2_toxicity, op3_neardup, op4_decontamination, op5_urls, op6_fingerprints, op7_suffixes, op8_windows, op9_tokens, op10_licenses


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_mixing.mix(_table(spark, sf_dir, "documents"))


def op2_toxicity_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontamination_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


BLOCKED_WORDS = ("casino", "bets", "pills", "ads-")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return op5_urls.score(pages, op5_urls.train(op5_urls.seeds(pages, BLOCKED_WORDS)))


def op6_fingerprints_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_fingerprints.sketch(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_suffixes.repeats(_table(spark, sf_dir, "documents"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_windows.repeated_windows(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_tokens.token_counts(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_licenses.scan(_table(spark, sf_dir, "documents"))


def repeats_sql(size: int) -> str:
    """Windows of so many tokens that occur more than once, as maximal intervals by document and role."""
    return f"""
WITH toks AS (SELECT doc_id, regexp_extract_all(text, '[^\\t\\n\\x0b\\f\\r ]+') AS w FROM documents),
win AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + {size} - 1], ' ')) AS h
        FROM toks, unnest(range(1, len(w) - {size} + 2)) AS r(i) WHERE len(w) >= {size}),
rep AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY h) AS n,
               first_value(struct_pack(d := doc_id, p := pos)) OVER (PARTITION BY h ORDER BY doc_id, pos) AS head FROM win),
occ AS (SELECT DISTINCT doc_id, pos, CASE WHEN head.d = doc_id AND head.p = pos THEN 'first' ELSE 'later' END AS role FROM rep WHERE n > 1),
brk AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id, role ORDER BY pos) <= {size} THEN 0 ELSE 1 END AS b FROM occ),
grp AS (SELECT *, sum(b) OVER (PARTITION BY doc_id, role ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM brk)
SELECT doc_id, CAST(min(pos) AS BIGINT) AS start_token, CAST(max(pos) + {size} AS BIGINT) AS end_token,
       CAST(max(pos) + {size} - min(pos) AS BIGINT) AS n_tokens, role
FROM grp GROUP BY doc_id, role, g"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing_,
    "op2_toxicity": op2_toxicity_,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_decontamination": op4_decontamination_,
    "op5_url_filters": op5_url_filters,
    "op6_fingerprints": op6_fingerprints_,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_substrings": op8_substrings,
    "op9_token_counts": op9_token_counts,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL: dict[str, str] = {"op7_suffix_dedup": repeats_sql(op7_suffixes.LENGTH), "op8_substrings": repeats_sql(op8_windows.WINDOW)}
