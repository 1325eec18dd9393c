"""One query per operator, over its whole table, and DuckDB texts where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.llm import (
    cotraining,
    filter_audit,
    lang_id,
    line_dedup,
    merkle,
    mixing,
    packing,
    pii,
    quality_rules,
    resampling,
    simhash,
    swap_packing,
    training_order,
)
from featureflow.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_mixing", mixing.mix_sql())
def op1(spark, sf_dir):
    return mixing.mix_rows(documents(spark, sf_dir))


@query("op2_merkle", merkle.edit_sql())
def op2(spark, sf_dir):
    return merkle.edit_likeness(documents(spark, sf_dir))


@query("op3_language_id")
def op3(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = lang_id.predict(docs, lang_id.learn(docs))
    return found.select("doc_id", F.coalesce(lang_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


@query("op4_pii")
def op4(spark, sf_dir):
    return pii.report(documents(spark, sf_dir))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def rules_sql() -> str:
    bits = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality_rules.RULES))
    count = lambda cls: f"length(regexp_replace(coalesce(text, ''), '[^{cls}]', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM dup WHERE c > 1) GROUP BY 1),
ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST({count('#*$%&|<>')} AS BIGINT) AS n_symbols, CAST(coalesce(ln.n - ln.k, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(ln.n, 0) AS BIGINT) AS n_lines,
        CAST({count('A-Z')} AS BIGINT) AS n_upper, CAST({count('a-z')} AS BIGINT) AS n_lower, CAST({count('!')} AS BIGINT) AS n_marks
      FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failure_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, (failure_bits & {quality_rules.mask(quality_rules.CURRENT)}) = 0 AS kept, failure_bits
FROM b"""


@query("op6_quality_rules", rules_sql())
def op6(spark, sf_dir):
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)))
    base = sum(quality_rules.bit(n) for n in quality_rules.BASE)
    failed = F.col("failure_bits").bitwiseAND(F.lit(base)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failure_bits"
    )


@query("op7_line_dedup", line_dedup.dedup_sql())
def op7(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    listed = F.concat_ws(",", F.col("gone").cast("array<string>"))
    return out.select(
        F.col("c0").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_gone"),
        listed.alias("gone"), "kept_text",
    )


@query("op8_training_order")
def op8(spark, sf_dir):
    return training_order.materialise(documents(spark, sf_dir))


@query("op9_cotraining")
def op9(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return cotraining.score(docs, cotraining.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@query("op10_simhash")
def op10(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


@query("op11_filter_audit", filter_audit.audit_sql())
def op11(spark, sf_dir):
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op12_swap_packing")
def op12(spark, sf_dir):
    return swap_packing.pack(documents(spark, sf_dir))


@query("op13_resampling", resampling.resample_sql())
def op13(spark, sf_dir):
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
