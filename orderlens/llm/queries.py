"""The registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import decontaminate, html_text, language, line_dedup, nearest, packing, pii, ranked, resample, sharding, simhash, token_files, toxicity
from orderlens.llm.common import read_table, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return add


@query("op1_adaptive_nearest")
def adaptive_nearest(spark, sf_dir):
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"))


@query("op2_pii")
def personal_data(spark, sf_dir):
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def document_toxicity(spark, sf_dir):
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op4_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


@query("op5_decontamination")
def benchmark_leaks(spark, sf_dir):
    return decontaminate.leaks(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


@query("op6_simhash_near_dedup")
def simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op7_html_text")
def html_main_text(spark, sf_dir):
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


@query("op8_sharding")
def stratified_shards(spark, sf_dir):
    return sharding.interleaved_shards(read_table(spark, sf_dir, "documents"))


@query("op9_line_dedup")
def line_run_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs, counted=True).withColumn(
        "n_chars", F.length("text").cast("bigint")
    )


@query("op10_token_files")
def token_id_files(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(
        read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json")
    )
    return token_files.read_token_files(spark, path)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms_sql(key: str, table: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), "
            f"'{_TERM}')) AS term FROM {table}")


@query("op11_ranked_search", f"""
    WITH words AS ({_terms_sql('doc_id', 'documents')}),
    asked AS (SELECT item_id, term, count(*) AS times FROM ({_terms_sql('item_id', 'benchmark')}) b
              GROUP BY item_id, term),
    lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
    counts AS (SELECT doc_id, term, count(*) AS tf FROM words
               WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2.0E0 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
                FROM counts, totals GROUP BY term),
    impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))
                           AS impact
                FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
    scores AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score
               FROM asked JOIN impacts USING (term) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
        FROM scores WHERE score > 0) s WHERE rank <= 20
""")
def ranked_search(spark, sf_dir):
    return ranked.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op12_importance_resampling")
def importance_resampling(spark, sf_dir):
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op13_language")
def document_language(spark, sf_dir):
    return language.languages(read_table(spark, sf_dir, "documents"))
