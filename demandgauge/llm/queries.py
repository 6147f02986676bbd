"""Registered queries of the operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgauge.llm import bpe, decontaminate, dialogue, id_files, licenses, near_dup, pii, quality_model, quality_rules, ranked_search, secrets, token_counts, url_filter
from demandgauge.session import working_folder
from demandgauge.llm.shared import table, write_once

#: Fixed values of the contract: (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
#: Fixed value of the contract: more tokens than this are over the limit.
OVER = 4096


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS r(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_OP2 = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM u),
r(rule_host, rule_path, verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, k=3, share=(85, 100)).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    counted = write_once(quality_rules.counts(docs).drop("text"), "counted")
    limits = write_once(quality_rules.thresholds(counted), "limits")
    return quality_rules.decide(counted, limits).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = table(spark, sf_dir, "documents").select("doc_id", codec.encode(F.col("text")).alias("ids"))
    # Through a generator of one row: next to each other, Spark would run encode once for the ids and again inside decode.
    ids = encoded.select("doc_id", F.inline(F.array(F.struct("ids"))))
    return ids.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.translate(F.col("ids").cast("string"), "[] ", ""), 256).alias("ids_sha256"),
        F.sha2(codec.decode(F.col("ids")), 256).alias("decoded_sha256"))


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_50k.json")
    encode = id_files.tokenizer_ids(spark, file, end_id=2, pattern=public_tokenizers.PATTERN)
    ids = write_once(table(spark, sf_dir, "documents").select("doc_id", encode(F.col("text")).alias("ids")), "ids", "zstd")
    path = os.path.join(working_folder(spark), f"id-files-{uuid.uuid4().hex}")
    id_files.write_ids(ids, path, id_files.vocabulary_size(file))
    return id_files.read_ids(spark, path).select(
        "doc_id", "start", F.expr("length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate of every document; ``secret`` are those that the forest holds for real."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.find(docs, secrets.Forest(secrets.labelled_findings(spark)))
    # An outer explode: for a plain one Spark filters empty arrays below, writing the whole search out into that filter.
    return found.select("doc_id", F.explode_outer("findings").alias("f")).filter("f IS NOT NULL").select(
        "doc_id", F.col("f.start").cast("bigint").alias("start"), F.col("f.end").cast("bigint").alias("end"),
        F.sha2("f.value", 256).alias("value_sha256"), "f.score", (F.col("f.score") >= secrets.SURE).alias("secret"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    finder = pii.Finder(spark)
    found = table(spark, sf_dir, "documents").select("doc_id", finder.spans(F.col("text")).alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS[:pii.N_BASE]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS[:pii.N_BASE]]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_model.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic", "kept")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ranked_search.search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


_OP11 = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY doc_id, term),
weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM tf, total GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the contract; nulls count as one space."""
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.expr("array_repeat(0, if(kind = 3, 2, 1))")).alias("copy")).drop("copy")


def op12_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = dialogue.repair(damaged(conversations)).withColumnRenamed("conv_id", "of")
    every = conversations.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))


QUERIES = {"op1_quality_model": op1_quality_model, "op8_pii": op8_pii, "op5_secrets": op5_secrets, "op9_licenses": op9_licenses, "op7_id_files": op7_id_files, "op3_bpe": op3_bpe, "op6_quality_rules": op6_quality_rules, "op4_near_dup": op4_near_dup, "op10_decontaminate": op10_decontaminate, "op2_url_filter": op2_url_filter,
           "op11_ranked_search": op11_ranked_search, "op12_dialogue": op12_dialogue, "op13_token_counts": op13_token_counts}
ORACLE = {"op2_url_filter": _OP2, "op11_ranked_search": _OP11}
