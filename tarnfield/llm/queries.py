"""The ten queries on training data over their whole tables, and what SQL can say of three more of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfield.llm import classifier, decontaminate, packing, pii, quality_rules, secrets, sharding, simhash, sql, token_store, url_filter
from tarnfield.llm.common import scratch_path, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), with_ids=False)
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_store.digests(token_store.read_tokens(spark, path))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return got.select("doc_id", *[f"n_{k}" for k in pii.BASE], F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op4: the base spans."""
    return op4_secrets(spark, sf_dir).drop("spans")


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op5: the counts and the plain rules."""
    return op5_quality_rules(spark, sf_dir).drop("kept", "anomaly")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op10: the base spans."""
    return op10_pii(spark, sf_dir).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """By name."""
    own = (op1_decontamination, op2_packing, op3_url_filter, op4_secrets, op5_quality_rules, op6_quality_classifier, op7_simhash, op8_sharding, op9_token_store, op10_pii, secrets_base, quality_rule_counts, pii_base)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can say the same."""
    return {"op1_decontamination": sql.OP1_SQL, "op3_url_filter": sql.OP3_SQL, "op8_sharding": sql.OP8_SQL, "secrets_base": sql.SECRETS_BASE_SQL, "quality_rule_counts": sql.QUALITY_COUNTS_SQL, "pii_base": sql.PII_BASE_SQL}
