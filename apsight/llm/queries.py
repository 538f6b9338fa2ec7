"""The registered ``opN_*`` queries: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apsight.llm import (bpe, conversations, exact_dedup, langid, packing, pii, quality, secret_scan, simhash, syncmers, token_files, urls,
                         variants)
from apsight.llm.common import held_out


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie: ``TOKENIZER_DIR`` if set, else the installed ``public_tokenizers``."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _listed(spans: str, keep=lambda s: F.lit(True)) -> Column:
    """kind:start:end of the spans, comma-joined in their order."""
    text = F.transform(F.filter(F.col(spans), keep), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _span_digest(found: DataFrame, kinds: tuple[str, ...], base) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("spans"), lambda s: base(s) & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_listed("spans", base).cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def op1_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op2_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.coalesce(bad, F.lit(0)).alias("bad"))
    return urls.filter_urls(table(spark, sf_dir, "pages"), labels)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(pii.scan(table(spark, sf_dir, "documents")), pii.KINDS, lambda s: s["by_pattern"])


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    read = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks, with_digest=True)
    return read.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = syncmers.compared_with_edit(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", syncmers.as_text("anchors").alias("fingerprint"),
                        syncmers.as_text("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
                         "sequence_tokens", "padded_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_digest(secret_scan.scan(table(spark, sf_dir, "documents")), secret_scan.BASE_KINDS, lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_cascade, op2_host_reputation, op3_token_files, op4_personal_data, op5_byte_bpe, op6_syncmer_fingerprints,
    op7_packing, op8_language_id, op9_secret_scan, op10_simhash_near_dedup, op11_spelling_variants, op12_conversation_repair,
    op13_exact_dedup)}
ORACLES: dict[str, str] = {"op2_host_reputation": urls.ORACLE}
