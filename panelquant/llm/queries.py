"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelquant.llm import (bag_minhash, byte_bpe, collocations, conversation_repair, embeddings, html_main,
                            license_scan, mixing, packing, quality, secret_scan, suffix_dedup, toxicity)
from panelquant.llm.sql import SQL as SQL


def vocabulary() -> tuple[str, str]:
    """The rank file's place and the pattern that splits texts before merging."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    base = secret_scan.digest("base")

    def count(kind: str) -> F.Column:
        return F.expr(f"CAST(size(filter(base, x -> x.kind = '{kind}')) AS bigint)").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(base, 256).alias("base_sha256"),
                        secret_scan.digest("array_sort(concat(base, added))").alias("spans"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def encoded(docs: DataFrame) -> DataFrame:
    path, pattern = vocabulary()
    both = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    return both.select("doc_id", F.expr("CAST(octet_length(ids) / 4 AS bigint)").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("bytes", 256).alias("decoded_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.deduplicate(table(spark, sf_dir, "embeddings"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"),
                                              "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("rest", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("distance")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join("spans", ","))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.deduplicate(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = conversation_repair.damage(given)
    chosen = conversation_repair.audits(conversation_repair.faults(rows))
    hashes = conversation_repair.digests(conversation_repair.repair(rows, chosen))
    known = given.select("conv_id").distinct().alias("g")
    found = known.join(chosen.alias("c"), F.expr("g.conv_id <=> c.conv_id"), "left").join(
        hashes.alias("h"), F.expr("g.conv_id <=> h.conv_id"), "left")
    counts = [F.coalesce(f"c.{name}", F.lit(0)).cast("long").alias(name)
              for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("g.conv_id", *counts, F.coalesce("c.audit", F.lit("")).alias("audit"),
                        F.coalesce("h.repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(packing.tokens(table(spark, sf_dir, "documents"), word_vocabulary()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (
    op1_secret_scans, op2_html_extraction, op3_source_mixing, op4_byte_bpe, op5_embedding_neardup,
    op6_toxicity, op7_suffix_dedup, op8_quality_rules, op9_license_scans, op10_bag_minhash, op11_collocations,
    op12_conversation_repair, op13_packing)}
