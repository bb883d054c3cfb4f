"""Registered queries of the subpackage: each applies an operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.llm import line_dedup as lines
from gapcast.llm import embedding_dedup, language, license_scan, merkle, packing, quality, simhash, super_kmers, toxicity, warc, winnowing, zone_clusters
from gapcast.llm.tables import held_out, lower_ascii


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), length=4096)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    model = language.fit_languages(docs, ~out)
    found = language.predict_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~out)
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=2, size=3)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    responses = warc.response_records(pages, "page_id", "url", "html", date="2026-01-01T00:00:00Z")
    return warc.derivatives(responses).withColumnRenamed("key", "page_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = winnowing.words_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a folder per source, and in it one per thousand ids."""
    docs = table(spark, sf_dir, "documents")
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    path = F.concat_ws("/", "source", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.scan_licenses(docs.select(path.alias("path"), "text"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = super_kmers.drop_repeated_passages(docs, window=13)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = zone_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), dims=64, k=40, rounds=5, scale=256, seed=2)
    digests = F.array(*[F.lit(d) for d in found.centroid_digests()]).cast("array<string>")
    return found.members.withColumn("centroid_sha256", F.get(digests, F.col("cluster")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by crc32 of its id) is checked with its text in lower case."""
    docs = table(spark, sf_dir, "documents")
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns]
    tampered = F.when(held_out(F.col("doc_id"), 3, 0), F.unhex(merkle.leaf_hash(changed)))
    made = merkle.merkle_manifest(docs, "doc_id", columns, "lang", {"tampered": tampered})
    folded = merkle.fold(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("witness"))
    checked = made.withColumn("folded_root", folded)
    return checked.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof(F.col("witness")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_quality": op2_quality,
        "op3_language": op3_language,
        "op4_line_dedup": op4_line_dedup,
        "op5_toxicity": op5_toxicity,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_simhash": op7_simhash,
        "op8_warc": op8_warc,
        "op9_decontamination": op9_decontamination,
        "op10_license_scan": op10_license_scan,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
