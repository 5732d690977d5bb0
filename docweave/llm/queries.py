"""Registered queries of this package, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.oracles import ORACLES  # noqa: F401  (registered along with the queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def joined_sha256(items: str):
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


@query
def op3_benchmark_decontamination(spark, sf):
    from docweave.llm.decontamination import contamination

    c = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return c.withColumn("items_sha256", joined_sha256("items")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )


@query
def op9_bin_slack_packing(spark, sf):
    import public_tokenizers

    from docweave.llm.packing import pack

    return pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op10_feistel_sharding(spark, sf):
    from docweave.llm.sharding import shard_documents

    placed = shard_documents(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op1_secret_scan(spark, sf):
    from docweave.llm.secrets import KINDS, with_secrets

    found = with_secrets(table(spark, sf, "documents").select("doc_id", "text"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS))
    counts = [F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )


@query
def op4_language_id(spark, sf):
    from docweave.llm.language import fold, predict, train

    docs = table(spark, sf, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2))
    held_out = docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return predict(held_out, model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op8_content_chunks(spark, sf):
    from docweave.llm.chunks import drop_repeats

    kept = drop_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return kept.select("doc_id", "text", "n_removed", spans.alias("removed_spans"))


@query
def op7_adaptive_dimension_scan(spark, sf):
    from docweave.llm.neighbours import nearest

    return nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op5_kneser_ney(spark, sf):
    from docweave.llm.language import fold
    from docweave.llm.language_model import score, train

    docs = table(spark, sf, "documents").select("doc_id", "text", (fold("doc_id", 5) == 1).alias("held_out"))
    scored = score(docs, train(docs.where(~F.col("held_out"))))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_jaccard_join(spark, sf):
    from docweave.llm.jaccard import shingle_components

    return shingle_components(table(spark, sf, "documents"))


@query
def op2_quality_cotraining(spark, sf):
    from docweave.llm.quality import kept, with_quality

    scored = with_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return scored.select(
        "doc_id", "_quality.quality_text", "_quality.quality_metadata", "_quality.quality_score", "_quality.toxic_text",
        "_quality.toxic_metadata", "_quality.toxic_score", kept("_quality").alias("kept"),
    )


@query
def op13_spelling_variants(spark, sf):
    from docweave.llm.spelling import variants, vocabulary

    found = variants(vocabulary(table(spark, sf, "documents"), typos=31))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_embedding_whitening(spark, sf):
    from docweave.llm.whitening import whiten

    return whiten(table(spark, sf, "embeddings"))


@query
def op11_chosen_path_dedup(spark, sf):
    from docweave.llm.chosen_paths import similar_components

    found = similar_components(table(spark, sf, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
