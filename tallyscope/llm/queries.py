"""The queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tallyscope.llm import language_id, license_scan, line_quality, mixing, ngram_model, packing, prefix_trie, quality_rules, repair, secret_scan, simhash, topk, warc
from tallyscope.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_quality_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    counts = [F.col(f"stats.{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return quality_rules.judged(docs, rules).select("doc_id", *counts, "base_failed", "kept")


@query("op2_mix_sources", mixing.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.mix_rates(docs)
    size, copies = F.col("mix.size"), F.col("mix.copies")
    return mix.select("doc_id", "mix.size", "mix.source_size", "mix.target", (size * copies).alias("taken"))


@query("op3_ngram_scores")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_model.held_out(F.col("doc_id"), 10)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram_model.train(docs.where(~out))
    return ngram_model.score(docs.withColumn("held_out", out), model)


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"))
    found = warc.read(files, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.with_spans(docs, secret_scan.learn(docs))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    spans = F.col("secrets")
    kinds = F.transform(spans, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.filter(spans, lambda s: s["kind"] != secret_scan.INFERRED)
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


@query("op7_exact_top_k")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = topk.top_k(vectors, F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op8_line_crf_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_model.held_out(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = line_quality.learn(docs, table(spark, sf_dir, "labels").where(~out))
    rows = line_quality.scored(docs.select("doc_id", out.alias("held_out"), "text"), model)
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_model.held_out(F.col("doc_id"), 5)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = language_id.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = language_id.learn(docs.where(~out), pieces)
    return language_id.predict(docs.select("doc_id", out.alias("held_out"), "text"), model)


@query("op11_prefix_trie", prefix_trie.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = prefix_trie.turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return prefix_trie.nodes(*prefix_trie.rebuilt(turned))


@query("op12_conversation_repair", repair.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


@query("op13_license_scan", license_scan.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        license_scan.labels_of(base).alias("base_labels"), license_scan.labels_of(F.col("spans")).alias("labels"), "score",
    )
