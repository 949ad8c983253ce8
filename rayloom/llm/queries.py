"""The registered queries of the training-data operators and their SQL.

Each applies its operator, with production parameters, to the whole of its
table and derives the contract's columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rayloom.llm import chat, cotrain, decontam, merkle, mixing, neardup, pii, quality, runs, secrets, substrings, tokens, warc
from rayloom.llm.common import WORD, table
from rayloom.llm.spans import let


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_back(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = cotrain.features(table(spark, sf_dir, "documents"))
    models = cotrain.co_train(views, table(spark, sf_dir, "labels"), ("quality", "toxic"))
    return cotrain.classify(views, models).withColumn("kept", cotrain.good(F.col("quality"), F.col("toxic")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    return secrets.scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[secrets.count_kind(found, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.listed(found, True), 256).alias("base_sha256"),
        secrets.listed(found, False).alias("spans"),
        secrets.count_live(found).alias("n_live"),
        secrets.ownership(found).alias("ownership"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontam.items_digest(F.col("items")).alias("items_sha256"), "contaminated")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = chat.format_chats(chat.from_turn_rows(rows))
    turns, under = chat.read_back(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return written.select("conv_id", turns.alias("turns"), under.alias("under"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_chars, doc_id = F.col("n_chars"), F.col("doc_id")
    tampered = merkle.leaf(doc_id, F.col("source"), F.col("lang"), n_chars + 1, F.col("text"))
    shown = F.when(F.crc32(doc_id.cast("string")) % 7 == 0, tampered)
    told = merkle.manifest(table(spark, sf_dir, "documents"), carry={"shown": shown})
    folded = merkle.fold(F.coalesce("shown", "leaf"), F.col("path"))
    return told.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(merkle.siblings(F.col("path")), ""), 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def with_period(doc_id: Column, text: Column) -> Column:
    """The texts that op12 reads: of those whose id's checksum ends in 0 the words from some place on repeat the first of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
        place = F.struct(words.alias("words"), a.alias("a"), p.alias("p"))
        told = let(place, lambda x: F.transform(x["words"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["words"], x["a"] + (i - x["a"]) % x["p"]))))
        return F.when(n > 0, F.array_join(told, " ")).otherwise(text)

    return F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), again)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = runs.collapse_runs(docs.select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"], r["length"]))), 1)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return told.withColumn("top", F.when(F.size("runs") > 0, longest)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        F.col("top.length").alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.col("top.length") * 1000 / F.col("top.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    return pii.scan_pii(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[pii.count_kind(found, k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(pii.listed(found, pii.BASE), 256).alias("base_sha256"),
        pii.listed(found).alias("spans"),
        pii.scores(found).alias("scores"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc": op2_warc,
    "op3_token_counts": op3_token_counts,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_secret_scan": op6_secret_scan,
    "op7_decontamination": op7_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op6_secret_scan": secrets.ORACLE_SQL,
    "op7_decontamination": decontam.ORACLE_SQL,
    "op8_quality_rules": quality.ORACLE_SQL,
    "op9_chat_formatting": chat.ORACLE_SQL,
    "op10_near_duplicates": neardup.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_personal_data": pii.ORACLE_SQL,
}
