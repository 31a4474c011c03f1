"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, decontam, html, langid, merkle, mixing, pii, quality, repair, simhash, tokens, toxicity
from .common import cut, read


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)], "conv_id long, turn long, role string, text string")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_chats(chat.as_events(turns)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(mixing.sized(read(spark, sf_dir, "documents")))
    return mixing.mix(rows).select("doc_id", "size", F.col("pattern_size").alias("source_size"), F.col("quota").alias("target"), "taken")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identified(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_rejected")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.main_text(pages, html.train(pages))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.report(rows, *repair.repaired(repair.damaged(rows)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_next(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.counted(alignment.links(read(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_toxicity": op3_toxicity, "op4_html": op4_html, "op5_quality": op5_quality, "op6_langid": op6_langid, "op7_decontamination": op7_decontamination, "op8_chat": op8_chat, "op9_mixing": op9_mixing, "op10_tokens": op10_tokens, "op11_repair": op11_repair, "op12_merkle": op12_merkle, "op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {"op7_decontamination": decontam.ORACLE, "op8_chat": chat.ORACLE, "op9_mixing": mixing.ORACLE, "op11_repair": repair.ORACLE}
