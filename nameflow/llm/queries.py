"""The queries of this subpackage and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, katz, langid, lines, oracles, pieces, pii, resample, sigtree, store
from .shared import shared_folder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation about the template itself.
CONFLICTING = r"\### Assistant: </turn> ok"


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONFLICTING), (-7, 1, "assistant", CONFLICTING)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digest(chat.format_conversations(rows.union(more)))


def op4_sigtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.join_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "ids")
    store.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder, end_id=2)
    return store.digests(spark, folder)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 5 <> 1"), F.lit(True))
    return katz.score(table(spark, sf_dir, "documents"), train, least=1)


def base_op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op8_pii: the counts of base spans."""
    return op8_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of op10_katz: all but the model's score."""
    found = op10_katz(spark, sf_dir)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES = {
    "op1_langid": op1_langid, "op2_chat": op2_chat, "op3_resample": op3_resample, "op4_sigtree": op4_sigtree, "op5_pieces": op5_pieces,
    "op6_lines": op6_lines, "op7_decontam": op7_decontam, "op8_pii": op8_pii, "op9_store": op9_store, "op10_katz": op10_katz,
    "base_op8": base_op8, "base_op10": base_op10,
}
#: Models, tokenizers and hashed noise cannot be said in SQL: tests/llm holds those queries against brute force.
SQL: dict[str, str] = {
    "op2_chat": oracles.OP2, "op4_sigtree": oracles.OP4, "op6_lines": oracles.OP6, "op7_decontam": oracles.OP7,
    "base_op8": oracles.BASE8, "base_op10": oracles.BASE10,
}
