"""The corpus pipeline: quality rules, n-gram Jaccard join, decontamination, personal data, sentencepiece ids.

Every stage takes what the one before it kept, written as Parquet, and applies its decisions: rejected documents
and failing lines go; of each group of near-duplicates the document with the smallest id stays; documents that hold
windows of two benchmark items or more go, each row by its own text; personal data is masked; the last stage returns
the documents with their ids.  A row of null id links with nothing, so the Jaccard join keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameflow.llm import decontam, lines, pieces, pii, sigtree
from nameflow.llm.queries import table, tokenizer_path
from nameflow.llm.shared import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of repeated rows of the staying id all stay."""
    found = sigtree.join_components(docs, n=5, percent=80)
    kept = found.where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    dirty = found.where("n_items >= 2").select("doc_id", "text_key").distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(dirty["doc_id"]) & (F.xxhash64(docs["text"]) == dirty["text_key"])
    return docs.join(dirty, same, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"), ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", sentencepiece_ids),
]

#: The stages are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return made
        made.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{k}")
    return docs
