"""Importance resampling as a quality classifier.

Two generative models over hashed n-grams (a text's words and pairs of adjacent words, in BUCKETS
buckets) are estimated: one of target text, one of all raw text.  A document's log weight is the log
ratio of the two likelihoods.  With independent Gumbel noise added to the log weights, the k largest keys
are a sample of k documents without replacement in proportion to the weights.

The raw model counts every document.  The target model counts labelled rows of quality 1 that are not toxic; it is
fitted on at most MAX_LABELLED labelled rows, those of the lowest hash of their id.  k is the share of the raw documents that all
labels together say is target.  The k-th largest key is found exactly by counting keys in ever finer ranges, so
nothing is sorted in one task.

Defined results: null and empty texts have weight 0 before noise; rows of a null id have the noise of
their text's hash and can be chosen; of rows with equal keys, as repeated rows have, those stored first are chosen, so k rows
are chosen whatever repeats; repeated rows stay repeated; other columns are ignored; an
empty table gives an empty table; without labels of the target all weights are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import session, shared_folder, written

BUCKETS = 10_000
MAX_LABELLED = 50_000
SEED = 17
SMOOTHING = 1.0


def bucket_counts(part: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram"""
    words = part.words()
    h = words.hashes()
    pairs, doc = tx.grams(h, words, 2, short=False)
    both = np.concatenate([tx.mix(h ^ tx.U64(tx.GRAM[60])), pairs])
    return np.concatenate([words.doc, doc]), (both % tx.U64(BUCKETS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for part in tx.slices(b.column(0)):
            total += np.bincount(bucket_counts(part)[1], minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def model(texts: DataFrame) -> np.ndarray:
    """Log probabilities of the buckets in a one-column table of texts; BUCKETS numbers, whatever its size."""
    rows = texts.mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.full(BUCKETS, SMOOTHING)
    for r in rows:
        total[r.bucket] += r.n
    return np.log(total / total.sum())


def gumbel(seed: int = SEED):
    """Standard Gumbel noise that depends on the column `noise` and the seed alone."""
    uniform = (F.pmod(F.xxhash64("noise", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, noise (what the row's noise follows from), n_grams, log_weight"""
    given = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tx.slices(b.column(1)):
                row, bucket = bucket_counts(part)
                n = np.bincount(row, minlength=len(part))
                # sums in one order, so that copies weigh the same wherever they stand
                order = np.lexsort((bucket, row))
                first = np.concatenate([[0], np.cumsum(n)])
                value = given.value[bucket[order]]
                total = [float(np.sum(value[x:y])) for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(int(part.rows[0]), len(part)) for k in (0, 2)), pa.array(n, pa.int64()), pa.array(total, pa.float64())], names=["doc_id", "noise", "n_grams", "log_weight"])

    noise = F.coalesce("doc_id", F.xxhash64("text"))
    return docs.select("doc_id", "text", noise.alias("noise")).mapInArrow(run, "doc_id bigint, noise bigint, n_grams bigint, log_weight double")


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> tuple[float, int]:
    """(the k-th largest value of `key`, how many of the rows equal to it belong to the k)"""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        inside = keys.where(F.col("key").between(lo, hi))
        slot = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        found = sorted(((int(r.slot), r.n, r.a, r.b) for r in inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()), reverse=True)  # a row per bin
        for _, n, a, b in found:
            if n >= k:
                lo, hi = a, b
                break
            k -= n
        if lo == hi:
            break
    return lo, k


def resample(docs: DataFrame, labels: DataFrame, seed: int = SEED, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_grams, log_weight, gumbel_key and selected, a row per document."""
    spark = session(docs)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(max_labelled)
    # the share is that of all labels; the sample only bounds what the target model is fitted on
    stats = known.agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good")).first()
    target = docs.join(F.broadcast(sample.where("good").select("doc_id").distinct()), "doc_id", "left_semi")
    ratio = model(target.select("text")) - model(docs.select("text")) if stats.good and sample.where("good").limit(1).count() else np.zeros(BUCKETS)
    scored = weights(docs, ratio).withColumn("key", F.col("log_weight") + gumbel(seed)).withColumn("place", F.monotonically_increasing_id())
    scored = written(scored.drop("noise"), shared_folder(spark, "weights"))
    total = scored.count()
    k = round(total * (stats.good or 0) / stats.n) if stats.n else total
    if not k:
        return scored.select("doc_id", "n_grams", "log_weight", F.col("key").alias("gumbel_key"), F.lit(False).alias("selected"))
    least, of_equal = kth_largest(scored, k)
    ties = scored.where(F.col("key") == least)
    if ties.limit(of_equal + 1).count() > of_equal:
        last, _ = kth_largest(ties.select((-F.col("place")).cast("double").alias("key")), of_equal)
        chosen = (F.col("key") > least) | ((F.col("key") == least) & (F.col("place") <= F.lit(int(-last))))
    else:
        chosen = F.col("key") >= least
    return scored.select("doc_id", "n_grams", "log_weight", F.col("key").alias("gumbel_key"), chosen.alias("selected"))
