"""Language identification by a linear-chain conditional random field over words.

A text is one chain of letter words.  A word's features are its prefixes and suffixes of
up to three bytes, its byte n-grams of one to four, itself (the lexicon) and its shape, all hashed into
FEATURES weights per language; transitions between the languages of adjacent words and the start are learned with
them.  Training maximises the conditional likelihood of pieces of at most CHAIN words of the training texts and, so
that switches occur, of pieces spliced from texts of two languages.  Forward-backward gives
every word's language probabilities; a text's language is that of the largest sum.

A word's emission scores depend on the word alone, so they are computed once per task and distinct word.
The recursions run over all blocks of CHAIN words of a slice at once: each block's product of transition and emission matrices
carries the forward values of a text into its next block and the backward values into the one before, so the
marginals are those of the whole text, whatever its length, in bounded memory.

The training rows are at most `per_language` distinct rows, those of the lowest hash of their id, of each of the
at most `languages` languages with the most rows; their texts are used whole.

Defined results: a text that is null or has no letter is `und` with score 0; rows of a null id cannot train
and are predicted; repeated rows train once and stay repeated; other columns never matter; ties go to the first language in
order; without training rows everything is `und`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .shared import session

FEATURES, CHAIN, TRAIN_DOCS, LANGUAGES, EPOCHS = 1 << 16, 64, 250, 200, 3
#: Parts of a language among which training rows are chosen first.
SALTS = 32
UND = "und"
_MASK = tx.U64(FEATURES - 1)


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers end to end, features per word)"""
    length = end - start
    byte = tx.gather(data, start, length).astype(tx.U64)
    first = np.cumsum(length) - length
    word = np.repeat(np.arange(len(start)), length)
    place = np.arange(len(byte)) - first[word]
    rest = length[word] - place
    feats, owner = [], []

    def add(kind: int, value: np.ndarray, own: np.ndarray) -> None:
        feats.append((tx.mix(value + tx.U64(tx.GRAM[kind])) & _MASK).astype(np.int64))
        owner.append(own)

    key = np.zeros(len(byte), tx.U64)
    for n in range(1, 5):
        m = len(byte) - n + 1
        if m <= 0:
            break
        key = key[:m] * tx.U64(257) + byte[n - 1 :] + tx.U64(1)
        ok = rest[:m] >= n
        add(n, key[ok], word[:m][ok])
        if n <= 3:
            add(10 + n, key[ok & (place[:m] == 0)], word[:m][ok & (place[:m] == 0)])
            add(20 + n, key[ok & (rest[:m] == n)], word[:m][ok & (rest[:m] == n)])
    add(30, tx.span_hashes(tx._BYTE[data], start, end), np.arange(len(start)))
    add(31, np.minimum(length, 12).astype(tx.U64), np.arange(len(start)))
    f, o = np.concatenate(feats), np.concatenate(owner)
    order = np.argsort(o, kind="stable")
    return f[order], np.bincount(o, minlength=len(start))


def blocks(words: tx.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block of each word, place in it, blocks of each row); blocks do not cross rows"""
    in_row = np.arange(len(words)) - words.first[:-1][words.doc]
    per_row = -(-words.count // CHAIN)
    base = np.cumsum(per_row) - per_row
    return base[words.doc] + in_row // CHAIN, in_row % CHAIN, per_row


def forward_backward(emit: np.ndarray, length: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """emit [chains, places, labels] -> (marginals, pair expectations [labels, labels], log likelihood normaliser
    per chain); places at and beyond a chain's length do not count."""
    c, n, k = emit.shape
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    t = np.exp(trans)
    alpha, scale = np.empty_like(e), np.ones((c, n))
    a = e[:, 0] * np.exp(start)
    for i in range(n):
        if i:
            a = np.where((i < length)[:, None], (alpha[:, i - 1] @ t) * e[:, i], alpha[:, i - 1])
        s = a.sum(axis=1)
        scale[:, i] = np.where(i < length, s, 1)
        alpha[:, i] = a / s[:, None]
    beta = np.ones((c, k))
    marg, pairs = np.empty_like(e), np.zeros((k, k))
    for i in range(n - 1, -1, -1):
        marg[:, i] = alpha[:, i] * beta * (i < length)[:, None]
        marg[:, i] /= np.maximum(marg[:, i].sum(axis=1, keepdims=True), 1e-300)
        if i:
            on = i < length
            step = e[:, i] * beta
            pair = (alpha[:, i - 1, :, None] * t[None] * step[:, None, :])[on]
            if len(pair):
                pairs += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta = np.where(on[:, None], step @ t.T, beta)
            beta /= beta.sum(axis=1, keepdims=True)
    inside = np.arange(n)[None] < length[:, None]
    return marg, pairs, (np.log(scale) + top[:, :, 0] * inside).sum(axis=1)


class Crf:
    def __init__(self, labels: list[str]):
        self.labels = labels
        k = len(labels)
        self.w = np.zeros((FEATURES, k), np.float32)
        self.trans, self.start = np.zeros((k, k)), np.zeros(k)

    def emissions(self, feats: np.ndarray, per_word: np.ndarray) -> np.ndarray:
        """Scores of words: the sum of their features' weights over the root of their number."""
        ends = np.cumsum(per_word)
        total = np.add.reduceat(self.w[feats], ends - per_word, axis=0) if len(per_word) else np.zeros((0, len(self.labels)), np.float32)
        return total / np.sqrt(per_word)[:, None]

    def fit(self, texts: list[tuple[str, int]], seed: int = 3) -> Crf:
        """texts with the numbers of their labels"""
        rng = np.random.default_rng(seed)
        k = len(self.labels)
        part = next(tx.slices(pa.array([t for t, _ in texts], pa.string()), 1 << 40))
        words = part.words(tx.WORD_LETTER)
        label = np.array([y for _, y in texts])[words.doc]
        # half of all pieces are spliced of two texts
        runs = []
        for d in range(len(texts)):
            a, b = int(words.first[d]), int(words.first[d + 1])
            runs += [np.arange(x, min(x + CHAIN, b)) for x in range(a, b, CHAIN)]
        rng.shuffle(runs)
        mixed = [np.concatenate([x[: int(rng.integers(1, CHAIN - 4))], y])[:CHAIN] for x, y in zip(runs[::2], runs[1::2], strict=False)]
        runs = runs + mixed
        rng.shuffle(runs)
        # features of the distinct words of the chains alone
        used = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.int64)
        _, lead, same = np.unique(words.hashes()[used], return_index=True, return_inverse=True)
        kinds = used[lead]
        number = np.zeros(len(words), np.int32)
        number[used] = same
        parts = [word_features(words.bytes, words.start[kinds[x : x + 20_000]], words.end[kinds[x : x + 20_000]]) for x in range(0, len(kinds), 20_000)]
        feats = np.concatenate([f.astype(np.uint16) for f, _ in parts]) if parts else np.zeros(0, np.uint16)
        per_kind = np.concatenate([n for _, n in parts]) if parts else np.zeros(0, np.int64)
        del parts, used, same, lead
        f_end = np.cumsum(per_kind)
        grad_w, grad_t, grad_s = np.full(self.w.shape, 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)
        for _ in range(EPOCHS):
            for lo in range(0, len(runs), 64):
                some = runs[lo : lo + 64]
                length = np.array([len(r) for r in some])
                flat = np.concatenate(some)
                which = number[flat]
                n = per_kind[which]
                fs = tx.gather(feats, f_end[which] - n, n)
                e = self.emissions(fs, n)
                c, i = np.repeat(np.arange(len(some)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
                emit = np.zeros((len(some), int(length.max()), k))
                emit[c, i] = e
                marg, pairs, _ = forward_backward(emit, length, self.trans, self.start)
                y = label[flat]
                gold = np.eye(k)[y]
                d = (gold - marg[c, i]) / np.sqrt(n)[:, None]
                spread = np.repeat(d, n, axis=0)
                g = np.stack([np.bincount(fs, weights=spread[:, j], minlength=FEATURES) for j in range(k)], axis=1).astype(np.float32)
                grad_w += g * g
                self.w += 0.3 * g / np.sqrt(grad_w)
                seen = np.zeros((k, k))
                follows = i[1:] > 0
                np.add.at(seen, (y[:-1][follows], y[1:][follows]), 1)
                g = seen - pairs
                grad_t += g * g
                self.trans += 0.1 * g / np.sqrt(grad_t)
                g = (gold - marg[c, i])[i == 0].sum(axis=0)
                grad_s += g * g
                self.start += 0.1 * g / np.sqrt(grad_s)
        return self

    def label_words(self, words: tx.Words, cache: tx.WordCache) -> np.ndarray:
        """Marginal probabilities of the languages of each word."""
        k = len(self.labels)

        def make(which: np.ndarray) -> list:
            feats, n = word_features(words.bytes, words.start[which], words.end[which])
            return list(self.emissions(feats, n))

        rows = cache.rows(words.hashes(), make)
        scores = cache.pool[(cache.start[rows][:, None] + np.arange(k)[None])]
        block, place, per_row = blocks(words)
        emit = np.zeros((int(per_row.sum()), CHAIN, k), np.float32)
        emit[block, place] = scores
        marg = marginals(emit, np.bincount(block, minlength=len(emit)), per_row, self.trans.astype(np.float32), self.start.astype(np.float32))
        return marg[block, place]


def marginals(emit: np.ndarray, length: np.ndarray, per_row: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals [block, place, label] of chains that are runs of per_row[r] consecutive blocks; emit [block, place, label]."""
    c, n, k = emit.shape
    e = np.exp(emit - emit.max(axis=2, keepdims=True)).transpose(1, 0, 2).copy()
    t, on = np.exp(trans), np.arange(n)[:, None] < length[None]
    head = np.cumsum(per_row) - per_row
    lead = np.zeros(c, bool)
    lead[head[per_row > 0]] = True
    later = np.flatnonzero(~lead)

    def forward(e: np.ndarray, on: np.ndarray, a: np.ndarray, alpha: np.ndarray | None) -> np.ndarray:
        """The last forward values; a: what the first word's emissions multiply"""
        for i in range(n):
            step = (a if i == 0 else a @ t) * e[i]
            step = step / step.sum(axis=1, keepdims=True)
            a = step if on[i].all() else np.where(on[i][:, None], step, a)
            if alpha is not None:
                alpha[i] = a
        return a

    # products of the blocks that follow others, as forward values of every label that may come before
    product = np.zeros((len(later), k, k), e.dtype)
    if len(later):
        el, ol = e[:, later], on[:, later]
        p = np.broadcast_to(np.eye(k, dtype=e.dtype), (len(later), k, k))
        for i in range(n):
            step = (p @ t) * el[i][:, None, :]
            step = step / step.sum(axis=(1, 2), keepdims=True)
            p = step if ol[i].all() else np.where(ol[i][:, None, None], step, p)
        product = p
    number = np.full(c, -1)
    number[later] = np.arange(len(later))
    into, behind = np.empty((c, k), e.dtype), np.ones((c, k), e.dtype)
    into[lead] = np.exp(start)
    ends = np.empty((c, k), e.dtype)
    ends[lead] = forward(e[:, lead], on[:, lead], into[lead], None)
    most = int(per_row.max()) if len(per_row) else 0
    longest = np.argsort(-per_row, kind="stable")
    reach = per_row[longest]
    for j in range(1, most):
        here = head[longest[: np.searchsorted(-reach, -j)]] + j  # rows of more than j blocks
        into[here] = ends[here - 1] @ t
        out = np.einsum("ck,ckl->cl", ends[here - 1], product[number[here]])
        ends[here] = out / out.sum(axis=1, keepdims=True)
    for j in range(most - 1, 0, -1):
        here = head[longest[: np.searchsorted(-reach, -j)]] + j
        back = np.einsum("ckl,cl->ck", product[number[here]], behind[here])
        behind[here - 1] = back / back.sum(axis=1, keepdims=True)
    alpha = np.empty_like(e)
    forward(e, on, into, alpha)
    marg, beta = np.empty_like(e), behind
    for i in range(n - 1, -1, -1):
        m = alpha[i] * beta
        marg[i] = m / m.sum(axis=1, keepdims=True)
        beta = np.where(on[i][:, None], (e[i] * beta) @ t.T, beta)
        beta = beta / beta.sum(axis=1, keepdims=True)
    return marg.transpose(1, 0, 2)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS, languages: int = LANGUAGES) -> Crf | None:
    """Fits the model on rows whose crc32 of the id, as text, is not 2 modulo 4."""
    session(docs)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(F.col(text_col)).alias("h"))
    texts = texts.where("doc_id is not null and lang is not null and text is not null").where(F.expr("crc32(cast(doc_id as string)) % 4 <> 2"))
    most = texts.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang")
    names = sorted(r.lang for r in most.collect())  # `languages` rows at most
    if not names:
        return None
    rows = texts.where(F.col("lang").isin(names)).select("lang", "doc_id", "h").distinct()
    # tasks, then SALTS parts of a language, keep their first before the rest meets (windows with a group limit)
    first = lambda df, *by: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id", "h"))).where(F.col("place") <= per_language).drop("place")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALTS)))
    chosen = first(first(salted, "lang", "salt").drop("salt"), "lang").select("lang", "doc_id", "h")
    # per_language * languages rows at most, here and, whatever repeats, in what comes back
    got = texts.join(F.broadcast(chosen), ["lang", "doc_id", "h"]).groupBy("lang", "doc_id", "h").agg(F.first("text").alias("text")).orderBy("doc_id", "lang", "h")
    number = {x: i for i, x in enumerate(names)}
    return Crf(names).fit([(r.text, number[r.lang]) for r in got.toLocalIterator()])


def predict(docs: DataFrame, crf: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score (mean probability of the language over the words), n_words,
    n_switches (adjacent words of a text with different likeliest languages)"""
    spark = session(docs)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(False))
    if crf is None:
        return docs.select("doc_id", held.alias("held_out"), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_switches"))
    given = spark.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        names = np.array([*m.labels, UND], dtype=object)
        cache = tx.WordCache(np.float32, most=400_000)
        for b in batches:
            for part in tx.slices(b.column(1)):
                words = part.words(tx.WORD_LETTER)
                p = m.label_words(words, cache) if len(words) else np.zeros((0, len(m.labels)), np.float32)
                total = np.stack([tx.sums_by(words.first, p[:, j].astype(np.float64)) for j in range(len(m.labels))], axis=1)
                best, n = total.argmax(axis=1), words.count
                score = np.minimum(total[np.arange(len(n)), best] / np.maximum(n, 1), 1.0)
                likely = p.argmax(axis=1)
                change = np.zeros(len(likely), np.int64)
                change[1:] = (likely[1:] != likely[:-1]) & (words.doc[1:] == words.doc[:-1])
                for k in np.flatnonzero(tx.sums_by(words.first, (part_ascii(words)).astype(np.int64)) == 0).tolist():
                    if not has_letter(part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode("utf-8", "replace")):
                        best[k], score[k] = len(m.labels), 0.0
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(int(part.rows[0]), len(part)), pa.array(names[best], pa.string()), pa.array(np.maximum(score, 0.0)), pa.array(n, pa.int64()), pa.array(tx.sums_by(words.first, change), pa.int64())],
                    names=["doc_id", "lang_pred", "score", "n_words", "n_switches"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_words bigint, n_switches bigint")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def part_ascii(words: tx.Words) -> np.ndarray:
    """Whether each word begins with an ASCII letter (then its text has a letter for sure)."""
    return words.bytes[words.start] < 0x80
