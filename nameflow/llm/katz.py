"""Language-model scoring by a Katz back-off bigram model.

Tokens are a text's words, A-Z in lower case, and one end.  Words of at least `least` training occurrences are model
types of their own, however many there are; the others (with least = 1, words the training rows lack) share one type,
`rare`, within which a word's probability is its smoothed share of the rare training tokens, so every word
counts and the model stays normalised over all of them.

Bigram counts up to DISCOUNTED are discounted by Good-Turing with Katz's correction; what a context loses goes to the
types unseen after it, in proportion to their unigram probability, by a weight that makes its probabilities add up to
one: alpha(u) = (1 - sum of seen P(w|u)) / (1 - sum of P(w) of the same types).  A token's score is
log10 P(w|u), or log10 alpha(u) + log10 P(w) where u w is unseen: the recursion of one order down.

Texts are cut into slices of about RUN_WORDS words once.  A slice sends its distinct words to the shards of their fingerprints and gets back
their counts and types, sends its distinct pairs of types and gets back their counts, and gets its contexts' weights
from the shards of their words; then it scores its documents.  Tables (Parquet, in the shared folder): `words` - the slices'
texts as word numbers, counts and types by shard and slice; `bigrams` - counts by shard and slice, statistics of contexts by
shard of words; `contexts` - their weights by shard and slice.  The driver holds a few numbers a shard.

Defined results: null and empty texts are one end token; rows of a null id are training rows; repeated
rows stay repeated; other columns are ignored; an empty table gives an empty table; without training rows
all types are equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .blobs import pack, steps, totals, unpack
from .shared import parallelism, session, shared_folder, written

DISCOUNTED = 5
#: Words of the documents that go together (a longer document goes alone).
RUN_WORDS = 1_000_000
START, RARE, END, FIRST = 0, 1, 2, 3
_BLOB = "shard int, slice bigint, blob binary"
#: Kinds of rows: statistics of a shard, a slice's words, its text, contexts of a shard, a slice's pairs, its contexts.
SHARD, WORDS, TEXT, PARTIAL, PAIRS, WEIGHTS = range(6)
_KINDS = "kind int, " + _BLOB


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["shard", "slice", "blob"])


def _kinds(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["kind", "shard", "slice", "blob"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(number, ids, train, words per document, fingerprints of the words) of runs of documents."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    held: list[tuple] = []

    def run() -> tuple:
        ids, train, count, h = zip(*held, strict=True)
        held.clear()
        return at, pa.concat_arrays(ids), np.concatenate(train), np.concatenate(count), np.concatenate(h)

    for b in batches:
        for part in tx.slices(b.column(1)):
            words, lo = part.words(), int(part.rows[0])
            train = np.asarray(b.column(2).slice(lo, len(part))).astype(np.int64)
            held.append((b.column(0).slice(lo, len(part)).cast(pa.int64()), train, words.count, words.hashes()))
            if sum(len(x[3]) for x in held) > RUN_WORDS:
                yield run()
                at += 1
    if held:
        yield run()


def _by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by shard, where each shard begins in it)"""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _send_words(shards: int):
    """A slice's distinct words by shard, and its text as numbers of its words in that order.  Shard 0 hears of every slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, ids, train, count, h in _parts(batches):
            key, word = np.unique(h, return_inverse=True)
            order, cut = _by_shard((key % tx.U64(shards)).astype(np.int64), shards)
            place = np.empty(len(key), np.int64)
            place[order] = np.arange(len(key))
            word, key = place[word], key[order]
            trained = np.bincount(word, weights=np.repeat(train, count), minlength=len(key)).astype(np.int64)
            for s in range(shards):
                if not s or cut[s] < cut[s + 1]:
                    yield _batch([(s, at, pack(key=steps(key[cut[s] : cut[s + 1]]), trained=trained[cut[s] : cut[s + 1]]))])
            about = pack(id=ids.fill_null(0).to_numpy(), null=np.asarray(ids.is_null()).astype(np.int8), n=count, train=train, word=word)
            yield _batch([(at % shards, at, about)])

    return run


def _count_words(least: int):
    """SHARD: (kept types, all types, tokens, tokens of kept types); WORDS: ranks among the kept (or -1) and counts; TEXT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for s, at, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = unpack(x)
                if "id" in got:
                    yield _kinds([(TEXT, s, at, x)])
                else:
                    by.setdefault(s, []).append((at, totals(got["key"].astype(tx.U64)), got["trained"]))
        for s in list(by):
            group = by.pop(s)
            word, inverse = np.unique(np.concatenate([k for _, k, _ in group]), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([t for _, _, t in group]), minlength=len(word)).astype(np.int64)
            kept = count >= least
            rank = np.where(kept, np.cumsum(kept) - 1, -1)
            lo, rows = 0, [(SHARD, s, 0, pack(stat=np.array([kept.sum(), (count > 0).sum(), count.sum(), count[kept].sum()])))]
            for at, key, _ in group:
                mine = inverse[lo : lo + len(key)]
                lo += len(key)
                rows.append((WORDS, s, at, pack(shard=np.array([s]), rank=rank[mine], count=count[mine])))
            yield _kinds(rows)

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[dict[str, np.ndarray]]]]]:
    """(slice, its rows by kind, in the order of their shards) of rows sorted by slice, kind and shard."""
    now, rows = None, {}
    for b in batches:
        for kind, at, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if now is not None and at != now:
                yield now, rows
                rows = {}
            now = at
            rows.setdefault(kind, []).append(unpack(x))
    if now is not None:
        yield now, rows


def _joined(parts: list[dict[str, np.ndarray]], name: str) -> np.ndarray:
    return np.concatenate([p[name] for p in parts])


class Sizes:
    """What all tasks know of the training rows: types kept and where the ids of a shard begin, tokens, ends."""

    def __init__(self, stats: np.ndarray, ends: int):
        """stats: the SHARD rows' numbers by shard"""
        kept, types, tokens, kept_tokens = stats.sum(axis=0).tolist()
        #: ids of the kept types of shard s are base[s]..base[s + 1]; START, RARE and END are the first of shard 0
        self.base = np.concatenate([[0], FIRST + np.cumsum(stats[:, 0])])
        assert self.base[-1] < 1 << 31
        self.ends, self.tokens, self.types = ends, tokens + ends, types + (ends > 0)
        self.rare_tokens, self.rare_types = tokens - kept_tokens, types - kept
        self.norm = self.tokens + 0.5 * (kept + 2)


class Text:
    """A slice's tokens - every document's, then its end - as numbers into its words, END and START, and their pairs."""

    def __init__(self, rows: dict[int, list[dict[str, np.ndarray]]], z: Sizes, shards: int):
        (self.about,), parts = rows[TEXT], rows[WORDS]
        a, n = self.about, len(self.about["id"])
        self.count = _joined(parts, "count")
        m = len(self.count)
        at, kind = 0, np.empty(m + 2, np.int64)
        for p in parts:
            r = p["rank"]
            kind[at : at + len(r)] = np.where(r >= 0, r + z.base[int(p["shard"][0])] + (FIRST if not p["shard"][0] else 0), RARE)
            at += len(r)
        kind[m:] = END, START
        self.kind, ends = kind, np.cumsum(a["n"])
        self.doc = np.insert(np.repeat(np.arange(n), a["n"]), ends, np.arange(n))
        self.w = np.insert(a["word"], ends, m)
        self.u = np.concatenate([[m], self.w[:-1]])
        self.u[self.u == m] = m + 1
        pair, self.first, inverse = np.unique(kind[self.u] << 32 | kind[self.w], return_index=True, return_inverse=True)
        order, self.cut = _by_shard((tx.mix(pair.astype(tx.U64)) % tx.U64(shards)).astype(np.int64), shards)
        place = np.empty(len(pair), np.int64)
        place[order] = np.arange(len(pair))
        self.pair, self.first, self.of = pair[order], self.first[order], place[inverse]
        #: training tokens of each word's type
        self.of_kind = np.append(np.where(kind[:m] == RARE, z.rare_tokens, self.count), [z.ends, 0])


def _send_bigrams(shards: int, z: Sizes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _slices(batches):
            t = Text(rows, z, shards)
            trained = np.bincount(t.of, weights=t.about["train"][t.doc], minlength=len(t.pair)).astype(np.int64)
            of_w = t.of_kind[t.w[t.first]]
            for s in range(shards):
                lo, hi = t.cut[s], t.cut[s + 1]
                if lo < hi:
                    yield _batch([(s, at, pack(pair=steps(t.pair[lo:hi]), trained=trained[lo:hi], of_w=of_w[lo:hi]))])

    return run


#: Of a context: how many types follow 1..DISCOUNTED + 1 times, occurrences beyond DISCOUNTED, types, their training tokens.
_STATS = [*(f"m{r}" for r in range(1, DISCOUNTED + 2)), "big", "types", "of_w"]


def _count_bigrams(shards: int, z: Sizes):
    """SHARD: counts of counts; PAIRS: counts; PARTIAL: statistics of the contexts of a shard of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list] = {}
        for b in batches:
            for s, at, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                g = unpack(x)
                by.setdefault(s, []).append((at, totals(g["pair"]), g["trained"], g["of_w"]))
        for s in list(by):
            group = by.pop(s)
            pair, first, inverse = np.unique(np.concatenate([g[1] for g in group]), return_index=True, return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([g[2] for g in group]), minlength=len(pair)).astype(np.int64)
            of_w = np.concatenate([g[3] for g in group])[first]
            lo, rows = 0, []
            for at, key, _, _ in group:
                rows.append((PAIRS, s, at, pack(seen=count[inverse[lo : lo + len(key)]])))
                lo += len(key)
            del group, inverse
            seen = count > 0
            u, c, of_w = pair[seen] >> 32, count[seen], of_w[seen]
            rows.append((SHARD, s, 0, pack(stat=np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2])))
            head = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
            ctx, at = u[head], np.append(head, len(u))
            stat = {f"m{r}": tx.sums_by(at, (c == r).astype(np.int64)) for r in range(1, DISCOUNTED + 2)}
            stat |= {"big": tx.sums_by(at, c * (c > DISCOUNTED)), "types": np.diff(at), "of_w": tx.sums_by(at, of_w)}
            cut = np.searchsorted(ctx, z.base)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                own = slice(cut[k], cut[k + 1])
                rows.append((PARTIAL, k, s, pack(ctx=steps(ctx[own] - z.base[k]), **{name: v[own] for name, v in stat.items()})))
            yield _kinds(rows)

    return run


def discounts(nr: np.ndarray) -> np.ndarray:
    """Factors by count 0..DISCOUNTED + 1 (and beyond), from the counts of counts 1..DISCOUNTED + 1."""
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 2)
    good = nr.all()
    if good:
        spare = (k + 1) * nr[k] / nr[0]
        for r in range(1, k + 1):
            out[r] = ((r + 1) * nr[r] / nr[r - 1] / r - spare) / (1 - spare) if spare < 1 else 0.0
    if not good or (out[1:] <= 0).any() or (out > 1).any():
        # too few counts for Good-Turing: half a count off each
        out[1 : k + 1] = (np.arange(1, k + 1) - 0.5) / np.arange(1, k + 1)
    return out


def weights(stat: dict[str, np.ndarray], discount: np.ndarray, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """(scale, alpha) of contexts: P(w|u) is discount * count * scale where u w is seen, else alpha * P(w)."""
    total = kept = stat["big"].astype(np.float64)
    for r in range(1, DISCOUNTED + 1):
        total = total + stat[f"m{r}"] * r
        kept = kept + stat[f"m{r}"] * r * discount[r]
    some = total > 0
    # a context without discounted counts gives half a count to the unseen
    scale = 1 / np.where(some, np.where(kept >= total, total + 0.5, total), 1)
    rest = 1 - (stat["of_w"] + 0.5 * stat["types"]) / norm
    full = some & (rest <= 1e-9)
    scale = np.where(full, 1 / np.where(some, kept, 1), scale)
    alpha = np.where(full | ~some, 1.0, (1 - kept * scale) / np.where(full, 1, rest))
    return np.where(some, scale, 0.0), alpha


def _weigh(z: Sizes, discount: np.ndarray):
    """WEIGHTS: (scale, alpha) of a slice's words of a shard; from shard 0 also those of START and RARE, in front."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        stats: dict[int, dict[str, np.ndarray]] = {}
        for b in batches:
            for kind, s, at, x in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if kind == WORDS:
                    asked.setdefault(s, []).append((at, x))
                    continue
                g = unpack(x)
                if s not in stats:
                    stats[s] = {name: np.zeros(int(z.base[s + 1] - z.base[s]), np.int64) for name in _STATS}
                ctx = totals(g["ctx"])
                for name in _STATS:
                    stats[s][name][ctx] += g[name]
        for s in list(asked):
            size = int(z.base[s + 1] - z.base[s])
            scale, alpha = weights(stats.pop(s), discount, z.norm) if s in stats else (np.zeros(size), np.ones(size))
            for at, x in asked.pop(s):
                rank = unpack(x)["rank"]
                own = rank + FIRST if s == 0 else rank
                if s == 0:
                    own = np.concatenate([[START, RARE], np.where(rank >= 0, own, RARE)])
                # weights of rare words are those of RARE, which the slice has from shard 0
                more = [np.append(v, 0.0)[own] for v in (scale, alpha)]
                yield _kinds([(WEIGHTS, s, at, pack(scale=more[0], alpha=more[1]))])

    return run


_SCORED = "doc_id bigint, train bigint, n bigint, n_known bigint, base_score double, score double"


def _score(shards: int, z: Sizes, discount: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm, rare_norm = np.log10(z.tokens + 0.5 * (z.types + 1)), np.log10(z.rare_tokens + 0.5 * (z.rare_types + 1))
        for _, rows in _slices(batches):
            t = Text(rows, z, shards)
            a, n, m = t.about, len(t.about["id"]), len(t.count)
            seen, scale, alpha = _joined(rows[PAIRS], "seen"), _joined(rows[WEIGHTS], "scale"), _joined(rows[WEIGHTS], "alpha")
            scale, alpha = (np.append(np.where(t.kind[:m] == RARE, v[1], v[2:]), [0.0, v[0]]) for v in (scale, alpha))
            u, w = t.u[t.first], t.w[t.first]
            value = np.where(seen > 0, np.maximum(discount[np.minimum(seen, DISCOUNTED + 1)] * seen * scale[u], 1e-300), alpha[u] * (t.of_kind[w] + 0.5) / z.norm)
            own = np.append(np.log10(t.count + 0.5), [np.log10(z.ends + 0.5), 0.0])
            share = np.where(t.kind == RARE, own - rare_norm, 0.0)
            known = np.append(t.count > 0, [z.ends > 0, False])
            sums = lambda v: np.bincount(t.doc, weights=v, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a["id"], pa.int64(), mask=a["null"].astype(bool)), pa.array(a["train"], pa.int64()), pa.array(a["n"] + 1, pa.int64()), pa.array(sums(known[t.w]).astype(np.int64)),
                    pa.array(sums(own[t.w]) - (a["n"] + 1) * norm), pa.array(sums(np.log10(value)[t.of] + share[t.w])),
                ],
                names=[x.split()[0] for x in _SCORED.split(", ")],
            )

    return run


def score(docs: DataFrame, train, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """train: boolean column of docs; least: training occurrences that make a word a type of its own, 1 or more.
    Per document: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = session(docs)
    folder, shards = shared_folder(spark, "katz"), parallelism(docs)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), train.alias("train"))
    to_shard = lambda df: df.repartitionById(shards, F.col("shard"))
    by_slice = lambda df: df.repartition(shards, "slice").sortWithinPartitions("slice", "kind", "shard")
    collected = lambda df: {r.shard: unpack(bytes(r.blob))["stat"] for r in df.where(F.col("kind") == SHARD).select("shard", "blob").collect()}  # noqa: E731  a row a shard
    words = written(to_shard(docs.mapInArrow(_send_words(shards), _BLOB)).mapInArrow(_count_words(least), _KINDS), f"{folder}/words")
    stats = collected(words)
    z = Sizes(np.array([stats.get(s, np.zeros(4, np.int64)) for s in range(shards)]), docs.where("train").count())
    texts = words.where(F.col("kind").isin(WORDS, TEXT))
    pairs = written(to_shard(by_slice(texts).mapInArrow(_send_bigrams(shards, z), _BLOB)).mapInArrow(_count_bigrams(shards, z), _KINDS), f"{folder}/bigrams")
    discount = discounts(sum(collected(pairs).values(), np.zeros(DISCOUNTED + 1, np.int64)))
    asked = words.where(F.col("kind") == WORDS).union(pairs.where(F.col("kind") == PARTIAL))
    contexts = written(to_shard(asked).mapInArrow(_weigh(z, discount), _KINDS), f"{folder}/contexts")
    scored = by_slice(texts.union(pairs.where(F.col("kind") == PAIRS)).union(contexts)).mapInArrow(_score(shards, z, discount), _SCORED)
    return scored.select("doc_id", (F.col("train") == 0).alias("held_out"), F.col("n").alias("n_tokens"), "n_known", F.lit(z.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
