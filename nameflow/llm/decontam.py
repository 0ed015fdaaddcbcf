"""Benchmark decontamination by a distributed positional inverted index.

The corpus is indexed in shards: each shard holds the postings of some documents - for every term its ascending word
positions in the shard, delta-coded.  The index is a written table of a row per shard and can be searched any
number of times; searching moves no text.  The windows of the test items are a written table too, and are searched in blocks of
BLOCK_WINDOWS, which bounds what is broadcast, whatever the size of the benchmark.  A shard drops the windows with a term
that it lacks; the others are searched from their rarest term there: that term's postings, less its place in the window,
are the candidate starts, and they are intersected with the offset-adjusted postings of the other terms, rarest first,
until none is left.  What the blocks find of a document is merged.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z.  A window is 8 consecutive item words;
an item of fewer, but not none, is one window.

Defined results: null and empty texts have no words and match nothing; items without words never
occur; words of an item of null id count as hit, but the item has no id to be counted or named by; repeated documents and
items are treated each on its own (equal item ids count once); further columns are ignored; an empty
corpus gives no rows, an empty benchmark rows without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .blobs import pack, steps, totals, unpack
from .shared import session, shared_folder, written

#: Windows of test items that are searched together (of 64 bytes each).
BLOCK_WINDOWS = 200_000
#: Positions between two documents of a shard; a slop must be less than half of it.
GAP = 64
_INDEX = "shard bigint, ids array<bigint>, text_keys array<bigint>, counts array<bigint>, index binary"
_WINDOWS = "block bigint, n bigint, items array<string>, windows binary"


def _tokens(part: tx.Slice) -> tuple[tx.Words, np.ndarray]:
    words = part.words(tx.WORD_ALNUM)
    return words, words.hashes()


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, key of the text): the postings of all terms of a slice of documents."""
    from pyspark import TaskContext

    shard = TaskContext.get().partitionId() << 32
    for b in batches:
        for part in tx.slices(b.column(1)):
            words, h = _tokens(part)
            # documents are set apart by GAP positions, so no match runs over an end
            place = np.arange(len(h)) + GAP * words.doc
            order = np.argsort(h, kind="stable")
            h, place = h[order], place[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            step = np.diff(place, prepend=0)
            step[first] = place[first]
            index = pack(term=steps(h[first]), df=np.diff(np.append(first, len(h))), step=step)
            own = [b.column(k).slice(int(part.rows[0]), len(part)) for k in (0, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([shard]), *map(_list, own), _list(pa.array(words.count, pa.int64())), pa.array([index], pa.binary())], names=["shard", "ids", "text_keys", "counts", "index"])
            shard += 1


def build_index(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the index of docs and returns it."""
    text = F.col(text_col)
    return written(docs.select(F.col(id_col).cast("bigint"), text, F.xxhash64(text)).mapInArrow(_index, _INDEX), folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_INDEX).parquet(folder)


def item_windows(texts: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(terms [windows, n], words of each window, its row) of slices of texts; shorter windows are padded with 0."""
    for part in tx.slices(texts):
        words, h = _tokens(part)
        room = np.concatenate([h, np.zeros(n, tx.U64)])
        count = np.where(words.count > 0, np.maximum(words.count - n + 1, 1), 0)
        row = np.repeat(np.arange(len(part)), count)
        start = tx.gather(np.arange(len(h)), words.first[:-1], count)
        size = np.minimum(words.count, n)[row]
        terms = np.lib.stride_tricks.sliding_window_view(room, n)[start] * (np.arange(n) < size[:, None])
        yield terms, size, row + part.rows[0]


def _windows(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            for terms, size, row in item_windows(b.column(1), n):
                for lo in range(0, len(size), BLOCK_WINDOWS):
                    part = slice(lo, lo + BLOCK_WINDOWS)
                    rows, owner = np.unique(row[part], return_inverse=True)
                    blob = pack(terms=terms[part].ravel(), size=size[part], owner=owner)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(owner)], pa.int64()), _list(b.column(0).take(pa.array(rows))), pa.array([blob], pa.binary())], names=["block", "n", "items", "windows"])
                    block += 1

    return run


def write_windows(benchmark: DataFrame, n: int, folder: str, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return written(benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).mapInArrow(_windows(n), _WINDOWS), folder)


class Windows:
    """A block's windows: terms (numbers into the sorted vocabulary, -1 past their ends), sizes, owners, item ids."""

    def __init__(self, rows: list, n: int):
        got = [unpack(bytes(r.windows)) for r in rows]
        terms = np.concatenate([g["terms"].astype(tx.U64).reshape(-1, n) for g in got])
        self.size = np.concatenate([g["size"] for g in got])
        self.items = [x for r in rows for x in r.items]
        base = np.cumsum([0, *(len(r.items) for r in rows)])
        self.owner = np.concatenate([g["owner"] + at for g, at in zip(got, base, strict=False)])
        inside = np.arange(n) < self.size[:, None]
        self.vocabulary = np.unique(terms[inside])
        self.number = np.where(inside, np.searchsorted(self.vocabulary, terms), -1)


class Postings:
    """A shard's postings of the terms of some vocabulary (sorted fingerprints)."""

    def __init__(self, blob: bytes, vocabulary: np.ndarray):
        got = unpack(blob)
        term, df, step = totals(got["term"].astype(tx.U64)), got["df"], got["step"]
        first = np.cumsum(df) - df
        place = np.cumsum(step)
        if len(df):
            place -= np.repeat(place[first] - step[first], df)
        at = np.minimum(np.searchsorted(term, vocabulary), max(len(term) - 1, 0))
        known = np.flatnonzero(term[at] == vocabulary) if len(term) else np.zeros(0, np.int64)
        self.first, self.df = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        self.df[known] = df[at[known]]
        self.first[known] = np.cumsum(self.df[known]) - self.df[known]
        self.places = tx.gather(place, first[at[known]], self.df[known])
        self.keys = np.repeat(known, self.df[known]) << 40 | self.places  # sorted

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, term << 40 | place)
        return (place >= 0) & (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == term << 40 | place) if len(self.keys) else np.zeros(len(term), bool)

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether the term stands within slop words of the place."""
        if not len(self.keys):
            return np.zeros(len(term), bool)
        want = term << 40 | np.maximum(place - slop, 0)
        at = np.searchsorted(self.keys, want)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 40 | np.maximum(place + slop, 0)))


def search_shard(post: Postings, terms: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, first word, place of its rarest term) of every occurrence; terms: numbers of the windows' terms, -1 past their ends.
    With a slop, every term may stand so many words off its place."""
    n = terms.shape[1]
    # windows with a term that the shard lacks go first; the others are few
    live = np.flatnonzero(((terms < 0) | (post.df[np.maximum(terms, 0)] > 0)).all(axis=1))
    df = np.where(terms[live] >= 0, post.df[np.maximum(terms[live], 0)], 1 << 40)
    order = np.argsort(df, axis=1, kind="stable")
    lead, rarest = order[:, 0], df.min(axis=1, initial=1 << 40)
    which = np.repeat(np.arange(len(live)), rarest)
    start = tx.gather(post.places, post.first[terms[live, lead]], rarest) - lead[which]
    for k in range(1, n):
        if not len(which):
            break
        place = order[which, k]
        term = terms[live[which], place]
        if slop:
            ok = (term < 0) | post.near(term, start + place, slop)
        else:
            ok = (term < 0) | post.has(term, start + place)
        which, start = which[ok], start[ok]
    return live[which], start, start + lead[which]


_HITS = "shard bigint, row bigint, items array<string>, near array<string>, begins array<bigint>, ends array<bigint>"


def _search(given, slop: int):
    """Rows (shard, counts, index): what a block of windows finds, a row per document with a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = given.value
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for shard, count, blob in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                count = count.values.to_numpy()
                first = np.cumsum(count) - count + GAP * np.arange(len(count))
                post = Postings(blob, w.vocabulary)
                items: dict[int, set[int]] = {}
                near: dict[int, set[int]] = {}
                cover = np.zeros(int(count.sum()) + GAP * len(count) + 1, np.int32)
                for into, off in ((items, 0), (near, slop))[: 1 + bool(slop)]:
                    window, start, anchor = search_shard(post, w.number, off)
                    row = np.searchsorted(first, anchor, side="right") - 1
                    for r, o in set(zip(row.tolist(), w.owner[window].tolist(), strict=True)):
                        into.setdefault(r, set()).add(o)
                    if not off:
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + w.size[window], -1)
                edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0)
                begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                cut = np.searchsorted(begin, first)
                for r in sorted(items.keys() | near.keys()):
                    mine = slice(cut[r], cut[r + 1] if r + 1 < len(cut) else None)
                    names = ([w.items[o] for o in x.get(r, ()) if w.items[o] is not None] for x in (items, near))
                    for column, value in zip(out, (shard, r, *names, begin[mine] - first[r], end[mine] - first[r]), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in _HITS.split(", ")])

    return run


def _blocks(windows: DataFrame) -> Iterator[list[int]]:
    """Rows of the windows' table that are searched together."""
    block, size = [], 0
    for r in windows.select("block", "n").orderBy("block").toLocalIterator():  # a row per 2 MB of item texts
        if block and size + r.n > BLOCK_WINDOWS:
            yield block
            block, size = [], 0
        block.append(r.block)
        size += r.n
    if block:
        yield block


def search(index: DataFrame, windows: DataFrame, n: int, slop: int, folder: str) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit (words inside an occurrence of any window), n_items and items
    (ids of items with an occurring window) and n_near_items (items with a window whose words all stand
    within slop of their places)."""
    spark = index.sparkSession
    hits = [spark.createDataFrame([], _HITS)]
    for k, block in enumerate(_blocks(windows)):
        rows = windows.where(F.col("block").isin(block)).orderBy("block").collect()  # BLOCK_WINDOWS windows at most
        given = spark.sparkContext.broadcast(Windows(rows, n))
        hits.append(written(index.select("shard", "counts", "index").mapInArrow(_search(given, slop), _HITS), f"{folder}/{k}"))
    found = hits[0] if len(hits) == 1 else spark.read.schema(_HITS).parquet(*(f"{folder}/{k}" for k in range(len(hits) - 1)))
    every = lambda c: F.flatten(F.collect_list(c))
    span = F.arrays_zip(every("begins").alias("begin"), every("ends").alias("end"))
    found = found.groupBy("shard", "row").agg(F.array_sort(F.array_distinct(every("items"))).alias("items"), F.array_distinct(every("near")).alias("near"), F.sort_array(span).alias("spans"))
    # spans of different blocks may overlap
    none = F.struct(F.lit(0).cast("bigint").alias("reach"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["reach"], x["end"]).alias("reach"), (a["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(a["reach"], x["begin"]))).alias("n"))
    found = found.select("shard", "row", "items", "near", F.aggregate("spans", none, step, lambda a: a["n"]).alias("hit"))
    docs = index.select("shard", F.posexplode(F.arrays_zip("ids", "text_keys", "counts")).alias("row", "d"))
    docs = docs.select("shard", F.col("row").cast("bigint").alias("row"), F.col("d.ids").alias("doc_id"), F.col("d.text_keys").alias("text_key"), F.col("d.counts").alias("n_words"))
    names = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    count = lambda c: F.size(names(c)).cast("bigint")
    return docs.join(found, ["shard", "row"], "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("hit", F.lit(0).cast("bigint")).alias("n_hit"),
        count("items").alias("n_items"), count("near").alias("n_near_items"), names("items").alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, slop: int = 2, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Indexes docs and searches every window of the benchmark; see search()."""
    folder = shared_folder(session(docs), "postings")
    index = build_index(docs, f"{folder}/index", id_col, text_col)
    windows = write_windows(benchmark, n, f"{folder}/windows", item_col, text_col)
    return search(index, windows, n, slop, f"{folder}/hits")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (at least two items)"""
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (F.col("n_items") >= 2).alias("contaminated"),
    )
