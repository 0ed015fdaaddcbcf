"""Content-addressed store of token ids.

Layout under one folder, written and read by Spark alone (any file system Spark reaches):

  objects/   kind 0: k0, k1 (the 128-bit content key), n, payload (little-endian ids): each chunk once.
             kind 1: a document's keys and chunk sizes, as the tokenizer's task left them
  recipes/   part, place (in the part), doc_id, start (within the part), n_tokens, keys, sizes; in ascending
             doc_id order, part by part
  manifest/  part, base (ids before the part), n_docs, node; and a row of part -1 with the Merkle root

A chunk ends where a rolling hash of its last WINDOW ids has its low bits at zero, within
[MIN_IDS, MAX_IDS]; so equal passages give equal chunks wherever they stand.  A leaf is the hash of all of a
recipe, a block that of BLOCK leaves in their order, a node that of a part's blocks, the root that of all nodes.
Readers compute leaves, blocks, nodes and root from the recipes and compare them with the manifest, so a
recipe that is lost, added, moved or changed is noticed; they hash every payload again and compare it with its
key, and a chunk that is missing is an error.

Payloads move once, to the task that stores them; a chunk that a task has sent before is not sent
again, so a text with any number of copies costs a row per task.  Checking moves no payload: the
CRC of a document follows from those of its chunks and the number of ids after each.

Defined results: null and empty text give the end id alone; repeated documents give equal recipes
and no further chunk; rows with equal doc_id are told apart by their content hash and a running
number; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .shared import freed_shuffles, parallelism, saved, session

WINDOW, MIN_IDS, MASK_BITS, MAX_IDS = 16, 256, 10, 8192
#: Leaves under a node's block, which bounds what a reader gathers.
BLOCK = 4096
_CP = np.random.default_rng(7).integers(0, 1 << 63, 1 << 16, dtype=np.int64).astype(tx.U64) * tx.U64(2) + tx.U64(1)
_GEAR = np.random.default_rng(11).integers(0, 1 << 63, 1 << 16, dtype=np.int64).astype(tx.U64)
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """By code point: 0 white space, 1 letter, 2 number, 3 other."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, 3, dtype=np.uint8)
        for cp in range(0x110000):
            kind = unicodedata.category(chr(cp))[0]
            if kind == "L":
                table[cp] = 1
            elif kind == "N":
                table[cp] = 2
        #: Unicode's White_Space
        table[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
        _classes = table
    return _classes


def pretokens(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces that byte-level BPE merges within: letters, numbers or other characters
    with one space before them, English contractions, and white space.  first: code point offsets
    of the rows."""
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[cps]
    row = np.zeros(n + 1, dtype=bool)
    row[first] = True
    row[n] = True
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    new |= row[:n]
    white = kind == 0
    begin = new & white  # of runs of white space
    text = np.flatnonzero(new & ~white)  # starts of other runs
    led = text[(text > 0)]
    led = led[white[led - 1] & ~row[led]]  # with white space before them, in the same row
    begin[led - 1] = True  # the last white space stands apart from those before it
    start = begin
    start[text] = True
    start[led[cps[led - 1] == 0x20]] = False  # a space joins what follows
    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        room = np.append(cps, [0, 0, 0])
        edge = np.append(row, [True, True, True])
        one, two = room[quote + 1], room[quote + 2]
        in1, in2 = ~edge[quote + 1], ~edge[quote + 1] & ~edge[quote + 2]
        short = in1 & np.isin(one, [ord(c) for c in "stmd"])
        long = in2 & ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for which, size in ((short, 2), (long, 3)):
            q = quote[which]
            start[q + 1] = False
            after = q + size
            after = after[(after < n)]
            start[after[(kind[after] == 1)]] = True
    return np.flatnonzero(start)


def _byte_chars() -> dict[int, str]:
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Tokenizer:
    """Byte-level BPE of a tokenizers file: the pieces are found with arrays, each distinct piece
    is merged once per task by the library.  special: whether the text of a special token stands for
    that token, as in the library's default setting, or is text like any other."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer as Lib

        self.lib = Lib.from_file(path)
        self.lib.encode_special_tokens = not special
        added = {i: t for i, t in self.lib.get_added_tokens_decoder().items() if special or not t.special}
        #: tokens that are cut out of a text before its pieces are found
        self.added = {t.content: i for i, t in added.items()}
        self.find = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        #: files of other splitting rules, and tokens with conditions on their surroundings, are left to the library
        split = self.lib.pre_tokenizer
        usual = type(split).__name__ == "ByteLevel" and not split.add_prefix_space and getattr(split, "use_regex", True)
        usual = usual and self.lib.normalizer is None and type(self.lib.model).__name__ == "BPE" and not self.lib.model.dropout
        self.plain = usual and not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values())
        self.model, self.chars = self.lib.model, _byte_chars()
        self.wide = self.lib.get_vocab_size() > 1 << 16
        self.cache = tx.WordCache(np.uint32 if self.wide else np.uint16)

    def encode(self, part: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per row)"""
        s = part.data.tobytes().decode("utf-8", "replace")
        if not self.plain:
            raw, at = part.data.tobytes(), part.offsets
            found = [x.ids for x in self.lib.encode_batch([raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(part))], add_special_tokens=False)]
            return np.array([i for x in found for i in x], dtype=self.cache.dtype), np.array([len(x) for x in found], dtype=np.int64)
        cps = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if len(cps) == len(part.data):
            first = part.offsets
        else:
            lead = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
            first = lead[part.offsets]
        if any(map(s.__contains__, self.added)):
            within = [m.span() for lo, hi in itertools.pairwise(first.tolist()) for m in self.find.finditer(s, lo, hi)]
        else:
            within = []
        marks = np.array(within, dtype=np.int64).reshape(-1, 2)
        start = pretokens(cps, np.concatenate([first, marks.ravel()]))
        if len(marks):  # a token is one piece
            token = np.searchsorted(marks[:, 0], start, side="right") - 1
            start = start[(token < 0) | (start == marks[token, 0]) | (start >= marks[token, 1])]
        end = np.append(start[1:], len(cps))[: len(start)]
        values = _CP[cps & 0xFFFF]
        if len(cps) and int(cps.max()) > 0xFFFF:
            values = values + (cps >> 16).astype(tx.U64) * tx.U64(0x9E3779B97F4A7C15)
        h = tx.span_hashes(values, start, end)
        whole = np.isin(start, marks[:, 0]) if len(marks) else np.zeros(len(start), bool)
        h[whole] = tx.mix(h[whole] + tx.U64(1))

        def make(which: np.ndarray) -> list[list[int]]:
            out = []
            for a, b, token in zip(start[which].tolist(), end[which].tolist(), whole[which].tolist(), strict=True):
                out.append([self.added[s[a:b]]] if token else [t.id for t in self.model.tokenize(s[a:b].encode().decode("latin-1").translate(self.chars))])
            return out

        ids, length = self.cache.ragged(self.cache.rows(h, make))
        return ids, tx.sums_by(np.searchsorted(start, first), length)


def chunk_ends(ids: np.ndarray, first: np.ndarray, bits: int = MASK_BITS, least: int = MIN_IDS, most: int = MAX_IDS) -> list[np.ndarray]:
    """Ends of the chunks of each document first[k]:first[k+1], from content alone: a place is a
    candidate if the gear hash of the WINDOW ids before it is zero in its low bits."""
    gear = _GEAR[ids & 0xFFFF]
    roll = np.zeros(len(ids), dtype=tx.U64)
    for k in range(WINDOW):
        roll[WINDOW - 1 :] += gear[WINDOW - 1 - k : len(ids) - k] << tx.U64(k) if len(ids) >= WINDOW else 0
    marks = np.flatnonzero(tx.mix(roll) & tx.U64((1 << bits) - 1) == 0) + 1
    out = []
    at = np.searchsorted(marks, first)
    for k in range(len(first) - 1):
        lo, hi, ends = int(first[k]), int(first[k + 1]), []
        for m in [*marks[at[k] : at[k + 1]].tolist(), hi]:
            if m < hi and (m - lo < least or m - WINDOW < first[k]):
                continue
            while m - lo > most:
                lo += most
                ends.append(lo)
            if m > lo:
                ends.append(m)
                lo = m
        out.append(np.array(ends, dtype=np.int64))
    return out


def _encoded(path: str, end_id: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sent = Tokenizer(path, special), set()
        for b in batches:
            for part in tx.slices(b.column(1)):
                ids, n = tok.encode(part)
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id).astype(ids.dtype)
                first = np.concatenate([[0], ends + np.arange(1, len(part) + 1)])
                keys, sizes, new_key, new_n, new_payload = [], [], [], [], []
                for k, e in enumerate(chunk_ends(ids, first)):
                    own, size = [], np.diff(e, prepend=first[k])
                    for x, y in zip((e - size).tolist(), e.tolist(), strict=True):
                        key = xxhash.xxh3_128_digest(payload := ids[x:y].tobytes())
                        own.append(key)
                        if key not in sent:
                            sent.add(key)
                            new_key.append(key)
                            new_n.append(y - x)
                            new_payload.append(payload)
                    keys.append(b"".join(own))
                    sizes.append(size.astype("<i4").tobytes())
                if len(sent) > 500_000:  # later repeats are dropped where they are stored
                    sent.clear()
                pair, m, d = np.frombuffer(b"".join(new_key), dtype="<i8").reshape(-1, 2), len(new_key), len(part)
                doc = b.column(0).slice(int(part.rows[0]), d)
                spread = tx.mix(np.frombuffer(b"".join(k[:8] for k in keys), dtype="<u8") + doc.fill_null(0).to_numpy().astype(tx.U64) * tx.U64(tx.GRAM[0])).view("<i8")
                none = lambda k, t: pa.nulls(k, t)
                both = lambda x, y: pa.concat_arrays([x, y])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([0, 1], [m, d]).astype(np.int32)), both(pa.array(pair[:, 0]), pa.array(spread)), both(pa.array(pair[:, 1]), none(d, pa.int64())),
                        both(pa.array(new_n, pa.int64()), pa.array(n + 1, pa.int64())), both(pa.array(new_payload, pa.binary()), none(d, pa.binary())),
                        both(none(m, pa.int64()), doc.cast(pa.int64())), both(none(m, pa.binary()), pa.array(keys, pa.binary())), both(none(m, pa.binary()), pa.array(sizes, pa.binary())),
                    ],
                    names=["kind", "k0", "k1", "n", "payload", "doc_id", "keys", "sizes"],
                )

    return run


_OBJECT = "kind int, k0 bigint, k1 bigint, n bigint, payload binary, doc_id bigint, keys binary, sizes binary"


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks that this task (all rows of a key come to one) has passed on already."""
    seen = set()
    for b in batches:
        keep = []
        for kind, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            keep.append(kind == 1 or (x, y) not in seen)
            if kind == 0:
                seen.add((x, y))
        yield b.filter(pa.array(keep, pa.bool_()))


_RECIPE = "part int, place bigint, doc_id bigint, start bigint, n_tokens bigint, keys binary, sizes binary"


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one part, sorted: their places and starts within the part."""
    from pyspark import TaskContext

    part, at, docs = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n, m = b.column(1).to_numpy(), b.num_rows
        start = at + np.cumsum(n) - n
        place = np.arange(docs, docs + m)
        at, docs = at + int(n.sum()), docs + m
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, part, np.int32)), pa.array(place), b.column(0), pa.array(start, pa.int64()), *(b.column(k) for k in (1, 2, 3))], names=[x.split()[0] for x in _RECIPE.split(", ")])


def nodes(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, node of every part that has documents, computed from the recipes themselves."""
    about = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("place", "doc_id", "start", "n_tokens")))
    leaf = F.sha2(F.concat(F.encode(about, "utf-8"), F.lit(b"|"), "sizes", F.lit(b"|"), "keys"), 256)
    hashed = lambda by: F.sha2(F.encode(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), ","), "utf-8"), 256)
    leaves = recipes.select("part", "place", "n_tokens", leaf.alias("h"), F.floor(F.col("place") / BLOCK).alias("block"))
    blocks = leaves.groupBy("part", "block").agg(hashed("place").alias("h"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return blocks.groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), hashed("block").alias("node"))


def manifest(recipes: DataFrame) -> list[tuple[int, int, int, str]]:
    """(part, ids before it, documents, node), a row per part, and the root as part -1 with the totals."""
    at, n, rows, root = 0, 0, [], hashlib.sha256()
    for r in nodes(recipes).orderBy("part").collect():  # a row per part
        rows.append((r.part, at, r.n_docs, r.node))
        at, n = at + r.n_tokens, n + r.n_docs
        root.update(r.node.encode())
    return [*rows, (-1, at, n, root.hexdigest())]


def write(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> None:
    """Encodes every text with the tokenizers file at `path`, appends end_id, and writes the store.
    special: texts of special tokens become those tokens, as the library has it unless told otherwise."""
    spark = session(docs)
    parts = parallelism(docs)
    coded = docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(_encoded(path, end_id, special), _OBJECT)
    with freed_shuffles(spark):
        saved(coded.repartition(parts, "k0").mapInArrow(_once, _OBJECT), f"{folder}/objects")
        found = spark.read.schema(_OBJECT).parquet(f"{folder}/objects").where("kind = 1").select("doc_id", "n", "keys", "sizes", F.xxhash64("keys").alias("h"))
        # rows of one id are dealt by what they hold
        found = found.repartitionByRange(max(1, parts // 4), "doc_id", "h").sortWithinPartitions("doc_id", "h", "keys").drop("h")
        saved(found.mapInArrow(_recipes, _RECIPE), f"{folder}/recipes")
        rows = manifest(spark.read.schema(_RECIPE).parquet(f"{folder}/recipes"))
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{folder}/manifest")


_MANIFEST = "part int, base bigint, n_docs bigint, node string"


def _compared(b: pa.RecordBatch) -> pa.RecordBatch:
    """A batch (k0, k1, payload, n), after comparing payloads and keys."""
    key = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, b.column(2).to_pylist())), dtype="<i8").reshape(-1, 2)
    if (key[:, 0] != b.column(0).to_numpy()).any() or (key[:, 1] != b.column(1).to_numpy()).any():
        raise ValueError("a chunk's payload is not what its key says")
    return b


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k0, k1, n, crc) of stored chunks."""
    for b in map(_compared, batches):
        sized = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
        crc = [zlib.crc32(np.frombuffer(p, dtype="<u2" if len(p) == 2 * n else "<u4").astype("<u4").tobytes()) for p, n in sized]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(crc, pa.int64())], names=["k0", "k1", "n", "crc"])


def _references(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, doc_id, start, n_tokens, seq, after, k0, k1) of every chunk of every document; after: ids behind it."""
    for b in batches:
        keys, sizes = b.column(4).to_pylist(), b.column(5).to_pylist()
        n = np.array([len(k) // 16 for k in keys], dtype=np.int64)
        pair = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
        size = np.frombuffer(b"".join(sizes), dtype="<i4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        total = np.concatenate([[0], np.cumsum(size)])
        after = np.repeat(total[first[1:]], n) - total[1:]
        row = np.repeat(np.arange(len(n)), n)
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(4)), pa.array(np.arange(len(row)) - first[row], pa.int64()), pa.array(after), pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["part", "doc_id", "start", "n_tokens", "seq", "after", "k0", "k1"])


def _crc_powers(most: int = 48) -> np.ndarray:
    """[k, bit]: what a CRC-32 with that bit alone becomes when 4 * 2**k zero bytes follow it."""
    step = np.zeros(32, dtype=np.uint32)  # one zero bit
    step[0] = 0xEDB88320
    step[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)
    out = []
    for k in range(5 + most):
        if k >= 5:
            out.append(step)
        step = apply_crc(step, step)
    return np.array(out)


def apply_crc(matrix: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC adds (by exclusive or) to that of a stream which has so many 32-bit ids after it."""
    crc, powers = crc.astype(np.uint32), _crc_powers()
    for k in range(int(after.max()).bit_length() if len(after) else 0):
        on = np.flatnonzero(after >> k & 1)
        crc[on] = apply_crc(powers[k], crc[on])
    return crc


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        crc = b.column(5)
        if crc.null_count:
            raise ValueError("a recipe names a chunk that is not stored")
        add = shifted_crc(crc.to_numpy(), b.column(6).to_numpy())
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(add.astype(np.int64))], names=["part", "doc_id", "start", "n_tokens", "n", "crc"])


def verify_manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(recipes, ids before each part) after computing all nodes and the root from the recipes."""
    recipes = spark.read.schema(_RECIPE).parquet(f"{folder}/recipes")
    said, found = (sorted(map(tuple, x)) for x in (spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect(), manifest(recipes)))
    if said != found:
        raise ValueError("the recipes are not what the manifest's nodes say")
    return recipes, spark.createDataFrame([r[:2] for r in said if r[0] >= 0], "part int, base bigint")  # a row per file


_REFERENCE = "part int, doc_id bigint, start bigint, n_tokens bigint, seq bigint, after bigint, k0 bigint, k1 bigint"


def _chunks_of(spark: SparkSession, folder: str, recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references to chunks, stored chunks)"""
    refs = recipes.select("part", "doc_id", "start", "n_tokens", "keys", "sizes").mapInArrow(_references, _REFERENCE)
    return refs, spark.read.schema(_OBJECT).parquet(f"{folder}/objects").where("kind = 0").select("k0", "k1", "payload", "n")


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    recipes, base = verify_manifest(spark, folder)
    refs, chunks = _chunks_of(spark, folder, recipes)
    chunks = chunks.mapInArrow(_checked, "k0 bigint, k1 bigint, n bigint, crc bigint")
    joined = refs.join(chunks, ["k0", "k1"], "left").select("part", "doc_id", "start", "n_tokens", "n", "crc", "after")
    parts = joined.mapInArrow(_contributions, "part int, doc_id bigint, start bigint, n_tokens bigint, n bigint, crc bigint")
    whole = parts.groupBy("part", "doc_id", "start", "n_tokens").agg(F.sum("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"))
    whole = whole.join(F.broadcast(base), "part")
    n = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("chunks do not add up to the document")).cast("bigint"))
    return whole.select("doc_id", (F.col("base") + F.col("start")).alias("start"), n.alias("n_tokens"), "ids_crc32")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, ids array<int>: every document reconstructed."""
    recipes, base = verify_manifest(spark, folder)
    refs, chunks = _chunks_of(spark, folder, recipes)
    chunks = chunks.mapInArrow(lambda batches: map(_compared, batches), "k0 bigint, k1 bigint, payload binary, n bigint")
    piece = F.sort_array(F.collect_list(F.struct("seq", "n", "payload")))
    whole = refs.join(chunks, ["k0", "k1"], "left").groupBy("part", "doc_id", "start", "n_tokens").agg(piece.alias("c")).join(F.broadcast(base), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for n, c in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if any(x["payload"] is None for x in c):
                    raise ValueError("a recipe names a chunk that is not stored")
                ids.append(np.concatenate([np.frombuffer(x["payload"], dtype="<u2" if len(x["payload"]) == 2 * x["n"] else "<u4").astype(np.int32) for x in c]))
                if len(ids[-1]) != n:
                    raise ValueError("chunks do not add up to the document")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "c").mapInArrow(run, "doc_id bigint, start bigint, ids array<int>")
