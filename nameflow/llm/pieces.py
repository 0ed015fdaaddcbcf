"""SentencePiece encoding and decoding with source offsets.

Text is normalised by the model's compiled character map (longest prefix in its double-array
trie; characters without an entry stay), recording for each normalised byte the source byte it
comes from.  The normalised text is cut where no piece can cross - before a run of space marks and
before a line feed, when the vocabulary allows it - and each distinct segment is encoded once per
task by the sentencepiece library; pieces are projected to spans of source bytes through the
recorded alignment.

Defined results: null and empty text give no ids; repeated rows give repeated rows; columns beyond
the id and text columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

MARK = "▁"


class CharsMap:
    """A compiled character map: u32 size of the trie, its units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        self.units = np.zeros(0, np.uint32)
        self.out = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4)
            self.out = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest key that data[at:] starts with."""
        units, best = self.units, None
        if not len(units):
            return None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = int(units[node])
            if (unit & 0x800000FF) != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit & 0x100 and node < len(units):
                value = int(units[node]) & 0x7FFFFFFF
                best = (k + 1 - at, self.out[value : self.out.index(b"\0", value)])
        return best


def _char_len(b: int) -> int:
    return 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


class Model:
    """A sentencepiece model with what the segment rule needs to know of it."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        pieces = [p.piece for p in proto.pieces]
        plain = [p for p, q in zip(pieces, proto.pieces, strict=True) if q.type == q.NORMAL]
        special = any(q.type == q.USER_DEFINED for q in proto.pieces)
        #: whether segments are independent of each other
        self.cuts = (
            self.prefix and self.escape and not self.squeeze and not len(self.map.units) and not special
            and proto.trainer_spec.byte_fallback and not proto.trainer_spec.treat_whitespace_as_suffix
            and proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and not any(MARK in p.lstrip(MARK) or "\n" in p for p in plain)
        )
        self.mark_id = self.sp.piece_to_id(MARK)
        out = []
        for p, q in zip(pieces, proto.pieces, strict=True):
            if q.type == q.BYTE:
                out.append(bytes([int(p[3:5], 16)]))
            elif q.type in (q.CONTROL,):
                out.append(b"")
            elif q.type == q.UNKNOWN:
                out.append((proto.trainer_spec.unk_surface or " ⁇ ").encode())
            else:
                out.append(p.replace(MARK, " ").encode())
        self.is_byte = np.array([q.type == q.BYTE for q in proto.pieces])
        self.piece_len = np.array([len(x) for x in out], dtype=np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_pool = np.frombuffer(b"".join(out), dtype=np.uint8)
        digits = [b"%d," % i for i in range(len(out))]
        self.digit_len = np.array([len(x) for x in digits], dtype=np.int64)
        self.digit_start = np.cumsum(self.digit_len) - self.digit_len
        self.digit_pool = np.frombuffer(b"".join(digits), dtype=np.uint8)

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, the source byte of each, and one more for the end).  Spaces are
        not yet escaped; the dummy prefix belongs to the source's first byte."""
        if not len(self.map.units):
            return data, np.arange(len(data) + 1)
        out, source, at = bytearray(), [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            used, new = found if found else (_char_len(data[at]), data[at : at + _char_len(data[at])])
            out += new
            source += [at] * len(new)
            at += used
        return bytes(out), np.array([*source, len(data)], dtype=np.int64)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """What the library's decode(ids) gives, in UTF-8; bytes that form no character become
        U+FFFD each, and the first piece's leading space goes."""
        data = tx.gather(self.piece_pool, self.piece_start[ids], self.piece_len[ids]).tobytes()
        if len(ids) and not self.is_byte[ids[0]] and data.startswith(b" ") and self.prefix:
            data = data[1:]
        if self.is_byte[ids].any():
            try:
                data.decode()
            except UnicodeDecodeError:
                return self.sp.decode(ids.tolist()).encode()
        return data


class Encoder:
    """Encodes slices of text; results of segments are kept over a task."""

    def __init__(self, path: str):
        self.m = Model(path)
        self.cache = tx.WordCache(np.int32)

    def _make(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, lead: np.ndarray):
        def made(which):
            texts, plain = [], []
            for i in which.tolist():
                s = data[start[i] : end[i]].tobytes().decode("utf-8", "replace").replace(MARK, " ")
                texts.append(s[1:] if s[:1] == " " and not lead[i] else s)
                plain.append(s[:1] != " " and not lead[i])  # no space before it: the library's dummy prefix goes
            ids = self.m.sp.encode(texts, num_threads=1)
            # the library gives nothing at all for an empty text, and a lone space is one mark
            return [[self.m.mark_id] if not t and not p else x[1:] if p else x for t, x, p in zip(texts, ids, plain, strict=True)]

        return made

    def encode(self, part: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, ids per row)"""
        if not self.m.cuts:
            raw, at = part.data.tobytes(), part.offsets
            texts = [raw[at[i] : at[i + 1]].decode("utf-8", "replace") for i in range(len(part))]
            ids = self.m.sp.encode(texts, num_threads=1)
            n = np.array([len(x) for x in ids], dtype=np.int64)
            return np.array([i for x in ids for i in x], dtype=np.int32), n
        start, end, lead, first = segments(part)
        h = tx.span_hashes(tx._BYTE[part.data], start, end)
        h = np.where(lead, tx.mix(h + tx.U64(1)), h)
        ids, length = self.cache.ragged(self.cache.rows(h, self._make(part.data, start, end, lead)))
        return ids, tx.sums_by(first, length)


def segments(part: tx.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, is a row's first, first segment of each row): cut at row starts, before line
    feeds and before runs of spaces (U+2581 counts as a space)."""
    data, at = part.data, part.offsets
    n = len(data)
    space = data == 0x20
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
    head, tail = space.copy(), space
    if len(mark):
        head[mark] = True
        tail = space.copy()
        tail[mark + 2] = True
    cut = np.zeros(n + 1, dtype=bool)
    cut[:n] = data == 0x0A
    if n:
        cut[1:n] |= head[1:] & ~tail[:-1]
        rows = at[:-1][np.diff(at) > 0]
        cut[rows] = True
    start = np.flatnonzero(cut[:n])
    lead = np.zeros(n + 1, dtype=bool)
    lead[at[:-1][np.diff(at) > 0]] = True
    return start, np.append(start[1:], n), lead[start], np.searchsorted(start, at)


def spans(model: Model, text: str) -> list[tuple[int, int, int]]:
    """(id, first source byte, end) of every piece.  Spans of consecutive pieces tile the text;
    a piece that stands for part of one source character has that character's span."""
    data = text.encode()
    norm, source = model.normalise(data)
    ids = model.sp.encode(text)
    out, at = [], -1 if model.prefix else 0
    for i in ids:
        lo = max(at, 0)
        if model.is_byte[i]:
            at = lo + 1
        else:
            for c in model.sp.id_to_piece(i):
                if c != MARK:
                    at = max(at, 0) + len(c.encode())
                elif at < 0:
                    at = 0  # the dummy prefix
                else:
                    at += 3 if norm[at : at + 3] == MARK.encode() else 1
        out.append((i, int(source[min(lo, len(norm))]), int(source[min(max(at, 0), len(norm))])))
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>, and begins/ends: each piece's span in bytes of the source text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(path)
        for b in batches:
            rows = [spans(m, t or "") for t in b.column(1).to_pylist()]
            cols = [pa.array([[p[k] for p in r] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["id", "ids", "begins", "ends"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>, begins array<int>, ends array<int>")


def row_spans(model: Model, part: tx.Slice, ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Each row's piece ends in source bytes (a piece begins where the one before it ends).  Without
    a character map a piece's bytes are the source's own, the dummy prefix aside; rows with a literal
    U+2581, or of models with a map, go through spans()."""
    length = model.piece_len[ids]
    total = np.concatenate([[0], np.cumsum(length)])
    out = []
    for k in range(len(part)):
        n = int(part.offsets[k + 1] - part.offsets[k])
        own = total[ends[k] + 1 : ends[k + 1] + 1] - total[ends[k]] - model.prefix
        if len(model.map.units) or (len(own) and own[-1] != n):
            text = part.data[part.offsets[k] : part.offsets[k + 1]].tobytes().decode("utf-8", "replace")
            own = np.array([e for _, _, e in spans(model, text)], dtype=np.int64)
        out.append(np.maximum(own, 0))
    return out


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_crc32 (of the pieces' ends in source
    bytes, little-endian 32-bit) per row, and with ids=True token_ids (likewise, binary) and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        m = enc.m
        for b in batches:
            for part in tx.slices(b.column(1)):
                all_ids, n = enc.encode(part)
                digits = tx.gather(m.digit_pool, m.digit_start[all_ids], m.digit_len[all_ids]).tobytes()
                ends = np.concatenate([[0], np.cumsum(n)])
                d_ends = np.concatenate([[0], np.cumsum(m.digit_len[all_ids])])[ends]
                sha, dec, keep, plain = [], [], [], []
                crc = [zlib.crc32(x.astype("<i4").tobytes()) for x in row_spans(m, part, all_ids, ends)]
                for k in range(len(part)):
                    own = all_ids[ends[k] : ends[k + 1]]
                    sha.append(hashlib.sha256(digits[d_ends[k] : max(d_ends[k], d_ends[k + 1] - 1)]).hexdigest())
                    text = m.decode_bytes(own)
                    dec.append(hashlib.sha256(text).hexdigest())
                    if ids:
                        keep.append(own.astype("<i4").tobytes())
                        plain.append(text.decode())
                cols = [b.column(0).slice(int(part.rows[0]), len(part)), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(dec, pa.string()), pa.array(crc, pa.int64())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
                if ids:
                    cols += [pa.array(keep, pa.binary()), pa.array(plain)]
                    names += ["token_ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = ", token_ids binary, decoded string" if ids else ""
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_crc32 bigint{more}")
