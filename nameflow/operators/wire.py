"""Headers and plain DNS messages in NumPy, over the bytes of many packets at once.

dns_frames() applies the rules of frames.dns_messages() to frames that lie in one buffer; decode_batch() those of
decode.decode() to messages.  Messages of one question with a plain name (labels of letters, digits, _ and inner -, no
pointer) and, in responses, no additional records are decoded here; the others go through decode.decode() one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..schemas import DNS_PORT
from . import decode as one
from .frames import ETHERNET, UDP

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_FIRST = np.isin(np.arange(256), np.frombuffer(_LETTERS + _LETTERS.upper() + b"0123456789_", np.uint8))
_REST = _FIRST | (np.arange(256) == ord("-"))
#: Labels that a name of 255 bytes can have.
MAX_LABELS = 127


def u16(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    return buf[at].astype(np.int32) << 8 | buf[at + 1]


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of a binary column; nulls are empty."""
    array = array.cast(pa.binary())
    offsets = np.frombuffer(array.buffers()[1] or b"\0\0\0\0", np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    held = array.buffers()[2]
    buf = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return buf if len(buf) else np.zeros(1, np.uint8), offsets[:-1] - offsets[0], np.diff(offsets)


def cut(buf: np.ndarray, start: np.ndarray, size: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The parts of a buffer as a binary or string column."""
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    data = buf[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
    return pa.Array.from_buffers(kind, len(start), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def dns_frames(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> dict[str, np.ndarray | pa.Array]:
    """Of frames that carry DNS: their row, is_response, client_ip, client_port, resolver_ip, first byte and length of the message."""
    row = np.flatnonzero(size > ETHERNET)
    s, n = start[row], size[row] - ETHERNET
    kind, first = u16(buf, s + 12), buf[s + ETHERNET].astype(np.int32)
    v4, v6 = (kind == 0x0800) & (first >> 4 == 4), (kind == 0x86DD) & (first >> 4 == 6)
    head = np.where(v4, (first & 15) * 4, 40)
    ok = (v4 | v6) & (head >= np.where(v4, 20, 40)) & (head <= n)
    row, s, n, v4, head = row[ok], s[ok], n[ok], v4[ok], head[ok]
    ip = s + ETHERNET
    length = np.where(v4, u16(buf, ip + 2), u16(buf, ip + 4) + 40)
    ok = buf[ip + np.where(v4, 9, 6)] == UDP
    ok &= ~v4 | (u16(buf, ip + 6) & 0x3FFF == 0)
    ok &= (length >= head + 8) & (length <= n)
    row, ip, v4, head, payload = row[ok], ip[ok], v4[ok], head[ok], (length - head)[ok]
    at = ip + head
    sp, dp, udp = u16(buf, at), u16(buf, at + 2), u16(buf, at + 4)
    ok = ((sp == DNS_PORT) | (dp == DNS_PORT)) & (udp >= 8 + 12) & (udp <= payload)
    row, ip, v4, at, sp, dp, udp = row[ok], ip[ok], v4[ok], at[ok], sp[ok], dp[ok], udp[ok]
    response = sp == DNS_PORT
    width = np.where(v4, 4, 16)
    source, target = ip + np.where(v4, 12, 8), ip + np.where(v4, 16, 24)
    return {
        "row": row,
        "is_response": response,
        "client_ip": cut(buf, np.where(response, target, source), width, pa.binary()),
        "client_port": np.where(response, dp, sp).astype(np.int32),
        "resolver_ip": cut(buf, np.where(response, source, target), width, pa.binary()),
        "start": at + 8,
        "size": (udp - 8).astype(np.int64),
    }


def _plain(buf: np.ndarray, start: np.ndarray, size: np.ndarray, response: np.ndarray):
    """(which messages are plain, their names as text, places behind their names)"""
    row = np.flatnonzero(size >= 12)
    m = start[row]
    good = (u16(buf, m + 4) == 1) & (~response[row] | (u16(buf, m + 10) == 0))
    row = row[good]
    begin, end = start[row] + 12, start[row] + size[row]
    shown, fine = buf.copy(), _REST[buf]
    at, left, behind = begin.copy(), np.arange(len(row)), np.zeros(len(row), np.int64)
    for k in range(MAX_LABELS + 1):
        left = left[at[left] < end[left]]
        place = at[left]
        n = buf[place].astype(np.int64)
        last = n == 0
        if k:  # the root is left to the general decoder
            behind[left[last]] = place[last] + 1
        more = ~last & (n < 64) & (place + 1 + n < end[left])
        left, place, n = left[more], place[more], n[more]
        starts_well = _FIRST[buf[place + 1]]
        left, place, n = left[starts_well], place[starts_well], n[starts_well]
        if not len(left):
            break
        if k:
            shown[place], fine[place] = ord("."), True
        at[left] = place + 1 + n
    bad = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~fine, out=bad[1:])
    stop = np.maximum(behind - 1, begin)
    good = (behind > 0) & (behind - begin <= one.MAX_NAME) & (behind + 4 <= end) & (bad[stop] == bad[np.minimum(begin + 1, len(buf))])
    row, begin, behind = row[good], begin[good], behind[good]
    return row, cut(shown, begin + 1, behind - begin - 2, pa.string()), behind


def decode_batch(buf: np.ndarray, start: np.ndarray, size: np.ndarray, response: np.ndarray, names: dict) -> list[pa.Array]:
    """outcome, id, questions, rcode and rcode_ctx of messages in one buffer, in their order."""
    count = len(start)
    plain, text, behind = _plain(buf, start, size, response)
    ident, code, asked = np.zeros(count, np.int32), np.zeros(count, np.int32), np.zeros(count, np.int64)
    outcome, context = np.full(count, one.RECORDS, object), np.full(count, "Header", object)
    ident[plain], code[plain], asked[plain] = u16(buf, start[plain]), u16(buf, start[plain] + 2) & 15, 1
    kinds = u16(buf, behind)
    rest = np.ones(count, bool)
    rest[plain] = False
    rest = np.flatnonzero(rest)
    owner, more_names, more_kinds = [plain], [], []
    for k in rest.tolist():
        try:
            ident[k], found, code[k], context[k] = one.decode(buf[start[k] : start[k] + size[k]].tobytes(), bool(response[k]), names)
        except one.Oversized:
            outcome[k] = one.OVERSIZED
        except one.Malformed:
            outcome[k] = one.INVALID
        else:
            asked[k] = len(found)
            owner.append(np.full(len(found), k))
            more_names += [n for n, _ in found]
            more_kinds += [t for _, t in found]
    if more_names:
        order = np.argsort(np.concatenate(owner), kind="stable")
        text = pa.concat_arrays([text, pa.array(more_names, pa.string())]).take(pa.array(order))
        kinds = np.concatenate([kinds, np.array(more_kinds, np.int32)])[order]
    void = outcome != one.RECORDS
    offsets = np.zeros(count + 1, np.int32)
    np.cumsum(asked, out=offsets[1:])
    values = pa.StructArray.from_arrays([text, pa.array(kinds, pa.int32())], names=["name", "qtype"])
    questions = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(void))
    unanswered = void | ~response
    return [
        pa.array(outcome, pa.string()), pa.array(ident, mask=void), questions, pa.array(code, mask=unanswered),
        pa.array(context, pa.string(), mask=unanswered),
    ]
