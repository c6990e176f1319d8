"""Vectorised text primitives shared by the operators: Arrow buffers in, numpy arrays out.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``; UTF-8 keeps every
byte of a multi-byte character outside that class, so byte runs are exactly the
code-point runs. Hashes are 64-bit and depend on content alone, so every executor
computes the same value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A slice of a batch holds about this many bytes of text (one longer text stays whole).
SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.RandomState(20240607)
_LETTER = _rng.randint(1, 1 << 62, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_pow = {"n": 0, "up": None, "down": None}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i (mod 2**64) for i < n."""
    if _pow["n"] < n:
        size = max(n, 2 * SLICE_BYTES + 64)
        for key, b in (("up", _BASE), ("down", _INV)):
            out = np.ones(size, _U)
            done, step = 1, b
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * _U(step)
                step = step * step % (1 << 64)
                done += take
            _pow[key] = out
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial sum of buf[:i]."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, _U)
    np.cumsum(_LETTER[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each buf[start:end]."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(_U) * _U(0xD1B54A32D192ED03))


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """Order-sensitive hash of aligned columns."""
    out = mix(hashes[0])
    for h in hashes[1:]:
        out = mix(out * _U(0xA0761D6478BD642F) + h)
    return out


class Words:
    """start, end: byte spans; first: index of each document's first word (n + 1 values)."""

    def __init__(self, buf: np.ndarray, off: np.ndarray) -> None:
        full = NONSPACE[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off] = True
        before = np.empty(len(buf), bool)
        if len(buf):
            before[0] = False
            before[1:] = full[:-1]
        before[edge[:-1]] = False
        after = np.empty(len(buf), bool)
        if len(buf):
            after[-1] = False
            after[:-1] = full[1:]
        after[edge[1:]] = False
        self.full = full
        self.start = np.flatnonzero(full & ~before)
        self.end = np.flatnonzero(full & ~after) + 1
        self.first = np.searchsorted(self.start, off)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_array(column: pa.Array) -> pa.Array:
    """The column as large strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, bytes, offsets into them) for runs of rows of about ``limit`` bytes."""
    arr = text_array(column)
    n = len(arr)
    if not n:
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + n + 1]
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags in each [off[i], off[i + 1])."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c)."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = count > 0
    start, count = start[keep], count[keep]
    out[0] = start[0]
    at = np.cumsum(count)[:-1]
    out[at] = start[1:] - (start[:-1] + count[:-1] - 1)
    return np.cumsum(out)


def repeated_keys(keys: np.ndarray) -> np.ndarray:
    """True where the same key is found elsewhere too."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def batches(table: pa.Table | pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if isinstance(table, pa.RecordBatch):
        yield table
    else:
        yield from table.to_batches()
