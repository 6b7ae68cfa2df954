"""Words and hashes of whole Arrow text batches as numpy arrays.

A batch is cut into chunks of at most CHUNK bytes between rows (a longer row is a chunk of its own), so
memory follows the longest single text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240611))
#: A random 64-bit value for each byte; A-Z have those of a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, CHUNK) + 1
        up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"], _powers["down"]


def chunks(texts: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows and the end within the bytes); null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of the chunk; a word never crosses rows."""
    if not len(buf):
        return (np.empty(0, np.int64),) * 3
    full = ~SPACE[buf]
    before, after = np.empty_like(full), np.empty_like(full)
    before[0] = after[-1] = False
    before[1:], after[:-1] = full[:-1], full[1:]
    first, last = offsets[:-1], offsets[1:] - 1
    before[first[first < len(buf)]] = False
    after[last[last >= 0]] = False
    starts = np.flatnonzero(full & ~before)
    return starts, np.flatnonzero(full & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def spans_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, with A-Z taken as a-z."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `width` words; a row with fewer words gives its whole sequence as one."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = PLACE[np.arange(width) % 8] + np.arange(width, dtype=np.uint64)
    out_h, out_r = [], []
    if n >= width:
        whole = rows[: n - width + 1] == rows[width - 1 :]
        total = hashes[: n - width + 1] * place[0]
        for j in range(1, width):
            total = total + hashes[j : n - width + 1 + j] * place[j]
        out_h.append(mix(total[whole] + np.uint64(width)))
        out_r.append(rows[: n - width + 1][whole])
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    few = count < width
    if few.any():
        total = np.zeros(few.sum(), np.uint64)
        for j in range(width - 1):
            has = count[few] > j
            total[has] += hashes[first[few][has] + j] * place[j]
        out_h.append(mix(total + count[few].astype(np.uint64)))
        out_r.append(rows[first[few]])
    h, r = np.concatenate(out_h), np.concatenate(out_r)
    if few.any():
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r
