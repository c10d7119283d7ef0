"""NumPy kernels over the buffers of Arrow string columns.

Nulls count as empty texts everywhere. Keys that decide anything have 128 bits: spans of bytes
have their XXH3 digest, and windows of a fixed number of digests are joined pair by pair, twice as
wide at each step, by a function that is scrambled at every step. Nothing in a key is linear, so
that no family of texts (Thue-Morse words, say) collides by algebra.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are handled in slices of about this many bytes, which keeps their arrays in cache; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the n + 1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    body = np.frombuffer(data, dtype=np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - lo


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts (first, last + 1) that hold about ``most`` bytes each."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets) for each slice of the column; offsets start at 0."""
    body, offsets = text_buffers(column)
    for first, last in slices(offsets, most):
        lo, hi = offsets[first], offsets[last]
        yield first, last, body[lo:hi], offsets[first : last + 1] - lo


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the n + 1 word offsets of the texts."""
    n = len(body)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[body]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


_ROOT = np.uint64(0x243F6A8885A308D3)


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One value of two, not alike for (b, a); one to one in each of them while the other is fixed."""
    h = a ^ (a >> np.uint64(32))
    h *= np.uint64(0x9FB21C651E98DF25)
    h += b
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def window_keys(values: np.ndarray, width: int) -> np.ndarray:
    """Key of each run of ``width`` 64-bit values: of two halves, which may overlap."""
    n = max(len(values) - width + 1, 0)
    out, have = values, 1
    while 2 * have <= width and n:
        out = joined(out[: len(out) - have], out[have:])
        have *= 2
    if have < width and n:
        out = joined(out[:n], out[width - have : width - have + n])
    return out[:n]


def byte_windows(body: np.ndarray, width: int) -> np.ndarray:
    """Key of each run of ``width`` bytes; ``width`` is 8 times a power of two."""
    n = max(len(body) - width + 1, 0)
    if not n:
        return np.zeros(0, np.uint64)
    raw, eights = body.tobytes(), np.empty(len(body) - 7, np.uint64)
    for k in range(8):
        own = eights[k::8]
        own[:] = np.frombuffer(raw, "<u8", len(own), k)
    out, have = mix(eights), 8
    while have < width:
        out = joined(out[: len(out) - have], out[have:])
        have *= 2
    return out


def _eight(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view("<u8").reshape(-1)


def span_digests(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, as two values, of each span of bytes.

    Up to 16 bytes these are two scrambled forms of (first eight bytes, last eight bytes, length),
    which tell any two such spans apart; longer spans have their XXH3 digest.
    """
    padded = np.concatenate([body, np.zeros(16, np.uint8)])
    length = ends - starts
    first = _eight(padded, starts)
    room = np.where(length < 8, (8 - length) * 8, 0).astype(np.uint64)  # bits after a short span
    first = np.where(length > 0, (first << room) >> room, 0).astype(np.uint64)
    last = np.where(length > 8, _eight(padded, np.maximum(ends - 8, 0)), 0).astype(np.uint64)
    size = length.astype(np.uint64)
    one, two = joined(joined(first, last), size), joined(joined(size + _ROOT, last), mix(first + _ROOT))
    long = np.flatnonzero(length > 16)
    if len(long):
        raw, digest = body.tobytes(), xxhash.xxh3_128_digest
        keys = np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), "<u8").reshape(-1, 2)
        one[long], two[long] = keys[:, 0], keys[:, 1]
    return one, two


#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return h << np.uint64(by) | h >> np.uint64(64 - by)


def xxh64(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span: all spans below 32 bytes step by step together, longer ones by the library."""
    padded, length = np.concatenate([body, np.zeros(8, np.uint8)]), ends - starts
    h = np.full(len(starts), seed, np.uint64) + _P5 + length.astype(np.uint64)
    at = starts.copy()
    for _ in range(3):
        more = ends - at >= 8
        h = np.where(more, _rotated(h ^ _rotated(_eight(padded, at) * _P2, 31) * _P1, 27) * _P1 + _P4, h)
        at += more * 8
    more = ends - at >= 4
    h = np.where(more, _rotated(h ^ (_eight(padded, at) & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3, h)
    at += more * 4
    for _ in range(3):
        more = ends > at
        h = np.where(more, _rotated(h ^ padded[at].astype(np.uint64) * _P5, 11) * _P1, h)
        at += more
    for by, factor in ((33, _P2), (29, _P3)):
        h ^= h >> np.uint64(by)
        h *= factor
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(length >= 32)
    if len(long):
        raw, digest = body.tobytes(), xxhash.xxh64_intdigest
        h[long] = np.fromiter((digest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), np.uint64, len(long))
    return h


#: For each byte, a 64-bit number with its bits in eight bytes, the highest bit in the lowest byte.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view("<u8").reshape(-1)


def majority_bits(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For runs of ``count`` values each, the bits that over half of a run have set; zero for an empty run."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if not len(some):
        return out
    n = count[some]
    pieces = -(-n // 255)  # sums of up to 255 ones fit in a byte
    first = np.cumsum(n) - n
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + piece * 255
    owner = np.cumsum(pieces) - pieces
    for byte in range(8):
        sums = np.add.reduceat(_SPREAD[(h >> np.uint64(8 * byte)) & np.uint64(255)], begin)
        ones = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), owner, axis=0, dtype=np.int64)
        out[some] |= np.packbits(2 * ones > n[:, None], axis=1).reshape(-1).astype(np.uint64) << np.uint64(8 * byte)
    return out


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value (by its upper 32 bits) of each window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(values) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.bitwise_or(values & np.uint64(0xFFFFFFFF00000000), np.arange(len(values), dtype=np.uint64), out=full[: len(values)])
    rows = full.reshape(blocks, width)
    head = np.minimum.accumulate(rows, axis=1).reshape(-1)
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
