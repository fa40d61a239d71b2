"""Words and shingles of whole batches of texts as 64-bit hashes, in NumPy over the UTF-8 bytes.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r, with A-Z lower-cased. Both rules touch ASCII
only, so working on bytes equals working on characters. A word is hashed eight bytes at a time, each step a bijection
of the state, so words of up to eight bytes and one length never share a hash and longer ones do with a chance of
2**-64 a pair, whatever their structure; words of over ``LONG`` bytes go through BLAKE2. Two seeds make 128 bits.
Bounds are found in windows, so that the memory beside the text is a few bytes for each of its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_MUL = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Masks that keep the first k bytes of eight.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_EACH = np.uint64(0x0101010101010101)
WINDOW = 1 << 20
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (n + 1 offsets); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def sort_segments(keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Sort keys within segments, in place; segments of one size are sorted together."""
    by = np.argsort(size, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(size[by])) + 1).tolist(), len(by)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = int(size[by[a]]) if a < b else 0
        if n < 2:
            continue
        if b - a == 1:
            at = int(begin[by[a]])
            keys[at : at + n].sort()
            continue
        at = begin[by[a:b], None] + np.arange(n)
        part = keys[at]
        part.sort(axis=1)
        keys[at] = part


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end (exclusive); none crosses a segment's start."""
    edges = []
    last = False
    for a in range(0, len(data), WINDOW):
        part = data[a : a + WINDOW]
        inside = np.empty(len(part) + 1, dtype=bool)
        inside[0] = last
        np.greater((part - np.uint8(9)), 4, out=inside[1:])
        inside[1:] &= part != 32
        edges.append(np.flatnonzero(inside[1:] != inside[:-1]) + a)
        last = bool(inside[-1])
    at = np.concatenate([*edges, [len(data)] if last else []]).astype(np.int64)
    start, stop = at[::2], at[1::2]
    cuts = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    cuts = cuts[~_GAP[data[cuts]] & ~_GAP[data[cuts - 1]]] if len(cuts) else cuts
    if len(cuts):
        start, stop = np.insert(start, np.searchsorted(start, cuts), cuts), np.insert(stop, np.searchsorted(stop, cuts), cuts)
    return start, stop


def _lower(v: np.ndarray) -> np.ndarray:
    """A-Z to a-z in each of eight bytes."""
    low = v & (_EACH * np.uint64(0x7F))
    upper = (low + _EACH * np.uint64(0x3F)) & ~(low + _EACH * np.uint64(0x25)) & ~v & (_EACH * np.uint64(0x80))
    return v | (upper >> np.uint64(2))


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seeds: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """Hashes of the words at the given bounds, one array for each seed."""
    if not len(start):
        return [np.empty(0, np.uint64) for _ in seeds]
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = stop - start
    first = _lower(eight[start] & _KEEP[np.minimum(size, 8)])
    out = [mix((first ^ np.uint64(_MUL[4] * np.uint64(s))) + size.astype(np.uint64) * _MUL[0]) for s in seeds]
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        v = _lower(eight[start[more] + k] & _KEEP[np.minimum(size[more] - k, 8)])
        for h in out:
            h[more] = mix((h[more] ^ v) * _MUL[1])
        k += 8
        more = more[size[more] > k]
    for i in more.tolist():
        word = data[start[i] : stop[i]]
        word = (word + ((word >= 65) & (word <= 90)).astype(np.uint8) * np.uint8(32)).tobytes()
        for h, s in zip(out, seeds, strict=True):
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=bytes([s])).digest(), "little")
    return out


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each segment the index of its first word (n + 1 offsets)."""
    start, stop = bounds(data, offsets)
    return word_hashes(data, start, stop)[0], np.searchsorted(start, offsets)


def shingles(h: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each segment's shingles of ``width`` words in order (repeats stay), and their offsets.

    A segment with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    mul = _MUL if width == 5 else mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.diff(offsets)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_off[-1], dtype=np.uint64)
    full = counts >= width
    if len(h) >= width:
        m = len(h) - width + 1
        g = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            g += h[k : k + m] * mul[k]
        g = mix(g)
        if full.any():
            reps = made[full]
            first = np.repeat(offsets[:-1][full] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps)
            src = first + np.arange(reps.sum())
            dst = np.repeat(out_off[:-1][full] - np.concatenate([[0], np.cumsum(reps)[:-1]]), reps) + np.arange(reps.sum())
            out[dst] = g[src]
    for i in np.flatnonzero((counts > 0) & ~full):
        w = h[offsets[i] : offsets[i + 1]]
        out[out_off[i]] = mix((w * mul[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.array([len(w)], dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[0]
    return out, out_off


def shingle_sets(texts: pa.Array, width: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct shingles as 128 bits: 64 in ascending order, and the other 64 beside them.

    Large batches are cut so that memory follows single texts.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    data, offsets = raw(texts)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, side="right")) - 1)
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, stop = bounds(part, off)
        places = np.searchsorted(start, off)
        (g, g_off), (other, _) = (shingles(h, places, width) for h in word_hashes(part, start, stop, (0, 1)))
        for k in range(j - i):
            a, b = g[g_off[k] : g_off[k + 1]], other[g_off[k] : g_off[k + 1]]
            by = np.argsort(a)
            a, b = a[by], b[by]
            new = np.ones(len(a), dtype=bool)
            new[1:] = a[1:] != a[:-1]
            out.append((a[new], b[new]))
        i = j
    return out


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many shingles two sets share, by all 128 bits."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    if not len(x[0]):
        return 0
    at = np.minimum(np.searchsorted(y[0], x[0]), len(y[0]) - 1)
    return int(((y[0][at] == x[0]) & (y[1][at] == x[1])).sum())
