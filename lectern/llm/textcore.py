"""Vectorised tokenising and hashing of Arrow text columns.

A word's 64-bit hash is a polynomial over its bytes modulo 2^64, taken for all words of a buffer at once from one
prefix sum. Only A-Z are folded. Buffers are cut into chunks at word borders, so memory does not grow with a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
CHUNK = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled = 1
    with np.errstate(over="ignore"):
        step = base
        while filled < n:
            k = min(filled, n - filled)
            out[filled : filled + k] = out[:k] * step
            step = step * step
            filled += k
    return out


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = CHUNK
    while size < n:
        size *= 2
    if size not in _TABLES:
        _TABLES[size] = _powers(_P, size), _powers(_PINV, size)
    return _TABLES[size]


def _separators(text: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(text)] = False
    return table


#: True where a byte belongs to a word.
SPACE = _separators(b" \t\n\x0b\x0c\r")
ALNUM = _separators(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
ALNUM[ord("A") : ord("Z") + 1] = True  # folded to a-z before the pattern applies
LINE = _separators(b"\n")

_FOLDED = _VALUES.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # over 2 GB in one column
        column = column.cast(pa.large_string()).combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of words in data[lo:hi]; a text's border ends a word."""
    word = is_word[data[lo:hi]]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
    before[inner] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts + lo, ends + lo


def _cuts(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n and is_word[data[hi]] and is_word[data[hi - 1]]:
            stop = offsets[np.searchsorted(offsets, hi, "left")]  # a border at or after hi
            if stop == hi:
                break
            gap = np.flatnonzero(~is_word[data[hi : min(n, hi + 4096)]])
            hi = int(min(stop, hi + gap[0] if len(gap) else min(n, hi + 4096)))
        yield lo, hi
        lo = hi


def tokenize(column, is_word: np.ndarray, folded: bool = True, places: bool = False, prefixes: tuple[int, ...] = ()):
    """Hashes of all words of a column and, for each text, where its words begin; with places also byte starts, ends.

    prefixes: byte lengths; the first array then has a row for words and one for each length, 0 where a word is no longer.
    """
    data, offsets = buffers(column)
    values = _FOLDED if folded else _VALUES
    hashes, at, to = [], [], []
    for lo, hi in _cuts(data, offsets, is_word):
        starts, ends = spans(data, offsets, is_word, lo, hi)
        power, inverse = _tables(hi - lo)
        with np.errstate(over="ignore"):
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[data[lo:hi]] * power[: hi - lo], out=total[1:])
            rows = [mix((total[ends - lo] - total[starts - lo]) * inverse[starts - lo])]
            for size in prefixes:
                short = mix((total[np.minimum(ends, starts + size) - lo] - total[starts - lo]) * inverse[starts - lo] + np.uint64(size))
                rows.append(np.where(ends - starts > size, short, np.uint64(0)))
            hashes.append(np.stack(rows) if prefixes else rows[0])
        at.append(starts)
        to.append(ends)
    empty = np.zeros(0, np.int64)
    starts = np.concatenate(at) if at else empty
    none = np.zeros((1 + len(prefixes), 0) if prefixes else 0, np.uint64)
    out = (np.concatenate(hashes, axis=-1) if hashes else none), np.searchsorted(starts, offsets, "left")
    return (*out, starts, np.concatenate(to) if to else empty, data, offsets) if places else out


def word_hash(text: str, is_word: np.ndarray) -> list[int]:
    """Hashes of the words of one text."""
    return tokenize(pa.array([text]), is_word)[0].tolist()


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
            out ^= out >> np.uint64(29)
        return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text that is not empty has one, its whole sequence."""
    if len(hashes) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(shingles(hashes, min(k, len(hashes))))
