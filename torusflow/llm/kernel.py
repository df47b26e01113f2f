"""Vectorised text kernels shared by the operators of this package.

Arrow string columns are read as one UTF-8 byte buffer; n-grams and words are hashed
with array arithmetic, one document at a time, so memory is bounded by one Arrow batch
plus a few arrays as long as the longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd, so it has an inverse modulo 2**64; base of the polynomial word hash.
BASE = np.uint64(0x9E3779B97F4A7C15)
INV = np.uint64(pow(int(BASE), -1, 1 << 64))
GOLD = np.uint32(2654435761)

#: ASCII letters and digits and every byte of a multi-byte character belong to words.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: Bytes of a document that are hashed at a time.
PART = 1 << 21

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 24:  # longer documents pay for their own table
            _powers[name] = have
    return have[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), at


def documents(column):
    """The bytes of each row."""
    data, at = utf8(column)
    for i in range(len(at) - 1):
        yield data[at[i] : at[i + 1]]


def lowered(column):
    """The bytes of each row in lower case."""
    return documents(pc.utf8_lower(column))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(doc: np.ndarray, heads: tuple[int, ...] = ()) -> np.ndarray:
    """A 64-bit hash of each word, in order. A word is a maximal run of WORD bytes.

    heads: also a hash of the first so many bytes of each longer word, in no stated order.
    Long documents are cut between words, so working memory is that of PART bytes.
    """
    if len(doc) <= PART:
        return _words(doc, heads)
    out, at = [], 0
    while at < len(doc):
        end = at + PART
        while end < len(doc):
            gap = np.flatnonzero(~WORD[doc[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        out.append(_words(doc[at:end], heads))
        at = end
    return np.concatenate(out)


def _words(doc: np.ndarray, heads: tuple[int, ...]) -> np.ndarray:
    if not len(doc):
        return np.zeros(0, np.uint64)
    inside = np.empty(len(doc) + 2, bool)
    inside[0] = inside[-1] = False
    np.take(WORD, doc, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum((doc.astype(np.uint64) + np.uint64(1)) * _power(BASE, len(doc), "base"), out=sums[1:])
    back = _power(INV, len(doc), "inv")
    found = [mix((sums[end] - sums[start]) * back[start])]
    for n in heads:
        at = start[end - start > n]
        found.append(mix((sums[at + n] - sums[at]) * back[at] + np.uint64(n)))
    return found[0] if len(found) == 1 else np.concatenate(found)


def shingles(hashed: np.ndarray, k: int = 5) -> np.ndarray:
    """A hash of every k consecutive words; of all words if there are fewer, none if none."""
    n = len(hashed)
    if n == 0:
        return hashed
    k = min(k, n)
    total = hashed[: n - k + 1].copy()
    for j in range(1, k):
        total *= BASE
        total += hashed[j : n - k + 1 + j]
    return mix(total + np.uint64(k))


def grams(doc: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Each n-gram of bytes (n up to 4) hashed to so many bits; short documents are padded with blanks."""
    if len(doc) < n:
        doc = np.concatenate([doc, np.full(n - len(doc), 32, np.uint8)])
    wide = doc.astype(np.uint32)
    m = len(wide) - n + 1
    code = wide[:m].copy()
    for j in range(1, n):
        code |= wide[j : m + j] << np.uint32(8 * j)
    code += np.uint32(n)
    code *= GOLD
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x85EBCA6B)
    return code >> np.uint32(32 - bits)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))
