"""Vectorised word and n-gram keys over the UTF-8 bytes of many texts.

A word is a maximal run of bytes other than space and 0x09-0x0D, the class
``[^\\x20\\x09-\\x0D]+``. All keys are 64 bits: a word's key is the sum of a pseudorandom
value for each byte at its place in the word (so no pattern of bytes, such as those that
defeat polynomials modulo 2**64, makes two words collide), an n-gram's a linear form of
its words' keys, both put through a bijective mixer. Texts are taken a block at a time,
so memory follows the block and not the partition.
"""

from __future__ import annotations

import numpy as np
import zstandard

U64 = np.uint64
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit keys that spreads every input bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _series(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit constants made from a seed."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15)) | U64(1)


SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Values of bytes at the first PLACES places of a word; EXACT keeps the case of A-Z, FOLDED does not.
PLACES = 64
EXACT = _series(1_000, PLACES * 256).reshape(PLACES, 256)
FOLDED = EXACT.copy()
FOLDED[:, 65:91] = EXACT[:, 97:123]
GRAM = _series(9_000, 64)
GRAM_WIDE = _series(19_000, 64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in a byte array."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = SPACE[data]
    edges = np.flatnonzero(np.diff(gap))
    return edges[0::2], edges[1::2]


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """A key for each word; ``table`` is FOLDED to ignore the case of A-Z, EXACT to keep it."""
    out, i, n = np.empty(len(starts), U64), 0, len(starts)
    flat = table.ravel()
    while i < n:
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + CHUNK, "right")))
        high = int(ends[j - 1])
        s, e = starts[i:j] - low, ends[i:j] - low
        # bytes between words have any place and are not summed
        spans = np.diff(np.append(s, high - low))
        place = np.arange(high - low, dtype=np.int64) - np.repeat(s, spans)
        value = flat[(place & (PLACES - 1)) << 8 | data[low:high]]
        far = np.flatnonzero(place >= PLACES)
        if len(far):
            value[far] = mix(value[far] + (place[far] >> 6).astype(U64) * U64(0x9E3779B97F4A7C15))
        sums = np.zeros(high - low + 1, U64)
        np.cumsum(value, out=sums[1:])
        out[i:j] = mix(sums[e] - sums[s] + (e - s).astype(U64))
        i = j
    return out


class Texts:
    """The words of a block of texts: ``key`` and ``doc`` of each word, ``first[d]`` the first word of text d."""

    def __init__(self, texts: list[bytes], table: np.ndarray = FOLDED):
        joined = b"\n".join(texts)
        self.data = np.frombuffer(joined, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=begins[1:])
        self.starts, self.ends = word_spans(self.data)
        self.key = word_keys(self.data, self.starts, self.ends, table)
        self.begins = begins
        self.first = np.searchsorted(self.starts, begins)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int64), self.n_words)

    def grams(self, n: int, factors: np.ndarray = GRAM) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all n consecutive words and whether they lie in one text; aligned with each first word.

        Keys by GRAM and by GRAM_WIDE together have 128 bits.
        """
        m = len(self.key) - n + 1
        if m <= 0:
            return np.empty(0, U64), np.empty(0, bool)
        acc = self.key[:m] * factors[0]
        for k in range(1, n):
            acc += self.key[k : m + k] * factors[k]
        return mix(acc + U64(n)), self.doc[:m] == self.doc[n - 1 :]

    def shingles(self, n: int) -> list[np.ndarray]:
        """Each text's sorted distinct n-word keys; a shorter text counts whole as one, an empty one has none."""
        keys, _ = self.grams(n)
        out = []
        for d in range(len(self.n_words)):
            a, w = int(self.first[d]), int(self.n_words[d])
            if w >= n:
                out.append(np.unique(keys[a : a + w - n + 1]))
            elif w:
                short = (self.key[a : a + w] * GRAM[:w]).sum(dtype=U64)
                out.append(mix(np.array([short + U64(w)], U64)))
            else:
                out.append(np.empty(0, U64))
        return out


_squeeze = zstandard.ZstdCompressor(level=1)
_expand = zstandard.ZstdDecompressor()


def zip_bytes(raw: bytes) -> bytes:
    return _squeeze.compress(raw)


def unzip_bytes(blob: bytes) -> bytes:
    return _expand.decompress(blob)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as compressed byte planes of their gaps."""
    gaps = np.diff(keys, prepend=U64(0))
    return zip_bytes(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unzip_bytes(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def pack_ints(values: np.ndarray) -> bytes:
    """Any integers as compressed byte planes of int64."""
    v = np.ascontiguousarray(values, np.int64)
    return zip_bytes(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_ints(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(unzip_bytes(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()
