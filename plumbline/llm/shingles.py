"""Word shingles as sets of 64-bit hashes, for a list of texts at a time, with numpy.

Words are what stands between the blanks 0x20 and 0x09-0x0D after A-Z are lower-cased. A shingle is `width` words in a
row; a text of fewer words is one shingle, a text without words has none. A word of up to 16 bytes is hashed as two
64-bit numbers through keyed bijections (no two words of up to 8 bytes and one length collide), a longer one by keyed
BLAKE2b; two given shingles have one hash with a probability of about 2**-64.
"""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight
_KEY = b"plumbline.llm.shingles"
_K0, _K1, _K2 = (U(int.from_bytes(hashlib.blake2b(_KEY, digest_size=8, salt=bytes([i])).digest(), "little") | 1) for i in range(3))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose output bits depend on all input bits."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of each text's first word, one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join(raw) + b" " * 17, np.uint8)
    blank = _BLANK[buf]
    before = np.concatenate(([True], blank[:-1]))
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    size = end - start
    low = _LOWER[buf]
    eight = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))  # the eight bytes from each place on
    first = eight[start] & _KEEP[np.minimum(size, 8)]
    second = eight[start + 8] & _KEEP[np.clip(size - 8, 0, 8)]
    h = mix(mix(first ^ _K0) + second * _K1 + size.astype(np.uint64) * _K2)
    for i in np.flatnonzero(size > 16):
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : end[i]].tobytes(), digest_size=8, key=_KEY).digest(), "little")
    heads = np.cumsum([0] + [len(r) + 1 for r in raw])
    return h, np.searchsorted(start, heads)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The set of each text, ascending."""
    h, first = word_hashes(texts)
    n = len(h) - width + 1
    rows = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        if n > 0:
            rows += h[k : k + n] * U((0xA0761D6478BD642F * (2 * k + 3) | 1) & (2**64 - 1))
    rows = mix(rows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rows[a : b - width + 1]))
        elif b > a:
            x = U(b - a)
            for w in h[a:b]:
                with np.errstate(over="ignore"):
                    x = mix(np.array([x * U(0xE7037ED1A0B428DB) + w]))[0]
            out.append(np.array([x]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        a = mix(np.array([s.sum(dtype=np.uint64) + U(len(s))]))
        b = mix(mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=np.uint64).reshape(1))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def odd_sketch(s: np.ndarray, bits: int = 9) -> np.ndarray:
    """2**bits parities, 64 to a number: two sketches differ in no more bits than their sets in elements."""
    at = (s >> U(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=1 << bits) & 1).astype(np.uint8)).view(np.int64)
