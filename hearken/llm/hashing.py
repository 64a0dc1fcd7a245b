"""Word and window hashes of many texts at once, with numpy inside one task.

Texts are laid into one byte buffer. A word is a run of bytes whose class is not
"separator"; bytes from 0x80 up belong to multi-byte characters and are never
separators, so byte runs and character runs agree. A word's hash is a polynomial
over its bytes modulo 2**64 (differences of prefix sums), a window's hash a
polynomial over its word hashes; both pass a finalizer, so equal sequences have
equal hashes and others differ but for a chance of about 2**-64 for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at once; a longer single text is hashed alone.
CHUNK_BYTES = 1 << 18

_B = np.uint64(0x9E3779B97F4A7C15)
_C = np.uint64(0xC2B2AE3D27D4EB4F)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte classes: true where a byte of one of the closed ranges stands between words."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are what is left between ASCII white space.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
PUNCTUATION = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lower_ascii(data: bytes) -> bytes:
    return data.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown to the longest buffer seen."""

    def __init__(self) -> None:
        self.base = self.inverse = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n <= len(self.base):
            return
        size = 1 << (n - 1).bit_length()

        def powers(b: np.uint64) -> np.ndarray:
            out = np.full(size, b, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.base, self.inverse = powers(_B), powers(_INV)


_POWERS = _Powers()


def words(data: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte offsets of the words of one buffer."""
    gap = separator[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1 if len(gap) else np.zeros(0, np.int64)
    if len(gap) and not gap[0]:
        edge = np.concatenate(([0], edge))
    if len(gap) and not gap[-1]:
        edge = np.concatenate((edge, [len(gap)]))
    return edge[0::2], edge[1::2]


def word_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    _POWERS.upto(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    values = _RANDOM[np.frombuffer(data, np.uint8)]
    values *= _POWERS.base[:n]
    np.cumsum(values, out=sums[1:])
    return mix((sums[end] - sums[start]) * _POWERS.inverse[start])


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, size):
        total *= _C
        total += hashes[k : k + n]
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """Hash of one whole sequence, whatever its length; equal to its own window's hash."""
    return window_hashes(hashes, len(hashes))[0]


def set_digest(values: np.ndarray) -> bytes:
    """128-bit digest of a set of hashes, independent of their order."""
    if not len(values):
        return bytes(16)
    a = np.add.reduce(mix(values ^ _B))
    b = np.add.reduce(mix(values ^ _C))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def hashed_texts(
    texts: list[bytes | None], separator: np.ndarray, lower: bool
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """For each text in order: its index, its offset in the buffer, word starts, ends
    and hashes (starts and ends in the buffer), and the buffer.

    Texts are joined by a separator byte so that one pass hashes many; null counts as empty.
    """
    first, size, group = 0, 0, []
    for i, text in enumerate(texts):
        text = text or b""
        if group and size + len(text) > CHUNK_BYTES:
            yield from _hash_group(first, group, separator, lower)
            first, size, group = i, 0, []
        group.append(text)
        size += len(text) + 1
    if group:
        yield from _hash_group(first, group, separator, lower)


def _hash_group(first: int, group: list[bytes], separator: np.ndarray, lower: bool):
    data = b" ".join(group)
    data = lower_ascii(data) if lower else data
    start, end = words(data, separator)
    hashes = word_hashes(data, start, end)
    offsets = np.cumsum([0, *(len(x) + 1 for x in group)])
    cut = np.searchsorted(start, offsets)
    for k in range(len(group)):
        s = slice(cut[k], cut[k + 1])
        yield first + k, int(offsets[k]), start[s], end[s], hashes[s], data
