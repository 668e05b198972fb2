"""Words of whole texts and their hashes, computed on byte arrays."""

from __future__ import annotations

import numpy as np

#: A-Z becomes a-z; 0-9, a-z and every byte of a non-ASCII character belong to words
_BYTES = np.arange(256)
FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
BASE = 0x9E3779B97F4A7C15  # odd, so that powers can be undone modulo 2**64
CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
KEPT_POWERS = 1 << 20
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; up to ``KEPT_POWERS`` of them are kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base % 2**64, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of several texts laid one after another: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.folded = FOLD[np.frombuffer(b"\n".join([*raw, b""]) or b"\n", dtype=np.uint8)]
        inside = IN_WORD[self.folded]
        edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edges[0::2], edges[1::2]
        text_end = np.cumsum([len(r) + 1 for r in raw])
        self.bounds = np.append(0, np.searchsorted(self.start, text_end)).astype(np.int64)
        n = len(self.folded)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[self.folded] * powers(BASE, n), dtype=np.uint64, out=total[1:])
        undo = powers(pow(BASE, -1, 2**64), n)
        spread = total[self.end] - total[self.start]
        del total
        self.hash = mix(spread * undo[self.start])

    def __len__(self) -> int:
        return len(self.start)

    def text(self, first: int, last: int) -> str:
        """Words ``first`` to ``last`` (exclusive) joined by single spaces."""
        data = self.folded
        return " ".join(bytes(data[self.start[i] : self.end[i]]).decode("utf-8", "replace") for i in range(first, last))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words from each word on, and whether those words lie in one text."""
        n = len(self.hash)
        whole = np.zeros(n, dtype=bool)
        value = np.zeros(n, dtype=np.uint64)
        if n >= size:
            m = n - size + 1
            acc = np.zeros(m, dtype=np.uint64)
            for k in range(size):
                acc = acc * np.uint64(BASE) + self.hash[k : k + m]
            value[:m] = mix(acc + np.uint64(size))
            owner = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
            whole[:m] = owner[:m] == owner[size - 1 :]
        return value, whole
