"""Content-defined chunking with a gear hash, over many texts at once in numpy.

The hash of a position covers the ``WINDOW`` bytes before it: h[i] = sum of G[byte[i-k]] << k, taken
modulo 2^32. Texts lie in one buffer with zero bytes between them (the zero byte counts nothing), so a
position's hash depends on its own text alone.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


GEAR = (_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
GEAR[0] = 0
_VALUE = _mixed(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Buffer:
    """Texts side by side: bytes, start and end of each, and the gear hash at each byte."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.bytes = np.frombuffer((b"\0" * WINDOW).join(raw) + b"\0", dtype=np.uint8)
        self.start = np.cumsum(size + WINDOW) - size - WINDOW
        self.end = self.start + size
        h = GEAR[self.bytes]
        step = 1
        while step < WINDOW:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
        self.hash = h

    def cuts(self, bits: int) -> np.ndarray:
        """Positions behind the bytes whose hash begins with so many zero bits."""
        return np.flatnonzero(self.hash < np.uint32(1 << (32 - bits))) + 1

    def digests(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit digest of each byte range: a polynomial over the bytes, mixed with the length."""
        n = len(self.bytes)
        power = np.ones(n + 1, dtype=np.uint64)
        power[1:] = _BASE
        power = np.cumprod(power)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_VALUE[self.bytes] * power[:-1], out=total[1:])
        back = np.full(n + 1, _INVERSE, dtype=np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        return _mixed((total[end] - total[start]) * back[start] + _mixed((end - start).astype(np.uint64)))


def normalised(buf: Buffer, low: int, normal: int, high: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the chunks of each text, ordered by row and start.

    A chunk holds ``low`` bytes at least and ``high`` at most (a text's last may be shorter). Before
    ``normal`` bytes a cut needs one more zero bit, behind it one less, which narrows the lengths.
    """
    strict, loose = buf.cuts(bits + 1), buf.cuts(bits - 1)
    never = np.int64(1) << 60
    strict, loose = np.append(strict, never), np.append(loose, never)
    row = np.flatnonzero(buf.end > buf.start)
    at = buf.start[row]
    rows, starts, ends = [], [], []
    while len(row):
        early = strict[np.searchsorted(strict, at + low)]
        late = loose[np.searchsorted(loose, at + normal + 1)]
        cut = np.where(early <= at + normal, early, np.minimum(late, at + high))
        cut = np.minimum(cut, buf.end[row])
        rows.append(row)
        starts.append(at)
        ends.append(cut)
        more = cut < buf.end[row]
        row, at = row[more], cut[more]
    if not rows:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    row, start, end = np.concatenate(rows), np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start, kind="stable")
    return row[order], start[order], end[order]


def local(buf: Buffer, bits: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``normalised``, but every cut depends on the ``WINDOW`` bytes before it alone: two texts
    that share a passage cut it alike from its first cut on. Chunks beyond ``high`` bytes are cut
    evenly from their start. Cuts lie between code points."""
    cut = buf.cuts(bits)
    nth = np.searchsorted(buf.start, cut, side="left") - 1  # the text that holds the byte before the cut
    ok = (nth >= 0) & (cut < buf.end[np.maximum(nth, 0)])
    cut, nth = cut[ok], nth[ok]
    some = np.flatnonzero(buf.end > buf.start)
    start = np.concatenate([buf.start[some], cut])
    row = np.concatenate([some, nth])
    order = np.argsort(start, kind="stable")
    start, row = start[order], row[order]
    end = np.append(start[1:], 0)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, dtype=bool)
    end[: len(row)][last] = buf.end[row[last]]
    end = end[: len(row)]
    parts = np.maximum(1, -(-(end - start) // high))
    if len(parts) and parts.max() > 1:
        row, at = np.repeat(row, parts), np.repeat(start, parts)
        stop = np.repeat(end, parts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = at + k * high, np.minimum(at + (k + 1) * high, stop)
    inner = buf.bytes[start] & 0xC0 == 0x80  # inside a code point: move on to its end
    while inner.any():
        start = start + inner
        inner = buf.bytes[start] & 0xC0 == 0x80
    if len(start):
        same = row[1:] == row[:-1]
        end[:-1][same] = start[1:][same]
    full = end > start
    return row[full], start[full], end[full]
