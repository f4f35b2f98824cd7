"""Vectorised text kernels on Arrow string buffers.

Texts are handled as the bytes that Arrow already holds: words and lines are found with byte
masks, and every span gets a 64-bit polynomial hash from one prefix sum, so no Python object is
made per word.  Memory is bounded by the slice that is worked on (``SLICE`` bytes, or one
longer text), never by the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
_SEG = 1 << 16
_MASK = (1 << 64) - 1
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.full(_SEG, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW, _INV = _powers(_BASE), _powers(_INVERSE)
#: A random odd number for each byte value; in FOLDED, A-Z have those of a-z.
TABLE = np.random.default_rng(20240101).integers(0, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
FOLDED = TABLE.copy()
FOLDED[ord("A") : ord("Z") + 1] = TABLE[ord("a") : ord("z") + 1]

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: True for bytes of a word ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~SPACES


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all of its input."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def slices(texts: pa.Array, target: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive texts of about ``target`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    _, at, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offs = np.frombuffer(at, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + target, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def give_back() -> None:
    """Return memory that Arrow and the C library hold free to the system; else a worker keeps the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, with free memory given back when the task ends: Spark uses its workers again in later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = TABLE) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]``; starts and ends are sorted and no span is empty."""
    low, high = np.empty(len(starts), _U), np.empty(len(starts), _U)
    inverse = np.empty(len(starts), _U)
    carry = np.zeros(1, _U)
    scale = iscale = 1
    step, istep = pow(_BASE, _SEG, 1 << 64), pow(_INVERSE, _SEG, 1 << 64)
    prefix = np.empty(_SEG + 1, _U)
    for a in range(0, len(buf), _SEG):
        b = min(len(buf), a + _SEG)
        p = prefix[: b - a + 1]
        terms = values[buf[a:b]]
        terms *= _POW[: b - a]
        if scale != 1:
            terms *= _U(scale)
        np.cumsum(terms, out=p[1:])
        p[0] = 0
        p += carry
        carry = p[-1:].copy()
        i, j = np.searchsorted(starts, [a, b])
        low[i:j] = p[starts[i:j] - a]
        inverse[i:j] = _INV[starts[i:j] - a] * _U(iscale)
        i, j = np.searchsorted(ends, [a, b], side="right")
        high[i:j] = p[ends[i:j] - a]
        scale, iscale = scale * step & _MASK, iscale * istep & _MASK
    return mix((high - low) * inverse)


def word_spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the words of all texts, and the number of the first word of each text and after the last."""
    w = inside[buf]
    s, e = w.copy(), w.copy()
    s[1:] &= ~w[:-1]
    e[:-1] &= ~w[1:]
    full = offs[1:] > offs[:-1]
    heads, tails = offs[:-1][full], offs[1:][full] - 1
    s[heads], e[tails] = w[heads], w[tails]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offs)


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-empty lines (split at \\n, which is left out) of all texts."""
    full = offs[1:] > offs[:-1]
    breaks = np.flatnonzero(buf == 10)
    starts = np.unique(np.concatenate([offs[:-1][full], breaks + 1]))
    starts = starts[starts < len(buf)]
    if not len(starts):
        return starts, starts
    stops = offs[1:][full]
    ends = np.minimum(np.append(breaks, len(buf))[np.searchsorted(breaks, starts)], stops[np.searchsorted(stops, starts, side="right")])
    keep = ends > starts
    return starts[keep], ends[keep]


def per_text(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many True of ``mask`` lie in each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of all n-word windows that lie in one text; a position is the number of the first word."""
    if len(hashes) < n:
        return np.empty(0, _U), np.empty(0, np.int64)
    size = len(hashes) - n + 1
    h = hashes[:size].copy()
    for k in range(1, n):
        h *= _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
        h += hashes[k : k + size]
    ok = np.ones(size, bool)
    for k in range(1, n):
        cut = first[1:] - k
        ok[cut[(cut >= 0) & (cut < size)]] = False
    # A text shorter than n words leaves windows that start before it and end after it: they are cut by the rule above too.
    at = np.flatnonzero(ok)
    return mix(h[at]), at


def owners(at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The text that each word number belongs to."""
    return np.searchsorted(first, at, side="right") - 1
