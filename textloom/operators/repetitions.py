"""Groups of characters that follow each other four times or more, a white space between two of them or none, in about n log n steps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: What is found: the shortest group at the leftmost place.  By itself it tries every length at every place.
REPEATED = re.compile(r"(.+?)(?:\s?\1){3,}")
_LEAST = 12
_SHORT = re.compile(rf"(.{{1,{_LEAST - 1}}}?)(?:\s?\1){{3,}}")
#: Characters compared first at an anchor, for groups of up to _LONG characters and longer ones.
_FEW, _MANY, _LONG = 6, 16, 40
_KEPT_SIZE, _AT_ONCE = 8192, 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Whether a character is white space; beyond U+3000 none is.
_BLANKS = np.fromiter((chr(c).isspace() for c in range(0x3001)), bool)
_anchors: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _make_anchors(size: int, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, lengths), by length: every half a length, so that each stretch of a length has an anchor with half a length after it."""
    lengths = np.arange(shortest, longest + 1)
    half = lengths // 2
    many = -(-size // half)
    p = np.repeat(lengths, many)
    k = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many)
    return (k * (p // 2)).astype(np.int32), p.astype(np.int32)


def _anchor_parts(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Anchors of all lengths up to longest, places under n and some beyond."""
    size = 256
    while size < n:
        size += size // 4
    if size <= _KEPT_SIZE:
        if size not in _anchors:
            _anchors[size] = _make_anchors(size, _LEAST, size // 4)
        t, p = _anchors[size]
        end = np.searchsorted(p, longest, "right")
        yield t[:end], p[:end]
        return
    at = _LEAST
    while at <= longest:
        to = at
        while to < longest and (to + 1 - at) * 2 * n // at < _AT_ONCE:
            to += 1
        yield _make_anchors(n, at, to)
        at = to + 1


class _Text:
    """Hashes of a text's parts, of which equal ones have equal ones; line breaks up to each place; white space."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        if len(_powers[0]) <= n:
            for k, base in enumerate((_B, _B_INVERSE)):
                _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * len(_powers[k])), base, np.uint64))])
        self.n = n
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * _powers[0][:n])])
        self.inverse = _powers[1]
        self.breaks = np.concatenate([[0], np.cumsum(codes == 10)])
        self.blank = codes < len(_BLANKS)
        self.blank[self.blank] = _BLANKS[codes[self.blank]]

    def part(self, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.inverse[at]


def _grams(sums: _Text, size: int, pad: int) -> np.ndarray:
    """The hash of the size characters from each place on; at the end, and so much beyond it, numbers of which no two are equal."""
    whole = max(sums.n - size + 1, 0)
    found = np.arange(sums.n + pad, dtype=np.uint64)
    found[:whole] = sums.part(np.arange(whole), size)
    return found


def _hits(text: _Text, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, lengths) where half a length from the anchor on occurs again a length, or one more, later."""
    n, pad = text.n, text.n // 2 + 600
    few, many = _grams(text, _FEW, pad), _grams(text, _MANY, pad)
    ts, ps = [], []
    for t, p in _anchor_parts(n, longest):
        cut = np.searchsorted(p, _LONG)
        for grams, its, lengths in ((few, t[:cut], p[:cut]), (many, t[cut:], p[cut:])):
            here = grams[its]
            for d in (0, 1):
                found = np.flatnonzero(here == grams[its + lengths + d])
                a, b = its[found].astype(np.int64), lengths[found].astype(np.int64)
                half = b // 2
                inside = a + b + d + half <= n
                a, b, half = a[inside], b[inside], half[inside]
                same = text.part(a, half) == text.part(a + b + d, half)
                ts.append(a[same])
                ps.append(b[same])
    return np.concatenate(ts), np.concatenate(ps)


def _fourfold(text: _Text, i: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Those of the places i at which a group of that length begins and occurs four times; of blanks alone some may be missing."""
    fits = i + 4 * length <= text.n
    i, length = i[fits], length[fits]
    fits = text.breaks[i + length] == text.breaks[i]
    i, length = i[fits], length[fits]
    q, own = i + length, text.part(i, length)
    for _ in range(3):
        room = text.n - length
        apart = text.blank[np.minimum(q, text.n - 1)] & (q < room) & (text.part(np.minimum(q + 1, room), length) == own)
        fits = apart | ((q <= room) & (text.part(np.minimum(q, room), length) == own))
        i, length, own, q = i[fits], length[fits], own[fits], (q + length + apart)[fits]
    return i


def _short_starts(text: _Text) -> np.ndarray:
    """In order, the places where a group shorter than _LEAST begins and occurs four times, and every pair of blanks."""
    n, out = text.n, [np.flatnonzero(text.blank[:-1] & text.blank[1:])]
    for p in range(1, min(_LEAST - 1, n // 4) + 1):
        own = (text.sums[p:] - text.sums[:-p]) * text.inverse[: n - p + 1]
        some = own[:-p] == own[p:]
        some[:-1] |= (own[: -p - 1] == own[p + 1 :]) & text.blank[p : n - p]
        i = np.flatnonzero(some)
        out.append(_fourfold(text, i, np.full(len(i), p)))
    return np.unique(np.concatenate(out))


def _first(text: _Text, t: np.ndarray, p: np.ndarray, at: int, end: int) -> int:
    """The first place from at on and before end where a group of one of the lengths p, near its anchor t, begins and occurs four times; else end."""
    low, high = np.maximum(t + p // 2 - p, at), np.minimum(t + 1, end)
    order = np.argsort(low, kind="stable")
    low, high, p = low[order], high[order], p[order]
    k = 0
    while k < len(p) and low[k] < end:
        many = np.maximum(np.minimum(high[k:], end) - low[k:], 0)
        to = max(1, int(np.searchsorted(np.cumsum(many), _AT_ONCE)))
        many = many[:to]
        i = np.repeat(low[k : k + to] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        i = _fourfold(text, i, np.repeat(p[k : k + to], many))
        k += to
        if len(i):
            end = int(i.min())
    return end


def repeated(text: str) -> Iterator[re.Match]:
    """What REPEATED.finditer(text) finds."""
    n = len(text)
    if n < 4:
        return
    longest = min(max(map(len, text.split("\n"))), n // 4)
    its = _Text(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    t, p = _hits(its, longest) if longest >= _LEAST else (np.zeros(0, int), np.zeros(0, int))
    short = _short_starts(its)
    at, k, m = 0, 0, None
    while at < n:
        # the next short group, m
        if m is None or m.start() < at:
            m = None
            k += int(np.searchsorted(short[k:], at))
            while k < len(short) and m is None:
                m = _SHORT.match(text, int(short[k]))
                k += 1
        end = m.start() if m else n
        some = (t >= at) & (t + p // 2 - p < end) if len(t) else t
        first = _first(its, t[some], p[some], at, end) if some.any() else end
        if first < end:
            found = REPEATED.match(text, first)
            if found is None:  # two hashes that are equal by chance
                at = first + 1
                continue
        elif m is None:
            return
        else:
            found = m
        yield found
        at = found.end()
