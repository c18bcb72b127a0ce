"""Exact gestalt (Ratcliff-Obershelp) kernels on Python strings; positions and lengths count code points.

The matched total of two strings is the length of their longest common substring (the one earliest in ``a``, then in
``b``) plus the matched totals of what is left and right of it. The search for the longest common substring uses that
"the windows share a substring of length k" is monotone in k: k gallops and is then bisected. Each test compares the
hashes of all runs of k characters, which prefix sums give at once; what they find is confirmed on the strings, and equal
runs always have equal hashes, so the result is exact. Pairs and windows of little work go to the standard library's
matcher, which defines the value.

What a string needs as second argument is kept in an ``Index`` and serves all strings that it is compared with.
"""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

SMALL = 64
#: The standard matcher takes pairs with at most so many meetings of equal characters for each character of theirs: measured.
WORK_FACTOR = 3
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse modulo 2**64, ``n`` at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, x in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def codes_of(text: str) -> np.ndarray:
    """The code points of a text; surrogates count like others."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _sums(text: str) -> np.ndarray:
    codes = (codes_of(text).astype(np.uint64) + np.uint64(7)) * np.uint64(0xBF58476D1CE4E5B9)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes ^ codes >> np.uint64(31)) * _power(len(codes))[0][: len(codes)], out=out[1:])
    return out


class Index:
    """A text prepared as second argument: run hashes, places of characters and counts, each made when first asked for."""

    __slots__ = ("text", "_sums", "_matcher", "_counts")

    def __init__(self, text: str):
        self.text, self._sums, self._matcher, self._counts = text, None, None, None

    def sums(self) -> np.ndarray:
        if self._sums is None:
            self._sums = _sums(self.text)
        return self._sums

    def matcher(self) -> SequenceMatcher:
        if self._matcher is None:
            self._matcher = SequenceMatcher(None, "", self.text, autojunk=False)
        return self._matcher

    def counts(self) -> Counter:
        if self._counts is None:
            self._counts = Counter(self.text)
        return self._counts


def indexed(b: str | Index) -> Index:
    return b if isinstance(b, Index) else Index(b)


def _longest(a: str, sa: np.ndarray, al: int, ar: int, b: str, sb: np.ndarray, bl: int, br: int, cap: int) -> tuple[int, int, int]:
    """Place in ``a``, place in ``b`` and length of the longest common substring of two windows; none is longer than ``cap``."""
    top = min(ar - al, br - bl, cap)
    best = (al, bl, 0)
    inverse = _power(max(ar, br))[1]

    def test(k: int) -> bool:
        nonlocal best
        ha = (sa[al + k : ar + 1] - sa[al : ar - k + 1]) * inverse[al : ar - k + 1]
        hb = (sb[bl + k : br + 1] - sb[bl : br - k + 1]) * inverse[bl : br - k + 1]
        hb.sort()
        at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
        for i in np.flatnonzero(hb[at] == ha).tolist():
            j = b.find(a[al + i : al + i + k], bl, br)
            if j >= 0:
                best = (al + i, j, k)
                return True
        return False

    low, k = 0, min(16, top)
    while k <= top and test(k):
        # The first run of k characters may go on; no run of the longer length begins earlier, as it would be one of k too.
        i, j, _ = best
        while k < top and i + k < ar and j + k < br and a[i + k] == b[j + k]:
            k += 1
        best = (i, j, k)
        low, k = k, k + max(1, min(k, top - k)) if k < top else top + 1
    high = min(k, top + 1)
    while high - low > 1:
        mid = (low + high) // 2
        if test(mid):
            i, j, k = best
            while k < high - 1 and i + k < ar and j + k < br and a[i + k] == b[j + k]:
                k += 1
            best = (i, j, k)
            low = k
        else:
            high = mid
    return best


def work_estimate(a: str, b: str | Index) -> int:
    """Meetings of equal characters: the work of a matcher that follows all places of each character."""
    counts = indexed(b).counts()
    return sum(n * counts[c] for c, n in Counter(a).items())


def _blocks(matcher: SequenceMatcher) -> int:
    return sum(m.size for m in matcher.get_matching_blocks())


def b2j_matched(a: str, b: str | Index) -> int:
    """The matched total by the places of each character of ``b``, which the index keeps."""
    matcher = indexed(b).matcher()
    matcher.set_seq1(a)
    return _blocks(matcher)


def matched(a: str, b: str | Index, least: int = 0, enough: int | None = None) -> int | None:
    """The matched total of ``a`` and ``b``; the order of the arguments matters.

    None as soon as it cannot reach ``least``; some number from ``enough`` on as soon as it reaches that.
    """
    index = indexed(b)
    b = index.text
    if a == b:
        return len(a)
    if min(len(a), len(b)) < SMALL or work_estimate(a, index) <= WORK_FACTOR * (len(a) + len(b)):
        return b2j_matched(a, index)
    sa, sb = _sums(a), index.sums()
    total, stack = 0, [(0, len(a), 0, len(b), max(len(a), len(b)))]
    open_ = min(len(a), len(b))  # what the windows on the stack can still add
    while stack:
        al, ar, bl, br, cap = stack.pop()
        open_ -= min(ar - al, br - bl)
        if ar - al < SMALL or br - bl < SMALL:
            total += _blocks(SequenceMatcher(None, a[al:ar], b[bl:br], autojunk=False))
        else:
            i, j, k = _longest(a, sa, al, ar, b, sb, bl, br, cap)
            if k:
                total += k
                sides = [w for w in ((al, i, bl, j, k), (i + k, ar, j + k, br, k)) if w[0] < w[1] and w[2] < w[3]]
                sides.sort(key=lambda w: min(w[1] - w[0], w[3] - w[2]))
                stack += sides
                open_ += sum(min(w[1] - w[0], w[3] - w[2]) for w in sides)
        if total + open_ < least:
            return None
        if enough is not None and total >= enough:
            return total
    return total


def ratio(a: str, b: str | Index) -> float:
    """Twice the matched total over both lengths; 1.0 for two empty strings."""
    index = indexed(b)
    size = len(a) + len(index.text)
    return 2.0 * matched(a, index) / size if size else 1.0


def b2j_ratio(a: str, b: str | Index) -> float:
    """The same number, always by the places of each character of ``b``."""
    index = indexed(b)
    size = len(a) + len(index.text)
    return 2.0 * b2j_matched(a, index) / size if size else 1.0


def _reaching(size: int, t: float) -> int:
    """The least matched total of which the ratio is at least ``t``."""
    m = max(0, math.ceil(t * size / 2) - 1)
    while 2.0 * m / size < t:
        m += 1
    return m


def lcs_reaches(a: str, b: str, need: int) -> bool:
    """Whether the longest common subsequence has ``need`` characters; the matched total is never longer.

    Bit-parallel over one integer, left as soon as the rest of ``b`` cannot reach the need.
    """
    if need <= 0:
        return True
    if need > min(len(a), len(b)):
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v, n = full, len(b)
    for k, c in enumerate(b):
        m = where.get(c)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & full
        if k & 63 == 63 and len(a) - v.bit_count() + n - k - 1 < need:
            return False
    return len(a) - v.bit_count() >= need


#: Bits that are packed into one integer, about.
_PACKED = 1 << 16


def _bit_masks(text) -> dict:
    """For each character the integer with its places as bits."""
    places: dict = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    out = {}
    for c, own in places.items():
        bits = np.zeros(own[-1] + 1, np.uint8)
        bits[own] = 1
        out[c] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


def _lanes_reach(lanes: list[tuple[int, dict, int]], b) -> list[bool]:
    """For each lane (length, bit masks, need) whether its text and ``b`` have a common subsequence of the need.

    The texts stand side by side in one integer, a clear bit between each two, so one step serves all. Lanes that have what
    they need, or can no longer reach it, are left, and what remains is packed anew when it is a half.
    """
    out = [False] * len(lanes)
    live = [k for k, (n, _, need) in enumerate(lanes) if need <= min(n, len(b))]
    state: dict[int, int] = {k: (1 << lanes[k][0]) - 1 for k in live}
    at = 0
    while live and at < len(b):
        offset, full, v, where, places = 0, 0, 0, {}, []
        for k in live:
            n, masks, _ = lanes[k]
            full |= (1 << n) - 1 << offset
            v |= state[k] << offset
            for c, m in masks.items():
                where[c] = where.get(c, 0) | m << offset
            places.append(offset)
            offset += n + 1
        packed = len(live)
        while at < len(b):
            for c in b[at : at + 64]:
                m = where.get(c)
                if m is not None:
                    u = v & m
                    v = (v + u | v - u) & full
            at = min(at + 64, len(b))
            left, kept, first = len(b) - at, [], []
            for k, offset in zip(live, places):
                n, _, need = lanes[k]
                mine = v >> offset & (1 << n) - 1
                have = n - mine.bit_count()
                if have >= need:
                    out[k] = True
                elif have + left >= need:
                    state[k] = mine
                    kept.append(k)
                    first.append(offset)
            live, places = kept, first
            if len(live) * 2 <= packed:
                break
    return out


def lcs_reach_many(texts: list, left: np.ndarray, right: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For pairs of places in ``texts``, whether their longest common subsequences have ``need`` characters.

    As ``lcs_reaches``, for all that meet one text at once.
    """
    left, right, need = (np.asarray(x, np.int64) for x in (left, right, need))
    out = need <= 0
    todo = np.flatnonzero(~out)
    todo = todo[np.lexsort((left[todo], right[todo]))]
    masks: dict[int, dict] = {}
    at = 0
    while at < len(todo):
        b, end, size = int(right[todo[at]]), at, 0
        while end < len(todo) and right[todo[end]] == b and (end == at or size < _PACKED):
            size += len(texts[left[todo[end]]])
            end += 1
        lanes = []
        for k in todo[at:end].tolist():
            a = int(left[k])
            if a not in masks:
                if len(masks) > 512:
                    masks.clear()
                masks[a] = _bit_masks(texts[a])
            lanes.append((len(texts[a]), masks[a], int(need[k])))
        out[todo[at:end]] = _lanes_reach(lanes, texts[b])
        at = end
    return out


def edge(a: str, b: str | Index, t: float, bounded: bool = False, delta: float = 0.0) -> float | None:
    """The ratio if it is at least ``t``, else None. ``bounded``: the subsequence bound has been tried already.

    ``delta`` would allow an approximation; it is accepted and changes nothing.
    """
    index = indexed(b)
    b = index.text
    size = len(a) + len(b)
    if not size or a == b:
        return 1.0 if t <= 1.0 else None
    if 2.0 * min(len(a), len(b)) / size < t:
        return None
    need = _reaching(size, t)
    if not bounded and not lcs_reaches(a, b, need):
        return None
    m = matched(a, index, least=need)
    return 2.0 * m / size if m is not None and 2.0 * m / size >= t else None


def qualifies(a: str, b: str | Index, t: float) -> bool:
    """Whether the ratio is at least ``t``: left early either way."""
    index = indexed(b)
    size = len(a) + len(index.text)
    if not size:
        return t <= 1.0
    need = _reaching(size, t)
    if need > min(len(a), len(index.text)):
        return False
    m = matched(a, index, least=need, enough=need)
    return m is not None and m >= need


def ratio_capped(a: str, b: str | Index, cap: float) -> float:
    """The ratio if it is at most ``cap``, else 2.0, as soon as it is known to be above."""
    index = indexed(b)
    size = len(a) + len(index.text)
    if not size:
        return 1.0 if cap >= 1.0 else 2.0
    above = _reaching(size, math.nextafter(cap, math.inf)) if cap < 1.0 else size + 1
    m = matched(a, index, enough=above)
    return 2.0 if m >= above else 2.0 * m / size


def matching_stats(a: str, b: str) -> list[int]:
    """For each place of ``a`` the length of the longest suffix of ``a`` up to there that occurs in ``b``.

    A match that begins later ends no earlier, so its begin only moves on; how far a match from a place goes is found on
    hashed runs, by halving for all places at once.
    """
    n = len(a)
    if not n or not b:
        return [0] * n
    sa, sb = _sums(a), _sums(b)
    inverse = _power(max(n, len(b)))[1]
    # longest match that starts at each place
    low, high = np.zeros(n, np.int64), np.minimum(n - np.arange(n), len(b))
    runs: dict[int, np.ndarray] = {}
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            break
        mid = (low[open_] + high[open_] + 1) // 2
        for k in np.unique(mid).tolist():
            if k not in runs:
                if len(runs) > 64:
                    runs.clear()
                runs[k] = np.unique((sb[k:] - sb[: len(b) - k + 1]) * inverse[: len(b) - k + 1])
            own = open_[mid == k]
            h = (sa[own + k] - sa[own]) * inverse[own]
            at = np.minimum(np.searchsorted(runs[k], h), len(runs[k]) - 1)
            yes = runs[k][at] == h
            low[own[yes]] = k
            high[own[~yes]] = k - 1
    low = low.tolist()
    # Equal hashes are confirmed where a match isn't the rest of the one before it.
    sure = all(a[i : i + k] in b for i, k in enumerate(low) if not i or k >= low[i - 1])
    out, start = [], 0
    for end in range(1, n + 1):
        while start < end and (low[start] < end - start if sure else a[start:end] not in b):
            start += 1
        out.append(end - start)
    return out


def matching_stats_cost(a: str, b: str) -> int:
    """The sum of the matching statistics."""
    return sum(matching_stats(a, b))


def delta_to_chain_cap(delta: float) -> int:
    """The cap that an approximation of ``delta`` stands for; results here are exact whatever it is."""
    if delta <= 0:
        return 2**32 - 1
    return 1 if delta >= 1 else max(1, math.ceil(1 / math.sqrt(delta)))
