"""Myers' bit-parallel edit distance: on Python's unbounded integers, and on all 64-bit blocks of many pairs side by side."""

from __future__ import annotations

from collections import Counter

import numpy as np

_ONE, _TOP, _ALL = np.uint64(1), np.uint64(63), np.uint64(2**64 - 1)
#: Blocks of 64 characters that are compared side by side, those of one pair at most, and places in their tables of characters: 32 MB.
LANES, LONGEST, PLACES = 8192, 512, 1 << 22
#: Texts from here on are first compared word by word, which is quicker than a block for each 64 characters.
WORDWISE = 640


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits of its places in pattern."""
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _scan(pattern: str, peq: dict[str, int], text: str, anchored: bool):
    """The distance of pattern to a text that ends at each place of text: to the whole of it if anchored, else to its nearest suffix."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, score, get = full, 0, m, peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 | anchored, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv
        yield score


def _common(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        at = (low + high + 1) // 2
        low, high = (at, high) if a[low:at] == b[low:at] else (low, at - 1)
    return low


def _middles(a: str, b: str) -> tuple[str, str]:
    """What is left of two texts without what both begin and end with, which costs nothing."""
    first = _common(a, b)
    a, b = a[first:], b[first:]
    last = _common(a[::-1], b[::-1])
    return a[: len(a) - last], b[: len(b) - last]


def distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance of two texts, or most + 1 if it is over most."""
    if len(a) > len(b):
        a, b = b, a
    if most is not None and len(b) - len(a) > most:
        return most + 1
    if a == b:
        return 0
    a, b = _middles(a, b)
    if not a:
        return len(b)
    score, left = len(a), len(b)
    for score in _scan(a, masks(a), b, True):
        left -= 1
        if most is not None and score - left > most:
            return most + 1
    return score


def _bound(a: list[str], b: list[str], most: int) -> int:
    """At least the distance of two texts, given as words, or over most: words that both have once stay where they are, in the order of the first text, and what lies between two of them is replaced."""
    place = {w: i for i, w in enumerate(b)}
    once = place.keys() - {w for w, n in Counter(b).items() if n > 1} if len(place) < len(b) else place
    if len(set(a)) < len(a):
        twice = {w for w, n in Counter(a).items() if n > 1}
        shared = [(i, place[w]) for i, w in enumerate(a) if w in once and w not in twice]
    else:
        shared = [(i, place[w]) for i, w in enumerate(a) if w in once]
    cost = at = last = 0
    for i, j in [*shared, (len(a), len(b))]:
        if j >= last:
            if (i - at or j - last) and a[at:i] != b[last:j]:
                cost += max(sum(map(len, a[at:i])) + i - at, sum(map(len, b[last:j])) + j - last)
                if cost > most:
                    break
            at, last = i + 1, j + 1
    return cost


def distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of pairs of texts with a character at least, the shorter one first.

    Each step takes every block of 64 characters of every pair one character of the longer text on. A block is one step
    behind the one above it, whose carry it needs; what it does before its text begins is undone when it begins.
    """
    sizes, ends = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    blocks = (sizes + 63) // 64
    order = np.argsort(-(ends + blocks), kind="stable")
    sizes, ends, blocks = sizes[order], ends[order], blocks[order]
    codes = lambda side: np.frombuffer("".join(pairs[i][side] for i in order.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
    pattern, text = codes(0), codes(1)
    known = np.zeros(int(max(pattern.max(), text.max())) + 1, bool)
    known[pattern] = True
    number = np.cumsum(known) * known  # 0: in no pattern
    kinds, lanes = int(number.max()) + 1, int(blocks.sum())
    if len(pairs) > 1 and kinds * lanes > PLACES:  # bounded memory
        found = np.empty(len(pairs), np.int64)
        for part in (order[: len(order) // 2], order[len(order) // 2 :]):
            found[part] = distances([pairs[i] for i in part.tolist()])
        return found
    first = np.cumsum(blocks) - blocks
    pair = np.repeat(np.arange(len(pairs)), blocks)
    level, base = np.arange(lanes) - first[pair], np.arange(lanes) * kinds
    at = np.arange(len(pattern)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.zeros(lanes * kinds, np.uint64)
    np.bitwise_or.at(places, base[np.repeat(first, sizes) + at // 64] + number[pattern], _ONE << (at % 64).astype(np.uint64))
    deep = int(blocks.max())
    text = np.pad(number[text], deep)
    start = deep + (np.cumsum(ends) - ends)[pair] - level
    up, down, score = np.full(lanes, _ALL), np.zeros(lanes, np.uint64), sizes.copy()
    plus, minus = np.empty(lanes, np.uint64), np.empty(lanes, np.uint64)
    last, high, stop = first + blocks - 1, ((sizes - 1) % 64).astype(np.uint64), ends + blocks - 1
    more = np.zeros((2, lanes), np.uint64)
    for t, n in enumerate(np.searchsorted(-stop, -np.arange(stop[0]), "left").tolist()):  # n pairs go on
        m = int(last[n - 1]) + 1
        if 0 < t < deep:
            fresh = np.flatnonzero(level == t)
            up[fresh], down[fresh] = _ALL, 0
            score[blocks == t + 1] = sizes[blocks == t + 1]
        pv, mv, p, q = up[:m], down[:m], plus[:m], minus[:m]
        p[1:], q[1:] = more[0, : m - 1], more[1, : m - 1]
        p[first[:n]], q[first[:n]] = 1, 0
        eq = places.take(base[:m] + text.take(start[:m] + t))
        xv = eq | mv
        eq |= q
        xh = eq & pv
        xh += pv
        xh ^= pv
        xh |= eq
        mh = pv & xh
        xh |= pv
        ph = np.bitwise_not(xh, out=xh)
        ph |= mv
        ends_at = last[:n]
        score[:n] += (ph[ends_at] >> high[:n] & _ONE).view(np.int64) - (mh[ends_at] >> high[:n] & _ONE).view(np.int64)
        np.right_shift(ph, _TOP, out=more[0, :m])
        np.right_shift(mh, _TOP, out=more[1, :m])
        ph <<= _ONE
        ph |= p
        mh <<= _ONE
        mh |= q
        np.bitwise_and(ph, xv, out=mv)
        xv |= ph
        np.bitwise_not(xv, out=xv)
        np.bitwise_or(mh, xv, out=pv)
    found = np.empty(len(pairs), np.int64)
    found[order] = score
    return found


def all_similar(left: list[str], right: list[str], most: list[int]) -> np.ndarray:
    """Of each pair, whether its distance is at most so much: by its lengths, by what both texts begin and end with, by words where they are long, and the rest side by side."""
    found, open_ = np.zeros(len(left), bool), []
    for i, (a, b, m) in enumerate(zip(left, right, most)):
        if abs(len(a) - len(b)) > m:
            continue
        c, d = sorted(_middles(a, b), key=len)
        if len(d) <= m or len(d) > WORDWISE and _bound(a.split(" "), b.split(" "), m) <= m:
            found[i] = True
        elif len(c) > 64 * LONGEST:
            found[i] = distance(c, d, m) <= m
        elif c:
            open_.append((i, (c, d)))
    open_.sort(key=lambda x: len(x[1][1]))
    at = 0
    while at < len(open_):
        stop, lanes = at, 0
        while stop < len(open_) and (stop == at or lanes < LANES):
            lanes += len(open_[stop][1][0]) // 64 + 1
            stop += 1
        numbers = [i for i, _ in open_[at:stop]]
        found[numbers] = distances([pair for _, pair in open_[at:stop]]) <= np.array(most)[numbers]
        at = stop
    return found


def search(pattern: str, peq: dict[str, int], text: str, most: int) -> tuple[int, int, int] | None:
    """(distance, start, stop) of the best match of pattern in text with at most ``most`` edits, the first of equals; None without one."""
    best, stop = most + 1, -1
    for i, score in enumerate(_scan(pattern, peq, text, False)):
        if score < best:
            best, stop = score, i + 1
    if stop < 0:
        return None
    back = text[max(0, stop - len(pattern) - best) : stop][::-1]
    reverse = pattern[::-1]
    for i, score in enumerate(_scan(reverse, masks(reverse), back, True)):
        if score == best:
            return best, stop - i - 1, stop
    return best, stop, stop


def within(peq: dict[str, int], length: int, text: str, most: int) -> bool:
    """Whether a pattern (its masks and length) matches somewhere in text with at most ``most`` edits."""
    full, high = (1 << length) - 1, 1 << length - 1
    up, down, score, get = full, 0, length, peq.get
    for c in text:
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score <= most:
                return True
        ph, mh = ph << 1, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv
    return score <= most
