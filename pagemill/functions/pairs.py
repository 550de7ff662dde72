"""Pairs of texts compared in Arrow batches: exact edit distances, and n-grams in common.

A distance is settled by bounds that meet where they do: a shared start and end
count nothing; texts of one length whose differing characters have none in
common differ by substitutions alone; a text whose characters occur in the
other in their order, but for those it hasn't at all, costs the difference in
length and those. All other pairs go through Myers' bit vectors (1999) as wide
as the longer text, in steps over the shorter one.

N-grams are hashed (57 bits), sorted pair by pair and counted in runs, a few
dozen pairs at a time.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

#: Pairs that are counted together, and the characters at which fewer are.
MOST_PAIRS, MOST_CHARACTERS = 64, 1 << 20
_PAIR_SHIFT = np.uint64(64 - 6)
_SPACE, _LETTER, _DIGIT, _MARK, _UNSEEN = range(5)
_BLANKS = " \t\n\x0b\x0c\r"
_kinds = np.full(0x110000, _UNSEEN, np.uint8)
_worth = np.zeros(0x110000, np.uint64)  # of a character in a token's hash, times a power of _BASE by its place
_BASE, _BY_BASE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)))
_powers = np.ones((2, 1), np.uint64)


def texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def distance(a: str, b: str) -> int:
    """The edit distance in characters."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    more = len(a) - len(b)
    if a.startswith(b) or a.endswith(b):
        return more
    x, y = _codes(a), _codes(b)
    start = int((x[: len(y)] != y).argmax())
    x, y = x[start:], y[start:]
    differ = x[more:] != y
    end = int(differ[::-1].argmax()) if differ.any() else len(y)
    x, y = x[: len(x) - end], y[: len(y) - end]
    if not len(y):
        return more
    if not more:
        differ = differ[: len(y)]
        if not set(x[differ].tolist()) & set(y[differ].tolist()):
            return int(differ.sum())
    a, b = a[start : start + len(x)], b[start : start + len(y)]
    lacking = _lacking_in_order(a, b) if more else None
    return _by_bits(x, b) if lacking is None else more + lacking


def _lacking_in_order(a: str, b: str) -> int | None:
    """How many characters of ``b`` aren't in ``a``, if the others come there in their order, with room for these between."""
    place, lacking, absent = 0, 0, {c for c in set(b) if c not in a}
    for c in b:
        if c in absent:
            lacking += 1
        else:
            place = a.find(c, place)
            if place < 0:
                return None
        place += 1
    return lacking if place <= len(a) else None


def _by_bits(x: np.ndarray, b: str) -> int:
    every = (1 << len(x)) - 1
    narrow = x.astype(np.uint8) if x.max() < 256 else x
    here = set(b) if narrow is x else {c for c in set(b) if ord(c) < 256}
    where = {c: int.from_bytes(np.packbits(narrow == ord(c), bitorder="little").tobytes(), "little") for c in here}
    up, down = every, 0  # where a column of the table grows, and where it falls
    for c in b:
        same = where.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        grows = (down | (every ^ (across | up))) << 1 | 1
        falls = (up & across) << 1
        same |= down
        up = (falls | (every ^ (same | grows))) & every  # bits beyond the text never reach those inside
        down = grows & same
    return len(b) + up.bit_count() - down.bit_count()


def distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """That of each pair; null if a text is."""
    return pa.array([None if x is None or y is None else distance(x, y) for x, y in zip(texts(a), texts(b))], pa.int32())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _kinds_of(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds.take(codes)
    if (kinds == _UNSEEN).any():
        for code in np.unique(codes[kinds == _UNSEEN]).tolist():
            first = unicodedata.category(chr(code))[0]
            _kinds[code] = _SPACE if chr(code) in _BLANKS else {"L": _LETTER, "N": _DIGIT}.get(first, _MARK)
            _worth[code] = _mixed(np.array([code + 1], np.uint64) * _BASE)[0] if _kinds[code] != _SPACE else 0
        kinds = _kinds.take(codes)
    return kinds


def _powers_to(n: int) -> np.ndarray:
    """The powers of _BASE and of its inverse, up to n."""
    global _powers
    if _powers.shape[1] <= n:
        _powers = np.cumprod(np.concatenate((np.ones((2, 1), np.uint64), np.tile([[_BASE], [_BY_BASE]], 2 * n)), axis=1), axis=1, dtype=np.uint64)
    return _powers


def _tokens(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' tokens (runs of letters, runs of digits, single marks), and where each text's begin and end."""
    codes = _codes("\n".join([*distinct, ""])).astype(np.intp)
    kinds = _kinds_of(codes)
    inside = kinds != _SPACE
    begins = inside & ((kinds == _MARK) | (kinds != np.concatenate((kinds[:1] * 0, kinds[:-1]))))
    starts = np.flatnonzero(begins)
    bounds = np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in distinct]))))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    powers = _powers_to(len(codes))
    return _mixed(np.add.reduceat(_worth.take(codes) * powers[0, : len(codes)], starts) * powers[1, starts]), bounds


def matches(truth: pa.Array, candidate: pa.Array, orders: int) -> pa.StructArray:
    """For each pair how many tokens both texts have (nt, nc), and how many n-grams of the candidate are in the
    truth, each at most as often as there (hit1 to that of ``orders``). Nulls count as empty texts."""
    t, c = ([x or "" for x in texts(side)] for side in (truth, candidate))
    parts, at = [np.zeros((0, orders + 2), np.int64)], 0
    while at < len(t):
        upto, size = at, 0
        while upto < len(t) and upto - at < MOST_PAIRS and (upto == at or size + len(t[upto]) + len(c[upto]) <= MOST_CHARACTERS):
            size += len(t[upto]) + len(c[upto])
            upto += 1
        parts.append(_matches(t[at:upto], c[at:upto], orders))
        at = upto
    found = np.concatenate(parts).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(x) for x in found.T], ["nt", "nc", *(f"hit{n}" for n in range(1, orders + 1))])


def _same_start(words: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of n words from places a and b on are the same; n is 1 or more."""
    first = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(first, n)
    same = words[np.repeat(a, n) + step] == words[np.repeat(b, n) + step]
    return np.minimum.reduceat(np.where(same, np.repeat(n, n), step), first)


def _matches(t: list[str], c: list[str], orders: int) -> np.ndarray:
    number: dict[str, int] = {}
    sides = [np.array([number.setdefault(x, len(number)) for x in side]) for side in (t, c)]
    words, bounds = _tokens(list(number))
    sizes = np.diff(bounds)
    nt, nc = sizes[sides[0]], sizes[sides[1]]
    totals = np.maximum(nc[:, None] - np.arange(orders), 0)
    out = np.column_stack((nt, nc, np.where((sides[0] == sides[1])[:, None], totals, 0)))
    pairs = np.flatnonzero((sides[0] != sides[1]) & (nt > 0) & (nc > 0))
    if not len(pairs):
        return out
    at = [bounds[side[pairs]] for side in sides]
    shared = np.maximum(_same_start(words, *at, np.minimum(nt, nc)[pairs]) - (orders - 1), 0)
    out[pairs, 2:] += shared[:, None]  # n-grams that begin there are in both texts
    of_both = np.concatenate([side[pairs] for side in sides])
    begin = np.concatenate(at) + np.tile(shared, 2)
    n_of = bounds[of_both + 1] - begin
    first = np.cumsum(n_of) - n_of
    place = np.arange(int(n_of.sum())) + np.repeat(begin - first, n_of)  # of each other token of each side
    left = np.repeat(bounds[of_both + 1], n_of) - place
    key = np.repeat(np.concatenate((pairs, pairs)).astype(np.uint64) << _PAIR_SHIFT, n_of)
    key[first[len(pairs)] :] |= np.uint64(1)  # the candidate's
    low = (np.uint64(1) << _PAIR_SHIFT) - np.uint64(2)
    grams = words
    for n in range(1, orders + 1):
        if n > 1:
            grams = grams[: len(words) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + words[n - 1 :]
            whole = left >= n
            place, left, key = place[whole], left[whole], key[whole]
            if not len(place):
                break
        both = np.sort(key | (grams[place] & low))
        starts = np.flatnonzero(np.concatenate(([True], (both[1:] ^ both[:-1]) > np.uint64(1))))
        of_candidate = np.add.reduceat((both & np.uint64(1)).astype(np.int64), starts)
        hits = np.minimum(of_candidate, np.diff(np.append(starts, len(both))) - of_candidate)
        out[:, 1 + n] += np.bincount((both[starts] >> _PAIR_SHIFT).astype(np.int64), hits, len(t)).astype(np.int64)
    return out
