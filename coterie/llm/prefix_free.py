"""Suffix order by prefix-free parsing, for many short strings that repeat each other.

A rolling hash of the last TRIGGER bytes cuts the text at content, so the same
content is cut the same way wherever it stands. Phrases overlap by a trigger,
equal phrases are one entry of the dictionary, and a string is the sequence of
its phrases. No proper suffix of a phrase longer than a trigger is the prefix of
another, so two suffixes of the text compare first by the suffixes of their
phrases, then by what follows in the parse: the suffix order of the dictionary
and that of the parse combine into the order of the whole text.

Both orders come from the same refinement: groups of equal keys are split by the
next key until nothing is tied (or the depth asked for is reached), touching only
what is still tied.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

TRIGGER, MODULUS_BITS = 8, 4
SYMBOLS = 7  # nine bits each: a byte plus one, or 0 for the end


def refine(n: int, key: Callable[[np.ndarray, int], np.ndarray], more: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Ranks of 0..n-1 by key(i, 0), key(i, 1), ...; equal only where more(i, t) ended without a difference."""
    rank, active, t = np.zeros(n, np.int64), np.arange(n), 0
    while len(active):
        k = key(active, t)
        order = np.lexsort((k, rank[active]))
        active, k = active[order], k[order]
        r = rank[active]
        at = np.arange(len(active))
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new = new_group.copy()
        new[1:] |= k[1:] != k[:-1]
        rank[active] = r + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        alone = new & np.concatenate([new[1:], [True]])
        active = active[~alone]
        t += 1
        active = active[more(active, t)]
    return rank


class Parse:
    """Strings laid end to end in `text`; string s is text[begins[s]:begins[s] + sizes[s]]."""

    def __init__(self, text: np.ndarray, sizes: np.ndarray):
        n = len(text)
        self.text, self.sizes = text, sizes
        self.begins = np.cumsum(sizes) - sizes
        padded = np.zeros(n + 16, np.uint8)
        padded[:n] = text
        self.padded = padded
        self.words = np.ndarray((n + 8,), "<u8", padded, strides=(1,)).astype(np.uint64)  # the 8 bytes from each place
        ends = self.begins + sizes
        hit = ((self.words[:n] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MODULUS_BITS)) == 0
        trigger = np.flatnonzero(hit)
        owner = np.searchsorted(ends, trigger, "right")
        inside = (trigger > self.begins[owner]) & (trigger + TRIGGER < ends[owner])
        trigger, owner = trigger[inside], owner[inside]
        # a phrase begins with its string or at a trigger, and runs to the end of the next trigger or string
        self.lo = np.sort(np.concatenate([self.begins[sizes > 0], trigger]))
        self.owner = np.searchsorted(ends, self.lo, "right")
        last = np.concatenate([self.owner[1:] != self.owner[:-1], [True]]) if len(self.lo) else np.zeros(0, bool)
        following = np.concatenate([self.lo[1:], [0]]) if len(self.lo) else self.lo
        self.last = last
        self.hi = np.where(last, ends[self.owner], following + TRIGGER)

    def dictionary(self, hashed: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(one occurrence of each distinct phrase, each occurrence's phrase)."""
        a, b = hashed(self.lo, self.hi)
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else np.zeros(0, bool)
        phrase = np.empty(len(order), np.int64)
        phrase[order] = np.cumsum(new) - 1
        return order[new], phrase

    def order(self, places: np.ndarray, depth: int, hashed) -> np.ndarray:
        """The given places of the text in the order of the text's suffixes there, to `depth` bytes at least."""
        entries, phrase = self.dictionary(hashed)
        base, top = self.lo[entries], self.hi[entries]
        of = np.searchsorted(self.lo, places, "right") - 1
        width = int((top - base).max()) + 1 if len(base) else 1
        code = phrase[of] * width + (places - self.lo[of])
        wanted, which = np.unique(np.concatenate([code, np.arange(len(entries)) * width]), return_inverse=True)
        d, offset = wanted // width, wanted % width
        start, end = base[d] + offset, top[d]
        rank = refine(len(wanted), lambda i, t: self._symbols(start[i] + SYMBOLS * t, end[i]), lambda i, t: start[i] + SYMBOLS * t <= end[i])
        alpha, whole = rank[which[: len(places)]], rank[which[len(places) :]]
        seq = whole[phrase]
        count = len(seq)
        stop = np.searchsorted(self.owner, self.owner, "right")  # end of each phrase's string in the parse
        reach = np.concatenate([self.lo, [len(self.text)]])

        def key(i: np.ndarray, t: int) -> np.ndarray:
            return np.where(i + t < stop[i], seq[np.minimum(i + t, count - 1)] + 1, 0)

        def more(i: np.ndarray, t: int) -> np.ndarray:
            return (i + t <= stop[i]) & (reach[np.minimum(i + t, count)] - reach[i] < depth)

        parse_rank = refine(count, key, more)
        follows = np.where(self.last[of], -1, parse_rank[np.minimum(of + 1, count - 1)])
        return np.lexsort((follows, alpha))

    def _symbols(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for j in range(SYMBOLS):
            p = at + j
            out = (out << 9) | np.where(p < end, self.padded[np.minimum(p, len(self.padded) - 1)].astype(np.int64) + 1, 0)
        return out

    def equal(self, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
        """Whether `length` (8 at least) bytes from x are those from y."""
        same = np.ones(len(x), bool)
        for off in [*range(0, length - 8, 8), length - 8]:
            same &= self.words[x + off] == self.words[y + off]
        return same


def repeats(text: np.ndarray, sizes: np.ndarray, window: int, rank_of: tuple[np.ndarray, ...], hashed) -> tuple[np.ndarray, np.ndarray]:
    """(string, place in it) of every window that also starts in an earlier place.

    rank_of: keys by which strings come one after the other (the first counts most,
    the last is the place in its document where the string begins). Strings must
    have a window at least.
    """
    parse = Parse(text, sizes)
    room = sizes - window + 1
    of = np.repeat(np.arange(len(sizes)), room)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(room) - room, room)
    places = parse.begins[of] + inside
    order = parse.order(places, window, hashed)
    x = places[order]
    group = np.concatenate([[0], np.cumsum(~parse.equal(x[:-1], x[1:], window))]) if len(x) else x
    many = np.bincount(group)[group] > 1 if len(x) else np.zeros(0, bool)
    order, group = order[many], group[many]
    if not len(order):
        return of[:0], inside[:0]
    begin = rank_of[-1][of[order]] + inside[order]
    sort = np.lexsort((begin, *(k[of[order]] for k in rank_of[-2::-1]), group))
    first = np.concatenate([[True], np.diff(group[sort]) != 0])
    later = order[sort[~first]]
    return of[later], inside[later]
