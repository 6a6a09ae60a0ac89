"""Blockwise suffix sorting with a difference-cover sample, to a fixed depth, on the bytes that a task holds.

A difference cover of a period v is a set of residues in which every difference modulo v occurs: for any two
places i and j there is a step d < v that brings both to sample places, those whose place in their string has
a residue of the cover. The sample is ranked first: blocks of v bytes are sorted and named, and names of twice
the depth come from pairs of names, up to `depth` bytes. Then the suffixes are sorted by their first bytes, one bucket
of equal beginnings after the other, so that only one bucket's order is held at a time. Suffixes that agree in their
first v and their last `tail` bytes are long ties: two of them are equal over the whole length if and only if
the samples d bytes further on have the same rank, d being the step of their two residues.
"""

from __future__ import annotations

import numpy as np

# Perfect difference sets, by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Suffixes that a bucket takes before it is closed at the next change of the first bytes.
BUCKET = 1 << 17


def period_for(length: int) -> int:
    """The longest period of which a window of this length holds three blocks."""
    return max((v for v in COVERS if 3 * v <= length), default=0)


def _words(data: np.ndarray, shift: int, size: int):
    """Functions of places: the `size` bytes from shift bytes after them as big-endian words, whose order is that of the bytes."""
    word = np.ndarray(len(data) - 7, ">u8", data.data, 0, (1,))
    if size < 8:
        return [lambda at: word[at + shift].astype(np.uint64) >> np.uint64(8 * (8 - size))]
    return [lambda at, step=step: word[at + shift + step].astype(np.uint64) for step in [*range(0, size - 8, 8), size - 8]]


def _named(*keys: np.ndarray) -> np.ndarray:
    """Ranks of rows of keys, the first key foremost; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def cover_ranks(padded: np.ndarray, local: np.ndarray, room: np.ndarray, period: int, blocks: int) -> np.ndarray:
    """At each sample place with room for `blocks` blocks the rank of its first blocks * period bytes, else -1."""
    n = len(local)
    sample = np.flatnonzero(np.isin(local % period, COVERS[period]) & (room >= period))
    rank = np.full(n, -1, np.int64)
    rank[sample] = _named(*(word(sample) for word in _words(padded, 0, period)))

    def both(a: np.ndarray, b: np.ndarray, first: int, whole: int) -> np.ndarray:
        at = sample[room[sample] >= whole * period]
        out = np.full(n, -1, np.int64)
        out[at] = _named(a[at], b[at + first * period])
        return out

    power, by_power = 1, {1: rank}
    while 2 * power <= blocks:
        by_power[2 * power] = both(by_power[power], by_power[power], power, 2 * power)
        power *= 2
    done, rank = power, by_power[power]
    while done < blocks:
        more = 1 << ((blocks - done).bit_length() - 1)
        rank, done = both(rank, by_power[more], done, done + more), done + more
    return rank


def repeated_windows(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, length: int, bucket: int = BUCKET) -> np.ndarray:
    """For each place of data: whether the `length` bytes from there, inside one of the strings data[begins:ends], are also at another place.

    The strings lie one behind the other and fill data.
    """
    n = len(data)
    out = np.zeros(n, bool)
    sizes = ends - begins
    room = np.repeat(ends, sizes) - np.arange(n)
    window = np.flatnonzero(room >= length)
    if len(window) < 2:
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    local = np.arange(n) - np.repeat(begins, sizes)
    period = period_for(length)
    if period:
        blocks = (length - period + 1) // period
        ranks = cover_ranks(padded, local, room, period, blocks)
        tail = length - blocks * period
    head = period or length
    first = _words(padded, 0, min(head, 8))[0](window)
    order = np.argsort(first, kind="stable")
    change = np.flatnonzero(first[order[1:]] != first[order[:-1]]) + 1
    cuts, at = [0], 0
    while at < len(order):  # whole runs of equal beginnings, `bucket` suffixes or a little more
        k = int(np.searchsorted(change, at + bucket))
        at = int(change[k]) if k < len(change) else len(order)
        cuts.append(at)
    keys = _words(padded, 0, head) + (_words(padded, length - tail, tail) if period else [])
    for lo, hi in zip(cuts, cuts[1:]):
        own = window[order[lo:hi]]
        group = np.zeros(len(own), np.int64)
        for key in keys:  # those that are alone after some bytes are done
            own, group = _tied(own, _named(group, key(own)))
            if not len(own):
                break
        if not len(own):
            continue
        if not period:
            out[own] = True
            continue
        steps = [(c - local[own]) % period for c in COVERS[period]]
        keyed = np.concatenate([(group * period + d) * (n + 1) + ranks[own + d] + 1 for d in steps])
        _, which, counts = np.unique(keyed, return_inverse=True, return_counts=True)
        out[own[(counts[which] > 1).reshape(len(steps), -1).any(axis=0)]] = True
    return out


def _tied(own: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What isn't alone in its group."""
    several = np.bincount(group)[group] > 1
    return own[several], group[several]
