"""Column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

One symbol of every string is inserted per round, from the last symbol to the
first (Bauer, Cox and Rosone, 2013). A round knows the place of every string's
newest suffix. The symbol before it, met at that place in the transform, gives the
place of the next longer suffix: after all suffixes with smaller first symbols, in
the order of equal symbols. The columns (transform, common prefixes, owner of each
suffix) are read and written once per round, front to back, each to a new file.

Common prefixes follow from the round before: a suffix shares one symbol more with
its neighbour of the same first symbol than the least that lies between their
tails.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Columns of more bytes than this lie in a file that has no name and goes with the process.
IN_MEMORY = 64 << 20
END = 0
LENGTH_BITS = 32


def _column(n: int, kind: type) -> np.ndarray:
    if n * np.dtype(kind).itemsize <= IN_MEMORY:
        return np.empty(n, kind)
    return np.memmap(tempfile.TemporaryFile(), kind, "w+", shape=(n,))


def _merged(old: np.ndarray, stay: np.ndarray, at: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = _column(len(stay), old.dtype)
    out[stay] = old
    out[at] = new
    return out


def suffix_columns(flat: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of a collection: common prefix with the one before, owner and length of each.

    ``flat`` holds the strings' bytes one after another, ``starts`` where each begins
    and the last ends. Common prefixes are exact up to ``depth`` and not larger. An
    end sorts below every byte and equals no other end.
    """
    # No UTF-8 text holds the byte 255, so bytes and the end fit into eight bits; any other input gets sixteen.
    narrow = np.uint8 if not len(flat) or flat.max() < 255 else np.uint16
    symbols = flat.astype(narrow) + narrow(1)
    lengths = np.diff(starts)
    n = len(lengths)
    place = np.arange(n)  # of the newest suffix of each string; first the bare ends
    left = lengths.copy()

    def before(which: np.ndarray) -> np.ndarray:
        """The symbol before the newest suffix, or the end where the string is used up."""
        out = np.zeros(len(which), narrow)
        more = left[which] > 0
        rows = which[more]
        out[more] = symbols[starts[rows] + left[rows] - 1]
        return out

    transform = before(np.arange(n))
    common = np.zeros(n, np.uint8)
    # Owner and length of a suffix lie in one number, and so in one column.
    tag = np.arange(n, dtype=np.int64) << LENGTH_BITS
    live = np.flatnonzero(lengths)
    rounds = 0
    while len(live):
        rounds += 1
        total = len(transform)
        by_symbol = np.argsort(transform, kind="stable")
        rank = _column(total, np.int32 if total < 1 << 31 else np.int64)
        rank[by_symbol] = np.arange(total, dtype=rank.dtype)
        ends = int((transform == END).sum())
        k = rank[place[live]].astype(np.int64)
        # Suffixes that start with a symbol follow the n bare ends; ends in the transform start none.
        target = k - ends + n
        order = np.argsort(target, kind="stable")
        live, k, target = live[order], k[order], target[order]
        at = by_symbol[k]
        symbol = transform[at]
        previous = np.where(k > 0, by_symbol[np.maximum(k - 1, 0)], -1)
        same_before = (k > 0) & (transform[previous] == symbol)
        following = by_symbol[np.minimum(k + 1, total - 1)]
        same_after = (k + 1 < total) & (transform[following] == symbol)
        own = np.zeros(len(live), np.int64)
        own[same_before] = _least(common, previous[same_before], at[same_before]) + 1
        after = np.zeros(len(live), np.int64)
        after[same_after] = _least(common, at[same_after], following[same_after]) + 1
        left[live] -= 1
        stay = np.ones(total + len(live), bool)
        stay[target] = False
        transform = _merged(transform, stay, target, before(live))
        common = _merged(common, stay, target, np.minimum(own, depth).astype(np.uint8))
        common[target[same_after] + 1] = np.minimum(after[same_after], depth)
        tag = _merged(tag, stay, target, (live << LENGTH_BITS) + rounds)
        # Older suffixes moved; only the newest places are needed, those of strings that go on.
        place[live] = target
        live = live[left[live] > 0]
    return common, tag >> LENGTH_BITS, tag & ((1 << LENGTH_BITS) - 1)


def _least(common: np.ndarray, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """The least common prefix in each stretch ``after + 1 .. upto``."""
    if not len(after):
        return np.empty(0, np.int64)
    cuts = np.empty(2 * len(after), np.int64)
    cuts[0::2], cuts[1::2] = after + 1, upto + 1
    padded = np.append(common, np.uint8(255))  # a stretch may end with the column
    return np.minimum.reduceat(padded, cuts)[0::2].astype(np.int64)


def least_owner_values(flat: np.ndarray, starts: np.ndarray, width: int, values: np.ndarray) -> list[np.ndarray]:
    """For every string, per start of a ``width``-byte substring, the least value of all strings that contain it."""
    common, owner, size = suffix_columns(flat, starts, width)
    long = np.flatnonzero(size >= width)
    out = [np.empty(max(0, int(n) - width + 1), values.dtype) for n in np.diff(starts)]
    if not len(long):
        return out
    # Suffixes that share the first width bytes stand together, and none of the shorter ones among them.
    opens = np.flatnonzero(common[long] < width)
    least = np.minimum.reduceat(values[owner[long]], opens)
    of_suffix = np.repeat(least, np.diff(np.append(opens, len(long))))
    string, at = owner[long], np.diff(starts)[owner[long]] - size[long]
    order = np.argsort(string, kind="stable")
    string, at, of_suffix = string[order], at[order], of_suffix[order]
    bounds = np.searchsorted(string, np.arange(len(starts)))
    for i in range(len(starts) - 1):
        part = slice(bounds[i], bounds[i + 1])
        out[i][at[part]] = of_suffix[part]
    return out
