"""Equal strings of fixed width among texts, by a two-stage sorted suffix array.

A suffix is *rising* if it is smaller than the suffix after it.  Only rising suffixes are sorted
directly; every other suffix starts with a larger or equal byte than its successor, so one scan
over the buckets of first bytes, from the smallest, puts it in place behind its successor.  Order
beyond ``width`` bytes does not matter here and ties may stand in any order.  Common prefixes of
neighbours, computed on the bytes, then show which strings are equal.

The texts stand one after another, each followed by a separator byte (0, flagged apart, so texts
may hold byte 0).  Only suffixes that start a wanted string, and those that their place is induced
from, are sorted at all.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers of the rolling and the mixing hash.
ROLL, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
PAD = 64


def mixed(values: np.ndarray) -> np.ndarray:
    out = (values ^ (values >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(32))


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from every position that has as many."""
    with np.errstate(over="ignore"):
        power, length, step = ROLL, 1, raw.astype(np.uint64) + np.uint64(1)
        done, done_length = None, 0
        while True:
            if width & length:  # what is done so far stands behind this part
                if done is None:
                    done = step
                else:
                    factor = np.uint64(pow(int(ROLL), done_length, 1 << 64))
                    count = len(step) - done_length
                    done = step[:count] * factor + done[length:length + count]
                done_length += length
            if done_length == width:
                return done[:len(raw) - width + 1]
            step, power, length = step[:-length] * power + step[length:], power * power, 2 * length


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of the ``width`` values from every position that has as many."""
    length = 1
    while 2 * length <= width:
        values, length = np.minimum(values[:-length], values[length:]), 2 * length
    rest = width - length
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def window_anchors(raw: np.ndarray, width: int, gram: int, slice_size: int = 1 << 17) -> np.ndarray:
    """For every window of ``width`` bytes the least hash of a gram in it; equal windows agree."""
    out = np.empty(max(0, len(raw) - width + 1), np.uint64)
    for low in range(0, len(out), slice_size):
        part = raw[low:low + slice_size + width - 1]
        with np.errstate(over="ignore"):
            least = sliding_least(mixed(rolling(part, gram)), width - gram + 1)
        out[low:low + slice_size] = least
    return out


def rising(codes: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; ``codes`` ends with the smallest."""
    step = np.zeros(len(codes), np.int8)
    step[:-1] = np.sign(codes[1:] - codes[:-1])
    step[-1] = -1
    # equal neighbours are as the next unequal ones
    at = np.where(step != 0, np.arange(len(codes)), len(codes) - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def sorted_directly(positions: np.ndarray, words: np.ndarray, same: np.ndarray,
                    width: int) -> np.ndarray:
    """Positions in the order of the ``width`` bytes from them.

    ``words`` are the eight bytes from each position as a number, ``same`` a hash of ``width`` bytes;
    groups whose members all agree in it need no more sorting.
    """
    key = words[positions].astype(np.uint64)
    order = np.argsort(key)
    positions, key = positions[order], key[order]
    head = np.empty(len(positions), bool)
    head[:1] = True
    head[1:] = key[1:] != key[:-1]
    done = 8
    active = np.arange(len(positions))  # slots of groups that may still be in disorder
    while done < width and len(active):
        group = np.cumsum(head[active]) - 1
        said = same[positions[active]]
        differs = np.zeros(group[-1] + 1, bool)
        differs[group[1:][(said[1:] != said[:-1]) & ~head[active][1:]]] = True
        keep = differs[group]
        active, group = active[keep], group[keep]
        if not len(active):
            break
        dense = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        more = words[positions[active] + done].astype(np.uint64) >> np.uint64(24)
        key = (dense.astype(np.uint64) << np.uint64(40)) | more
        order = np.argsort(key)
        positions[active], key = positions[active][order], key[order]
        head[active[1:]] = key[1:] != key[:-1]
        head[active[0]] = True
        done += 5
    return positions


def suffix_order(codes: np.ndarray, needed: np.ndarray, words: np.ndarray, same: np.ndarray,
                 width: int) -> np.ndarray:
    """The needed suffixes in the order of their first ``width`` bytes."""
    up = rising(codes)
    up[codes == 0] = True  # separators are given, in any order
    chosen = needed & up & (codes > 0)
    direct = sorted_directly(np.flatnonzero(chosen), words, same, width)
    limits = np.searchsorted(codes[direct], np.arange(int(codes.max()) + 2))
    induced: list[list[np.ndarray]] = [[] for _ in range(int(codes.max()) + 1)]
    result = []

    def induce(scanned: np.ndarray, code: int) -> np.ndarray:
        """Hands the predecessors of scanned suffixes to their buckets; returns this bucket's."""
        before = scanned[scanned > 0] - 1
        before = before[needed[before] & ~up[before]]
        first = codes[before]
        own = before[first == code]
        later = first != code
        before, first = before[later], first[later]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else ():
            induced[codes[part[0]]].append(part)
        return own

    induce(np.flatnonzero(needed & (codes == 0)), 0)
    for code in range(1, len(induced)):
        part, rounds = np.concatenate(induced[code]) if induced[code] else direct[:0], 0
        while len(part):
            result.append(part)
            part, rounds = induce(part, code), rounds + 1
            if rounds > width and len(part):
                # runs of one byte that are longer than the width: the rest of them is one tie
                rest = needed & ~up & (codes == code)
                for found in result[len(result) - rounds:]:
                    rest[found] = False
                part = np.flatnonzero(rest)
                result.append(part)
                induce(part, code)
                break
        part = direct[limits[code]:limits[code + 1]]
        if len(part):
            result.append(part)
            induce(part, code)
        induced[code] = []
    return np.concatenate(result) if result else direct


def common_prefixes(a: np.ndarray, b: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """Bytes that suffixes ``a`` and ``b`` share at the start, at most ``width``."""
    shared, alive = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, width, 8):
        differ = words[a[alive] + at].astype(np.uint64) ^ words[b[alive] + at].astype(np.uint64)
        equal = differ == 0
        rest = differ[~equal]
        zeros = np.zeros(len(rest), np.int64)
        for byte in range(7, 0, -1):  # leading zero bytes
            zeros += rest < (np.uint64(1) << np.uint64(8 * byte))
        shared[alive[~equal]] += zeros
        alive = alive[equal]
        shared[alive] += 8
    return np.minimum(shared, width)


def seen_earlier(text: np.ndarray, separators: np.ndarray, wanted: np.ndarray, doc: np.ndarray,
                 width: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string of ``width`` bytes at each wanted position also starts in a smaller doc;
    and which wanted position has the string first, in the smallest doc that has it.

    ``separators`` are ascending positions, the last one at the end; ``wanted`` positions ascend and
    their strings hold no separator; ``doc`` belongs to them.
    """
    if not len(wanted):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    codes = text.astype(np.int16) + 1
    codes[separators] = 0
    padded = np.concatenate([text, np.zeros(PAD, np.uint8)])
    padded[separators] = 0
    words = np.ndarray(len(text) + PAD - 8, ">u8", padded, strides=(1,))
    same = rolling(padded, width)[:len(text)]
    # wanted suffixes, and after them all that a falling one is induced from
    place = np.arange(len(text))
    needed = np.zeros(len(text), bool)
    needed[wanted] = True
    stops = rising(codes)
    stops[separators] = True
    last_wanted = np.maximum.accumulate(np.where(needed, place, -1))
    last_stop = np.maximum.accumulate(np.where(stops, place, -1))
    needed[1:] |= last_wanted[:-1] > last_stop[:-1]
    order = suffix_order(codes, needed, words, same, width)
    owner = np.full(len(text), -1, np.int64)
    owner[wanted] = np.arange(len(wanted))
    order = order[owner[order] >= 0]
    head = np.empty(len(order), bool)
    head[:1] = True
    head[1:] = common_prefixes(order[:-1], order[1:], words, width) < width
    mine = doc[owner[order]]
    starts = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    least = np.minimum.reduceat(mine, starts)[group]
    place = owner[order]
    first = np.minimum.reduceat(np.where(mine == least, place, len(wanted)), starts)[group]
    gone, where = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    gone[place], where[place] = mine > least, first
    return gone, where
