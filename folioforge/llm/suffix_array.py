"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour; the leftmost S of each run are the LMS suffixes.
Their substrings are sorted by one induction and named; if names repeat, the string of names is sorted in turn, by the same
steps. From the sorted LMS suffixes the whole array is induced by one scan from either end. A scan goes on in batches: all
entries up to the first slot not yet filled are final, so what they induce is dealt out together, not one by one. A scan over n
entries takes a few times sqrt(n) batches on ordinary text, whatever the alphabet.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last, the sentinel, is S."""
    n = len(text)
    step = np.flatnonzero(np.append(text[:-1] != text[1:], True))  # ends of runs
    rising = np.ones(len(step), bool)
    rising[:-1] = text[step[:-1]] < text[step[:-1] + 1]
    return np.repeat(rising, np.diff(np.append(-1, step)))[:n]


def fill(slots: np.ndarray, at: np.ndarray, key: np.ndarray, takes: np.ndarray) -> None:
    """Scan `slots` from the left; each entry e with takes[e - 1] puts e - 1 into the next slot of its key's bucket.

    slots: entries, -1 where none is yet; at: the next slot of each bucket, moved on as slots fill. Every slot fills in the end.
    """
    low, n, look = 0, len(slots), 64
    while low < n:
        high = low
        while True:  # the first slot that is not filled
            part = slots[high : high + look] < 0
            k = int(part.argmax()) if len(part) else 0
            if len(part) and part[k]:
                high += k
                break
            high += len(part)
            if high >= n:
                break
            look *= 2
        look = max(64, (high - low) // 2)
        before = slots[low:high] - 1
        before = before[before >= 0]
        before = before[takes[before]]
        low = high
        if len(before):
            keys = key[before]
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(new, len(keys)))
            firsts = keys[new]
            slots[np.arange(len(keys)) + np.repeat(at[firsts] - new, sizes)] = before[order]
            at[firsts] += sizes


def induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The suffix array that follows from the LMS suffixes in the order given."""
    n = len(text)
    larger = ~smaller
    counts_l, counts_s, counts_m = (np.bincount(x, minlength=size) for x in (text[larger], text[smaller], text[lms]))
    # from the left: buckets of L suffixes, then the LMS suffixes of that letter; no other S suffix has a slot
    ends = (counts_l + counts_m).cumsum()
    slots = np.full(n if not len(lms) else int(ends[-1]), -1, np.int64)
    order = np.argsort(text[lms], kind="stable")
    letters = text[lms][order]
    first = counts_m.cumsum() - counts_m
    slots[(ends - counts_m)[letters] + np.arange(len(lms)) - first[letters]] = lms[order]
    fill(slots, ends - counts_m - counts_l, text, larger)
    is_l = larger[slots]
    # from the right: a bucket's S suffixes stand after its L suffixes; turned round, so that this scan runs from the left as well
    starts = n - (counts_l + counts_s).cumsum()
    back = np.full(n, -1, np.int64)
    held = slots[is_l][::-1]
    letters = text[held]
    last = counts_l[::-1].cumsum()[::-1] - counts_l
    back[(starts + counts_s)[letters] + np.arange(len(held)) - last[letters]] = held
    back[n - 1] = n - 1
    fill(back, starts.copy(), text, smaller)
    return back[::-1]


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """All suffixes of text in order. text: integers below size, the last of them 0 and the only 0."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = types(text)
    is_lms = np.append(False, smaller[1:] & ~smaller[:-1])
    lms = np.flatnonzero(is_lms)
    array = induce(text, smaller, lms, size)
    ordered = array[is_lms[array]]
    # name the LMS substrings: each reaches to the next LMS suffix, that one's first character included
    length = np.zeros(n, np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    left, right = ordered[:-1], ordered[1:]
    same = length[left] == length[right]
    live, k = np.flatnonzero(same), 0
    while len(live):
        live = live[length[left[live]] > k]
        off = text[left[live] + k] != text[right[live] + k]
        same[live[off]] = False
        live, k = live[~off], k + 1
    name = np.zeros(n, np.int64)
    name[ordered] = np.append(0, (~same).cumsum())
    names = name[lms]
    total = int(names.max()) + 1
    if total < len(lms):
        ordered = lms[suffix_array(names, total)]
    return induce(text, smaller, ordered, size)


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Permuted common prefixes, in text order: what each suffix shares with the one before it in the array, 0 for the first.

    text: small non-negative integers, with a last one of its own. Where a suffix and the one before it follow equal characters,
    theirs is one less than that of the suffix one place to the left; only the others are compared, four characters at a time.
    """
    n = len(text)
    words = np.ndarray(n, "<u8", np.concatenate([text, [0] * 4]).astype("<u2").tobytes(), 0, (2,))
    before = np.empty(n, np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    place = np.arange(n)
    follows = (place > 0) & (before > 0)
    follows[follows] = text[place[follows] - 1] == text[before[follows] - 1]
    own = np.flatnonzero(~follows)
    shared = np.zeros(n, np.int64)
    live, k = own[before[own] >= 0], 0
    while len(live):
        differ = words[live + k] ^ words[before[live] + k]
        ended = differ != 0
        at = differ[ended]
        shared[live[ended]] = k + (np.bitwise_count((at & (~at + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 4)
        live, k = live[~ended], k + 4
    origin = np.maximum.accumulate(np.where(follows, 0, place))
    return shared[origin] - (place - origin)
