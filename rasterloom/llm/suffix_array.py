"""Suffix arrays by induced sorting, in whole-array steps.

The text is an array of small integers that ends in a unique 0.  Suffixes are classified
as smaller (S) or larger (L) than their successor; leftmost S suffixes (LMS) cut the text
into substrings.  One induction sorts and names these; the string of their names is sorted by
recursion until every name is unique; and a last induction from the sorted LMS suffixes
gives the whole array.

**Induction.**  An L suffix reads a run of L values and then an LMS suffix, so its place follows
from the LMS suffix at its run's end, one value at a time: the suffixes whose run
is longest begin, each step moves one value to the left, shorter runs enter at
theirs, and a stable pass by that value keeps what is known of the values behind it.  S
suffixes follow alike from the L suffixes at their runs' ends.  A step handles the suffixes
whose runs reach it, so the work is the sum of the runs' lengths: linear where runs are bounded.
"""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor."""
    n = len(text)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(np.subtract(text[1:], text[:-1], dtype=np.int32))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), n)
    return step[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _by(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of small non-negative keys (few values sort by radix)."""
    return np.argsort(keys.astype(np.uint16) if most < 1 << 16 else keys, kind="stable")


def _runs_back(doubled: np.ndarray, most: int, ends: np.ndarray, runs: np.ndarray, end_last: bool) -> np.ndarray:
    """Suffixes of one type in order, from the suffixes at their runs' ends.

    ``ends`` lie in order and ``runs`` counts each one's run before it; ``doubled`` is twice
    the text.  At a value that two suffixes share, an end comes after a run's inside if ``end_last``, else before it.
    """
    order = np.zeros(0, np.int32)
    for k in range(int(runs.max(initial=0)), 0, -1):
        enter = ends[runs >= k] - np.int32(k)
        order = np.concatenate([order, enter])
        key = doubled[order + k]
        key[: len(order) - len(enter)] += 0 if end_last else 1
        key[len(order) - len(enter) :] += 1 if end_last else 0
        order = order[_by(key, 2 * most + 2)]
    return order[_by(doubled[order], 2 * most + 2)] if len(order) else order


def _induce(text: np.ndarray, doubled: np.ndarray, small: np.ndarray, lms: np.ndarray, values: int) -> np.ndarray:
    """The suffix array induced from LMS suffixes in the given order (the text's end is the first)."""
    n = len(text)
    before = np.arange(n, dtype=np.int32)
    last_small = np.maximum.accumulate(np.where(small, before, -1))
    last_large = np.maximum.accumulate(np.where(small, -1, before))
    lms = lms.astype(np.int32)
    # an LMS place has a run of L before it, back to the last S
    larger = _runs_back(doubled, values, lms, lms - 1 - np.where(lms > 0, last_small[lms - 1], 0), True)
    head = larger[(larger > 0) & small[larger - 1]]  # L places that end a run of S
    smaller = _runs_back(doubled, values, head, head - 1 - last_large[head - 1], False)
    count = np.bincount(text, minlength=values)
    count_l, count_s = np.bincount(text[larger], minlength=values), np.bincount(text[smaller], minlength=values)
    start = np.cumsum(count) - count
    array = np.empty(n, np.int32)
    array[0] = n - 1
    array[start[text[larger]] + np.arange(len(larger)) - (np.cumsum(count_l) - count_l)[text[larger]]] = larger
    array[(start + count_l)[text[smaller]] + np.arange(len(smaller)) - (np.cumsum(count_s) - count_s)[text[smaller]]] = smaller
    return array


def suffix_array(text: np.ndarray, values: int | None = None, levels: list[int] | None = None) -> np.ndarray:
    """Suffixes of ``text`` in order; ``levels`` receives the length of the string of each level of the recursion."""
    n = len(text)
    if levels is not None:
        levels.append(n)
    values = int(text.max()) + 1 if values is None else values
    small = types(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    if not len(lms):  # the text's end alone
        return np.zeros(1, np.int32)
    doubled = text.astype(np.int32) * 2
    # LMS suffixes by their first value alone induce the order of LMS substrings
    array = _induce(text, doubled, small, lms[_by(text[lms], values)], values)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by = array[is_lms[array]].astype(np.int64)
    number = np.zeros(n, np.int32)
    number[lms] = np.arange(len(lms), dtype=np.int32)
    length = np.r_[np.diff(lms) + 1, 1]
    size = length[number[by]]
    same = np.flatnonzero(size[1:] == size[:-1])
    k = 0
    equal = np.zeros(len(by), bool)
    while len(same):  # compares neighbours value by value; unequal ones and ended ones leave
        alike = text[by[same] + k] == text[by[same + 1] + k]
        same = same[alike]
        k += 1
        done = size[same] == k
        equal[same[done] + 1] = True
        same = same[~done]
    name_of = np.cumsum(~equal) - 1
    names = int(name_of[-1]) + 1
    if names < len(lms):
        reduced = np.zeros(len(lms), np.int32)  # the last LMS is the text's end, whose name 0 is unique
        reduced[number[by]] = name_of
        by = lms[suffix_array(reduced, names, levels)]
    return _induce(text, doubled, small, by, values)


def common_prefixes(text: np.ndarray, array: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each suffix, in text order, the length it shares with its predecessor in the array.

    A place whose predecessor is one behind its own predecessor's, with the same value
    before both, has one less than the place before; only the others are compared, and
    those up to ``most`` values (a multiple of eight is added).
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    p = np.arange(n)
    q = np.maximum(before, 0)
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1) & (text[:-1] == text[q[1:] - 1])
    own = np.flatnonzero(~chained & (before >= 0))
    padded = np.zeros(n + most + 16, np.uint8)
    padded[:n] = text
    words = np.ndarray((n + most + 8,), "<u8", padded.tobytes(), strides=(1,))
    length = np.zeros(n, np.int64)
    at, k = own, 0
    while len(at) and k <= most:
        x = words[at + k] ^ words[before[at] + k]
        ended = x != 0
        low = x[ended]
        bit = np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64)
        length[at[ended]] = k + bit // 8
        at = at[~ended]
        k += 8
        length[at] = k
    # chained places: one less than the last place that was compared, for each step since
    known = np.where(chained, -1, p)
    last = np.maximum.accumulate(known)
    return np.maximum(length[last] - (p - last), 0)
