"""The words that a byte-level vocabulary's pre-tokenizer cuts, found in whole arrays.

The pre-tokenizer's pattern is, in order of preference, a contraction (``'s 't 're 've 'm
'll 'd``), letters, digits or other characters with a single space before them, and white
space without the character before the next word.  Where a word begins depends on the
classes of neighbouring characters alone, so all words of a batch are cut at once.  A match
that begins has no memory, so a long text may be cut block by block at any word.
"""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

from . import bytetext as B

LETTER, DIGIT, SPACE, OTHER = 1, 2, 3, 4
#: bytes of a text that are cut at a time
BLOCK = 1 << 20
#: a word's begin depends on no more bytes behind it than these (but for white space)
BEHIND = 12


@cache
def character_classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, points = "".join(map(chr, points)), np.array(points)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", DIGIT), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    return table


def classes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, class) of each character of UTF-8 ``data``."""
    table = character_classes()
    first = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[first]
    kind = table[lead]
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        at, b = first[wide], lead[wide].astype(np.int32)
        more = [np.r_[data, 0, 0, 0][at + k].astype(np.int32) & 63 for k in (1, 2, 3)]
        two = (b & 31) << 6 | more[0]
        three = (b & 15) << 12 | more[0] << 6 | more[1]
        four = (b & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2]
        kind[wide] = table[np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))]
    return first, kind


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the words of texts that lie one after the other in ``data``."""
    if not len(data):
        return np.zeros(0, np.int64)
    at, kind = classes(data)
    n = len(at)
    begins = np.zeros(n + 2, bool)  # characters that begin a text, or lie behind all
    begins[np.searchsorted(at, offsets)] = True
    begins[n:] = True
    before = np.r_[np.uint8(0), kind[:-1]]
    before[begins[:n]] = 0
    start = kind != before
    # the last character of white space before a word is a word, or is the word's own space
    last = np.flatnonzero((kind == SPACE) & ~begins[1 : n + 1] & (np.r_[kind[1:], 0] != SPACE))
    start[last] = True
    start[last[data[at[last]] == 0x20] + 1] = False
    mark = np.flatnonzero(data[at] == 0x27)
    mark = mark[start[mark] & ~begins[mark + 1]]
    if len(mark):
        lead = np.r_[data[at], 0, 0]
        one, two = lead[mark + 1], lead[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ~begins[mark + 2] & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
        size = np.where(short, 2, np.where(long, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        end = mark + size
        start[end[end < n]] = True
    return at[start]


def word_blocks(data: np.ndarray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, int]]:
    """(first bytes, end) of one text's words, block by block; a block holds a word at least."""
    whole = np.array([0])

    def aligned(at: int) -> int:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return at

    a = 0
    while a < len(data):
        b = aligned(min(len(data), a + most))
        found = word_starts(data[a:b], whole)
        if b == len(data):
            yield a + found, b
            return
        cut = int(found[found <= b - a - BEHIND][-1])
        if cut:
            yield a + found[found < cut], a + cut
            a += cut
            continue
        if len(found) > 1:
            yield np.array([a]), a + int(found[1])
            a += int(found[1])
            continue
        kind = classes(data[a:b])[1][-1]  # one word fills the block: look for its end
        while b < len(data):
            to = aligned(min(len(data), b + most))
            at, kinds = classes(data[b:to])
            other = np.flatnonzero(kinds != kind)
            if len(other):
                b += int(at[other[0]])
                break
            b = to
        if kind == SPACE and b < len(data):
            b = aligned(b - 1)  # its last character belongs to what follows
        yield np.array([a]), b
        a = b


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, which): words that differ, and each word's place among them.  Words cover ``data`` without gaps."""
    hashes = B.span_hash(B.prefix_hash(data), starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    other = first[which]
    wrong = size != size[other]
    shift = np.repeat(np.where(wrong, 0, starts[other] - starts), size)
    at = np.arange(len(shift)) + (starts[0] if len(starts) else 0)
    differs = np.flatnonzero(data[at] != data[at + shift])
    if len(differs):
        wrong[np.searchsorted(starts, at[differs], "right") - 1] = True
    alone = np.flatnonzero(wrong)  # words that share a hash with another: each for itself
    which[alone] = len(first) + np.arange(len(alone))
    return np.r_[first, alone], which


def gathered(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of lists ``which`` of lists that lie between offsets ``at``."""
    size = (at[1:] - at[:-1])[which]
    to = np.cumsum(size) - size
    return values[np.repeat(at[:-1][which] - to, size) + np.arange(int(size.sum()))], size


@contextlib.contextmanager
def without_gc() -> Iterator[None]:
    """Work that makes many strings and no cycles, without passes of the collector."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
