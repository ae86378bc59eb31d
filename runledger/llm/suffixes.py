"""Suffix arrays by two-stage sorting, and equal strings found on them."""

from __future__ import annotations

import numpy as np


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i: i + len(text)]
    return out


def _sort_direct(word: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at `places` sorted by their first `depth` bytes, eight bytes a round, ties only."""
    order = places[np.argsort(word[places], kind="stable")]
    key = word[order]
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])) if len(order) else np.zeros(0, np.int64)
    n = len(word)
    live = np.arange(len(order))
    for at in range(8, depth, 8):
        g = group[live]
        same = g[1:] == g[:-1]
        live = live[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(live) else live
        if not len(live):
            break
        g, own = group[live], order[live]
        ahead = own + at
        key = np.where(ahead < n, word[np.minimum(ahead, n - 1)], 0)
        new = np.lexsort((key, g))
        own, key = own[new], key[new]
        order[live] = own
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        group[live] = live[fresh][np.cumsum(fresh) - 1]  # a group is named by the place of its first member
    return order


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte string, sorted by at least their first `depth` bytes.

    Suffixes that are smaller than their successors are sorted directly. Each of the others is one
    byte in front of a smaller suffix, so a scan of the buckets (one per first byte, upwards) meets the
    successors in order and appends the suffixes in front of them to their buckets.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    change = np.where(step != 0, np.arange(n - 1), n - 1)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = np.zeros(n, bool)
    smaller[:-1] = np.concatenate([step, [-1]])[change] > 0
    direct = _sort_direct(_words(text), np.flatnonzero(smaller), depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        front = part
        while len(front):  # runs of one byte induce within their bucket
            front = front[front > 0] - 1
            front = front[text[front] == c]
            out_part = [part, front]
            part = np.concatenate(out_part)
        bucket = np.concatenate([part, direct[cut[c]: cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        bounds = np.searchsorted(first[order], np.arange(c + 1, 257))
        for d in range(c + 1, 256):
            low, high = bounds[d - c - 1], bounds[d - c]
            if low < high:
                waiting[d].append(before[order[low:high]])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in `order` with the one before it, counted up to `depth` bytes (a multiple of 8)."""
    word, n = _words(text), len(text)
    common = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, depth, 8):
        a, b = order[live] + at, order[live - 1] + at
        inside = (a < n) & (b < n)
        x = np.where(inside, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], np.uint64(1 << 63))
        equal = x == 0
        common[live[equal]] = at + 8
        high = x[~equal]
        bits = np.zeros(len(high), np.int64)
        for shift in (32, 16, 8):  # whole equal bytes at the front
            zero = (high >> np.uint64(64 - shift)) == 0
            bits += np.where(zero, shift, 0)
            high = np.where(zero, high << np.uint64(shift), high)
        common[live[~equal]] = at + bits // 8
        live = live[equal]
    room = n - np.maximum(order, np.concatenate([order[:1], order[:-1]]))
    return np.minimum(common, room) if len(order) else common


def repeated(text: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place: does its string of `length` bytes start at another place too? And is it the first of its kind?"""
    wanted = np.zeros(len(text), bool)
    wanted[places] = True
    order = suffix_array(text, length)
    order = order[wanted[order]]
    same = common_prefixes(text, order, length) >= length
    again = same | np.concatenate([same[1:], [False]]) if len(same) else same
    flags = np.zeros((2, len(text)), bool)
    flags[0, order], flags[1, order] = again, ~same
    return flags[0, places], flags[1, places]
