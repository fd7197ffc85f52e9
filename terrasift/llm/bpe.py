"""Byte-pair merges over many words at once, on flat numpy symbol arrays.

In each round every word that still has a known pair merges its pair of least rank, all its
occurrences from the left at once, as long as that is what a queue that takes one pair at a time
would do: a merge may create a pair that ranks before the next occurrence, and then the round
ends there for that word. The arrays are then compacted, and words without a pair leave.
"""

from __future__ import annotations

import numpy as np

NONE = np.int32(2**31 - 1)
#: Bytes of words that distinct() compares at once; positions take eight times as much.
COMPARED = 1 << 18


class Merges:
    """Known pairs: left and right symbol to rank and merged symbol. A hash table with one probe;
    the few keys that share a slot are in a sorted list beside it."""

    BITS = 19

    def __init__(self, left, right, rank, new):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        key = (left << 32) | right
        slot = self._slot(left, right)
        order = np.argsort(rank, kind="stable")
        self.key = np.full(1 << self.BITS, -1, np.int64)
        self.rank = np.full(1 << self.BITS, NONE, np.int32)
        self.new = np.zeros(1 << self.BITS, np.int32)
        self.crowded = np.zeros(1 << self.BITS, bool)
        _, at = np.unique(slot[order], return_index=True)
        main = order[at]
        self.key[slot[main]], self.rank[slot[main]], self.new[slot[main]] = key[main], np.asarray(rank)[main], np.asarray(new)[main]
        rest = np.setdiff1d(order, main)
        self.crowded[slot[rest]] = True
        by = rest[np.argsort(key[rest])]
        self.more_key, self.more_rank, self.more_new = key[by], np.asarray(rank, np.int32)[by], np.asarray(new, np.int32)[by]

    def _slot(self, a, b):
        h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a, b):
        """Ranks (NONE where unknown) and merged symbols. Symbols below 0 never merge."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        slot, key = self._slot(a, b), (a << 32) | (b & 0xFFFFFFFF)
        hit = (self.key[slot] == key) & (a >= 0) & (b >= 0)
        rank, new = np.where(hit, self.rank[slot], NONE), self.new[slot]
        look = np.flatnonzero(~hit & self.crowded[slot] & (a >= 0) & (b >= 0))
        if len(look) and len(self.more_key):
            at = np.minimum(np.searchsorted(self.more_key, key[look]), len(self.more_key) - 1)
            ok = self.more_key[at] == key[look]
            rank[look[ok]], new[look[ok]] = self.more_rank[at[ok]], self.more_new[at[ok]]
        return rank, new


def merge_rounds(sym: np.ndarray, lens: np.ndarray, table: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words laid end to end, and the words' lengths, to those after all merges."""
    wid = np.repeat(np.arange(len(lens)), lens)
    out_lens = lens.copy()
    done_sym, done_wid = [], []
    sym = sym.astype(np.int32)
    rank = np.full(len(sym), NONE, np.int32)
    if len(sym) > 1:
        near = np.flatnonzero(wid[1:] == wid[:-1])
        rank[near] = table.find(sym[near], sym[near + 1])[0]
    while len(sym):
        start = np.flatnonzero(np.r_[True, wid[1:] != wid[:-1]])
        size = np.diff(np.append(start, len(sym)))
        least = np.minimum.reduceat(rank, start)
        busy = least != NONE
        if not busy.all():
            keep = np.repeat(busy, size)
            done_sym.append(sym[~keep])
            done_wid.append(wid[~keep])
            ended = wid[start[~busy]]
            out_lens[ended] = size[~busy]
            sym, wid, rank, least, size = sym[keep], wid[keep], rank[keep], least[busy], size[busy]
            if not len(sym):
                break
        hit = _leftmost(rank, np.repeat(least, size))
        new = table.find(sym[hit], sym[hit + 1])[1]
        if len(hit) > len(size):  # some word has more than one
            until = _in_turn(hit, new, sym, wid, rank, table)
            hit, new = hit[until], new[until]
        sym[hit] = new
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        rank[hit] = NONE
        at = hit - np.arange(len(hit))  # one symbol has left before each later hit
        sym, wid, rank = sym[keep], wid[keep], rank[keep]
        left = at[(at > 0)] - 1
        left = left[wid[left] == wid[left + 1]]
        right = at[at + 1 < len(sym)]
        right = right[wid[right] == wid[right + 1]]
        both = np.concatenate([left, right])
        rank[both] = table.find(sym[both], sym[both + 1])[0]
    if not done_sym:
        return sym, out_lens
    sym, wid = np.concatenate(done_sym), np.concatenate(done_wid)
    return sym[np.argsort(wid, kind="stable")], out_lens


def _leftmost(rank: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Positions of the words' least pairs; of a run of overlapping ones every second, from its left end."""
    hit = np.flatnonzero(rank == least)
    fresh = np.r_[True, np.diff(hit) != 1]
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
    return hit[(np.arange(len(hit)) - run) % 2 == 0]


def _in_turn(hit, new, sym, wid, rank, table: Merges) -> np.ndarray:
    """Which hits merge in this round: a word's, from the left, through the first whose result makes a
    pair that ranks no later than the round's, since the queue would take that pair before the next hit."""
    w = wid[hit]
    joined = np.r_[False, (hit[1:] == hit[:-1] + 2) & (w[1:] == w[:-1])]  # right after the hit before, which has merged by then
    before = np.where(joined, np.r_[0, new[:-1]], sym[np.maximum(hit - 1, 0)])
    has_before = (hit > 0) & (wid[np.maximum(hit - 1, 0)] == w)
    after = np.minimum(hit + 2, len(sym) - 1)
    has_after = (hit + 2 < len(sym)) & (wid[after] == w)
    r1 = np.where(has_before, table.find(before, new)[0], NONE)
    r2 = np.where(has_after, table.find(new, sym[after])[0], NONE)
    ahead = np.minimum(r1, r2) <= rank[hit]
    if not ahead.any():
        return np.ones(len(hit), bool)
    seen = np.cumsum(ahead) - ahead
    first = np.r_[True, w[1:] != w[:-1]]
    return seen == seen[np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))]


def distinct(data: np.ndarray, at: np.ndarray, lens: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of words data[at : at + lens] with hashes h: positions of one of each distinct word, and for each
    word which of them it is. Words with one hash are compared in full, so the hash never decides."""
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    rep = one[which]
    other = np.flatnonzero(rep != np.arange(len(h)))
    wrong = lens[other] != lens[rep[other]]
    alike = np.flatnonzero(~wrong)
    upto = np.cumsum(lens[other[alike]])
    done = 0
    while done < len(alike):
        to = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + COMPARED, "right")))
        look = other[alike[done:to]]
        k = lens[look]
        unlike = data[ragged(at[look], k)] != data[ragged(at[rep[look]], k)]
        if unlike.any():
            wrong[alike[done:to][np.unique(np.repeat(np.arange(len(look)), k)[unlike])]] = True
        done = to
    if wrong.any():  # of one hash, but another word than its first
        own: dict = {}
        more = []
        for i in other[wrong].tolist():
            key = data[at[i] : at[i] + lens[i]].tobytes()
            if key not in own:
                own[key] = len(one) + len(more)
                more.append(i)
            which[i] = own[key]
        one = np.append(one, more)
    return one, which


def ragged(start: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+lens[0]-1, start[1].. and so on."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(start - (ends - lens), lens)
