"""A deterministic transducer that counts the tokens of byte-pair merges, state by state.

Symbols are bytes, with 256 added for a word's last one. Of a word read so far, what a later symbol
can still change is told by its endings that begin some token: a state is the set of
(node of the tokens' trie, last token before that ending, tokens from there on). With the next
symbol the one token fits that ends there and that the merges leave beside the token before it;
the transition carries how many tokens more (or fewer) the prefix then has. A last symbol leads
back to the start. There are finitely many such states; those that occur are compiled when first met.

Texts run in chunks side by side. A chunk that holds a word's end maps every entry state to one
exit state, so the chunks' maps compose by one scan; a chunk inside a longer word is run again from
what the chunk before it leads to, all such chunks at once, until nothing changes.
"""

from __future__ import annotations

import numpy as np

CHUNK = 64
#: Compiled transitions kept; beyond that the machine starts over (states then are few again).
MOST = 6_000_000
_START = ((0, -1, 0),)


class WordMachine:
    """`pieces` are the tokens as tuples of symbols, `merges` maps pairs of tokens to (rank, token) and
    `single` a symbol to its token."""

    def __init__(self, pieces: dict[int, tuple], merges: dict, single: dict[int, int]):
        self.pieces, self.merges, self.single = pieces, merges, single
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, piece in pieces.items():
            node = 0
            for s in piece:
                if s not in self.child[node]:
                    self.child[node][s] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][s]
            self.token[node] = t
        self.fits: dict = {}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [_START]
        self.number: dict[tuple, int] = {_START: 0}
        self.known = 0
        self._table(1 << 16)

    def _table(self, size: int) -> None:
        self.keys = np.full(size, -1, np.int64)
        self.next = np.zeros(size, np.int32)
        self.more = np.zeros(size, np.int32)

    def _slots(self, key: np.ndarray) -> np.ndarray:
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def _place(self, key: np.ndarray, to: np.ndarray, more: np.ndarray) -> None:
        """Puts transitions into the open-addressed table; the keys are new and unlike."""
        slot = self._slots(key)
        while len(key):
            taken = self.keys[slot] >= 0
            _, first = np.unique(slot, return_index=True)
            win = np.zeros(len(key), bool)
            win[first] = True
            win &= ~taken
            self.keys[slot[win]], self.next[slot[win]], self.more[slot[win]] = key[win], to[win], more[win]
            key, to, more, slot = key[~win], to[~win], more[~win], (slot[~win] + 1) % len(self.keys)

    def merged(self, symbols: tuple) -> list[int]:
        """Tokens that the merges leave of symbols, one pair after another."""
        out = [self.single[s] for s in symbols]
        while len(out) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def beside(self, a: int, b: int) -> bool:
        """Whether tokens a (-1: none) and b stay as they are next to each other."""
        if (a, b) not in self.fits:
            both = (self.pieces[a] if a >= 0 else ()) + self.pieces[b]
            self.fits[a, b] = self.merged(both) == ([a, b] if a >= 0 else [b])
        return self.fits[a, b]

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, tokens more)."""
        ends = [(self.child[node][symbol], last, n) for node, last, n in self.states[state] if symbol in self.child[node]]
        fit = [(self.token[node], n) for node, last, n in ends if self.token[node] >= 0 and self.beside(last, self.token[node])]
        if len(fit) != 1:
            raise ValueError("these merges do not give every prefix one last token")
        token, more = fit[0][0], 1 - fit[0][1]
        if symbol >= 256:
            return 0, more
        new = tuple(sorted([(0, token, 0), *((node, last, n + more) for node, last, n in ends if self.child[node])]))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
        return self.number[new], more

    def _compile(self, key: np.ndarray) -> None:
        key = np.unique(key)
        got = [self.step(k >> 9, k & 511) for k in key.tolist()]
        to, more = (np.array(x, np.int32) for x in zip(*got))
        self.known += len(key)
        if 2 * self.known > len(self.keys):
            k, t, m = (a[self.keys >= 0] for a in (self.keys, self.next, self.more))
            self._table(4 * len(self.keys))
            self._place(k, t, m)
        self._place(key, to, more)

    def look(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (state.astype(np.int64) << 9) | symbol
        slot = self._slots(key)
        have = self.keys[slot]
        if (have == key).all():
            return self.next[slot], self.more[slot]
        left = np.flatnonzero(have != key)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            if len(free):
                self._compile(key[free])
                slot = self._slots(key)
                left = np.flatnonzero(self.keys[slot] != key)
                continue
            slot[left] = (slot[left] + 1) % len(self.keys)
            left = left[self.keys[slot[left]] != key[left]]
        return self.next[slot], self.more[slot]

    def _run(self, grid: np.ndarray, state: np.ndarray, more: np.ndarray | None = None, lanes: np.ndarray | None = None) -> np.ndarray:
        """Exit states of chunks (columns of grid, -1 beyond the end) from their entry states; counts by symbol into `more`."""
        for j in range(len(grid)):
            live = grid[j] >= 0
            if live.all():
                state, m = self.look(state, grid[j])
                if more is not None:
                    more[j, lanes] = m
                continue
            state = state.copy()
            at = np.flatnonzero(live)
            state[at], m = self.look(state[at], grid[j, at])
            if more is not None:
                more[j, lanes[at]] = m
        return state

    def count(self, symbols: np.ndarray) -> np.ndarray:
        """Tokens more at each symbol; each word's sum to its number of tokens."""
        if self.known > MOST:
            self._reset()
        n = len(symbols)
        rows = max(1, -(-n // CHUNK))
        grid = np.full(rows * CHUNK, -1, np.int16)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        ended = (grid >= 256).any(0)
        # What follows a chunk's last word end is run from the start state: the one exit that its map has.
        tail = grid.copy()
        last = CHUNK - 1 - np.argmax((grid >= 256)[::-1], 0)
        tail[(np.arange(CHUNK)[:, None] <= last[None, :]) & ended[None, :]] = -1
        leads = self._run(tail, np.zeros(rows, np.int32))
        entry = np.zeros(rows, np.int32)
        entry[1:] = leads[:-1]
        more = np.zeros((CHUNK, rows), np.int32)
        todo = np.arange(rows)
        while len(todo):
            out = self._run(grid[:, todo], entry[todo], more, todo)
            inner = ~ended[todo] & (todo + 1 < rows)  # others lead where they are known to
            to, out = todo[inner] + 1, out[inner]
            moved = entry[to] != out
            todo = to[moved]
            entry[todo] = out[moved]
        return more.T.ravel()[:n]
