"""Token counts by compiled finite-state transducers.

The tokenizer file is compiled into two machines, both deterministic transducers. The scanner
reads character classes; its transitions say whether a pre-token starts. Texts are cut into
chunks of equal length, each chunk's map from entry state to exit state is built for all chunks
at once, the maps are composed by a parallel prefix scan, and a second pass from the now known
entry states emits the starts. The word machine (word_machine.py) reads the words' bytes; its
transitions carry the number of tokens that a prefix gains, so a text's count is the sum of
what is emitted over it. No word is merged or hashed on the way.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .word_machine import WordMachine

CHUNK = 64
#: Character classes: white space, letter, number, other, apostrophe, and the letters of contractions ('s 't 'm 'd, 're 've, 'll).
SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, STMD, RV, L, E = range(9)
_LETTERS = (LETTER, STMD, RV, L, E)
#: States: nothing open, in letters, in others, after an opening apostrophe, after 'r or 'v, after 'l.
OUT, IN_LETTERS, IN_OTHERS, QUOTE, QUOTE_RV, QUOTE_L = range(6)
#: Emissions: a pre-token starts here; the one thought to start at the character before did not.
STARTS, UNDOES = 1, 2
#: Letters whose lower case Python's tables lack or choose by context.
LOWERED = {0x3A3: 0x3C3, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_ODD = re.compile("[" + "".join(map(chr, LOWERED)) + "]")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def scanner() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions, both [state, class]."""
    to, out = np.zeros((6, 9), np.uint8), np.zeros((6, 9), np.uint8)
    for c in range(9):
        home = {SPACE: OUT, NUMBER: OUT, OTHER: IN_OTHERS, APOSTROPHE: QUOTE}.get(c, IN_LETTERS)
        for s in range(6):
            to[s, c], out[s, c] = home, STARTS * (c != SPACE)
    for s in (IN_LETTERS, QUOTE_RV, QUOTE_L):
        for c in _LETTERS:
            out[s, c] = 0
    for c in (OTHER, APOSTROPHE):
        for s in (IN_OTHERS, QUOTE):
            to[s, c], out[s, c] = IN_OTHERS, 0
    to[QUOTE, STMD], out[QUOTE, STMD] = OUT, 0
    to[QUOTE, RV], to[QUOTE, L] = QUOTE_RV, QUOTE_L
    to[QUOTE_RV, E], out[QUOTE_RV, E] = OUT, UNDOES
    to[QUOTE_L, L], out[QUOTE_L, L] = OUT, UNDOES
    return to, out


def run_scanner(cls: np.ndarray, to: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Emission at each character, from state OUT."""
    n, states, classes = len(cls), *to.shape
    rows = max(1, -(-n // CHUNK))
    grid = np.zeros((rows, CHUNK), np.uint8)
    grid.ravel()[:n] = cls
    grid = np.ascontiguousarray(grid.T)
    flat = (to.astype(np.int64)).ravel().astype(np.uint8)
    maps = np.repeat(np.arange(states, dtype=np.uint8)[:, None], rows, 1)
    for j in range(CHUNK):
        maps = flat[maps * np.uint8(classes) + grid[j]]
    step = 1
    while step < rows:  # maps[:, k] becomes the map of all chunks up to k
        maps[:, step:] = np.take_along_axis(maps[:, step:], maps[:, :-step].copy(), 0)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = maps[OUT, :-1]
    emitted = np.empty((CHUNK, rows), np.uint8)
    emit = out.ravel()
    for j in range(CHUNK):
        at = state * np.uint8(classes) + grid[j]
        emitted[j] = emit[at]
        state = flat[at]
    return emitted.T.ravel()[:n]


class Counter:
    """Counts as the tokenizers library gives them for byte-level BPE with word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre, norm = spec["model"], spec["pre_tokenizer"]["pretokenizers"], spec["normalizer"]["normalizers"]
        if (model["type"], model["end_of_word_suffix"], pre[0].get("pattern"), [x["type"] for x in norm]) != ("BPE", "</w>", {"Regex": PATTERN}, ["NFC", "Replace", "Lowercase"]):
            raise ValueError("only lower-casing BPE with word ends and the known pattern is supported")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        ids = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(pairs)}  # of a repeated merge the last counts
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {x: chr(x) for x in plain} | {x: chr(256 + i) for i, x in enumerate(sorted({*range(256)} - {*plain}))}
        single = {x: ids[shown[x]] for x in range(256)} | {256 + x: ids[shown[x] + "</w>"] for x in range(256)}
        pieces = {t: (s,) for s, t in single.items()}
        for (a, b), (_, t) in sorted(rank.items(), key=lambda kv: kv[1]):
            pieces.setdefault(t, pieces[a] + pieces[b])
        self.words = WordMachine(pieces, rank, single)
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x20000, 0x110000):  # planes that have grown since the tokenizer's tables
            if (k := unicodedata.category(chr(c))[0]) in "LN":
                kinds[c] = LETTER if k == "L" else NUMBER
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x20000)]))
        for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for run in regex.findall(pattern, every):
                kinds[[ord(ch) for ch in run]] = k
        for chars, k in (("'", APOSTROPHE), ("stmd", STMD), ("rv", RV), ("l", L), ("e", E)):
            for ch in chars:
                kinds[ord(ch)] = k
        self.kinds = kinds
        self.to, self.out = scanner()

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        owner, parts = [], []
        for i, t in enumerate(texts):
            if self.special and "<|" in t and (found := self.special.findall(t)):
                total[i] += len(found)
                own = self.special.split(t)
            else:
                own = [t]
            for x in own:
                if x:
                    x = x if x.isascii() or unicodedata.is_normalized("NFC", x) else unicodedata.normalize("NFC", x)
                    parts.append((x.translate(LOWERED) if _ODD.search(x) else x).lower())
                    owner.append(i)
        if not parts:
            return total
        cp = np.frombuffer(" ".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begin = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
        cls = self.kinds[cp]
        emitted = run_scanner(cls, self.to, self.out)
        starts = emitted == STARTS
        starts[np.flatnonzero(emitted == UNDOES) - 1] = False
        at = np.flatnonzero(starts)
        if not len(at):
            return total
        starts = starts[cls != SPACE]
        cp, doc = cp[cls != SPACE], np.repeat(np.asarray(owner), np.diff(np.append(begin, len(cp))))[cls != SPACE]
        width = np.where(cp < 0x80, 1, np.where(cp < 0x800, 2, np.where(cp < 0x10000, 3, 4)))
        symbols = np.frombuffer(cp.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int16)
        ends = np.cumsum(width)
        symbols[ends[np.append(np.flatnonzero(starts)[1:], len(cp)) - 1] - 1] += 256  # the last byte of each word
        upto = np.append(0, np.cumsum(self.words.count(symbols)))[ends]
        before = np.append(0, upto)[np.searchsorted(doc, np.arange(len(texts)))]
        return total + np.append(0, upto)[np.searchsorted(doc, np.arange(len(texts)), "right")] - before


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", part_chars: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    No begin, end or added tokens; a special token's string inside a text counts one. Null is the
    empty text (0 tokens). One row for every row; null ids stay null. Other columns are not read.
    """
    def run(batches):
        c = counter(tokenizer)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, at = [], 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= part_chars):
                    size += len(texts[to])
                    to += 1
                n.append(c.count(texts[at:to]))
                at = to
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text",
                         f"cast(octet_length(coalesce(cast(`{text_col}` as string), '')) as long) as n_bytes").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
