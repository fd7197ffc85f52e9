"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model file is read by a small protobuf reader; the library itself is not used here (the
tests compare with it). Texts are cut where no piece can cross (before a run of spaces), each
batch's distinct words are merged once, and ids are laid out for all texts by index arithmetic.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, distinct, merge_rounds, ragged
from .common import BYTE_VALUE, PART_BYTES, mix64, powers, text_parts

SPACE_MARK = "▁"
_NORMAL, _BYTE = 1, 6


def _varint(b: bytes, i: int):
    x = s = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << s
        if c < 128:
            return x, i
        s += 7


def _fields(b: bytes):
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        yield tag >> 3, v


class Codec:
    """encode() and decode() as the library does for BPE models with byte fallback, the identity
    normaliser, a dummy prefix and no removal of extra white space; others are refused."""

    def __init__(self, path: str):
        pieces, scores, kinds = [], [], []
        trainer, normaliser = {}, {}
        for n, v in _fields(open(path, "rb").read()):
            if n == 1:
                f = dict(_fields(v))
                pieces.append(f[1].decode())
                scores.append(float(np.frombuffer(f[2], np.float32)[0]) if 2 in f else 0.0)
                kinds.append(f.get(3, _NORMAL))
            elif n == 2:
                trainer = dict(_fields(v))
            elif n == 3:
                normaliser = dict(_fields(v))
        if trainer.get(3) != 2 or not trainer.get(35, 0) or normaliser.get(2) or not normaliser.get(3, 1) or normaliser.get(4, 1) or 4 in kinds:
            raise ValueError("only BPE models with byte fallback, identity normaliser and dummy prefix are supported")
        self.bos, self.eos = pieces.index("<s>"), pieces.index("</s>")
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == _NORMAL}
        self.byte_id = np.zeros(256, np.int32)
        for i, p in enumerate(pieces):
            if kinds[i] == _BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        left, right, rank, new = [], [], [], []
        for p, i in normal.items():
            if SPACE_MARK in p.lstrip(SPACE_MARK):
                raise ValueError("a piece crosses a word boundary")
            for k in range(1, len(p)):
                if p[:k] in normal and p[k:] in normal:
                    left.append(normal[p[:k]])
                    right.append(normal[p[k:]])
                    rank.append(order[scores[i]])
                    new.append(i)
            if len(p) > 1 and not all(c in normal for c in p):
                raise ValueError("a piece has a character that is no piece")
        self.merges = Merges(left, right, np.array(rank, np.int32), np.array(new, np.int32))
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.char_id[32] = self.char_id[ord(SPACE_MARK)]
        raw = [b"" if k not in (_NORMAL, _BYTE) else bytes([int(p[3:5], 16)]) if k == _BYTE else p.replace(SPACE_MARK, " ").encode() for p, k in zip(pieces, kinds)]
        self.piece_len = np.array([len(x) for x in raw], np.int64)
        self.piece_start = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)

    def _words(self, data: np.ndarray, lens: np.ndarray):
        """ids of words laid end to end in data, flat, and the number of each."""
        text = data.tobytes().decode()
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        heads = (data & 0xC0) != 0x80
        ends = np.cumsum(lens)
        chars = np.add.reduceat(heads.astype(np.int64), ends - lens) if len(lens) else lens
        sym = self.char_id[cp]
        sym = np.where(sym < 0, -1 - cp, sym).astype(np.int32)
        sym, n = merge_rounds(sym, chars, self.merges)
        if not (sym < 0).any():
            return sym, n
        c = np.where(sym < 0, -1 - sym.astype(np.int64), 0)
        width = np.where(sym >= 0, 1, np.where(c < 0x80, 1, np.where(c < 0x800, 2, np.where(c < 0x10000, 3, 4))))
        word = np.repeat(np.arange(len(n)), n)
        nth = ragged(np.zeros(len(sym), np.int64), width)
        c, wide, s = np.repeat(c, width), np.repeat(width, width), np.repeat(sym, width)
        byte = (c >> (6 * (wide - 1 - nth))) & 0x3F
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[wide]
        byte = np.where(wide == 1, c & 0x7F, np.where(nth == 0, byte | lead, byte | 0x80))
        return np.where(s >= 0, s, self.byte_id[byte & 0xFF]).astype(np.int32), np.bincount(word, width, len(n)).astype(np.int64)

    def encode_part(self, data: np.ndarray, offs: np.ndarray):
        """Flat ids of rows (without begin and end) and the number of each row's."""
        mark = SPACE_MARK.encode()
        if mark in (raw := data.tobytes()):
            rows = [raw[a:b].replace(mark, b" ") for a, b in zip(offs[:-1], offs[1:])]
            data = np.frombuffer(b"".join(rows), np.uint8)
            offs = np.append(0, np.cumsum([len(r) for r in rows]))
        size = np.diff(offs)
        filled = size > 0
        if not filled.any():
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        start = offs[:-1] + np.cumsum(filled) - filled  # with a space before each row that isn't empty
        buf = np.full(len(data) + int(filled.sum()), 32, np.uint8)
        mask = np.ones(len(buf), bool)
        mask[start[filled]] = False
        buf[mask] = data
        blank = buf == 32
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[start[filled]] = True
        at = np.flatnonzero(first)
        lens = np.diff(np.append(at, len(buf)))
        pos = np.arange(len(buf)) - np.repeat(at, lens)
        h = mix64(np.add.reduceat(BYTE_VALUE[buf] * powers(int(lens.max()))[pos], at) + lens.astype(np.uint64))
        one, which = distinct(buf, at, lens, h)
        ids, n = self._words(buf[ragged(at[one], lens[one])], lens[one])
        begin = np.cumsum(n) - n
        out = ids[ragged(begin[which], n[which])]
        row = np.searchsorted(start[filled], at, "right") - 1
        counts = np.zeros(len(size), np.int64)
        counts[filled] = np.bincount(row, n[which], int(filled.sum())).astype(np.int64)
        return out, counts

    def decode_flat(self, ids: np.ndarray) -> bytes:
        """One row's ids to its bytes: pieces end to end, less the dummy prefix."""
        got = self.piece_bytes[ragged(self.piece_start[ids], self.piece_len[ids])].tobytes()
        return got[1:] if got[:1] == b" " else got

    def encode(self, text: str) -> list[int]:
        b = (text or "").encode()
        ids, _ = self.encode_part(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
        return [self.bos, *ids.tolist(), self.eos]

    def decode(self, ids) -> str:
        return self.decode_flat(np.asarray(ids, np.int64)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (and the ids, if asked for).

    ids have begin and end; null is the empty text; ids null where the id is. Every row gives one
    row, in any number, repeated rows too. `model` is a path that every executor can open.
    """
    def run(batches):
        c = codec(model)
        edge = [np.array([x], "<u4").tobytes() for x in (c.bos, c.eos)]
        for batch in batches:
            text = batch.column(1)
            n_all, a_all, b_all, ids_all = [], [], [], []
            for _, data, offs in text_parts(text, 2 * PART_BYTES):
                ids, counts = c.encode_part(data, offs)
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                for e, k in zip(ends.tolist(), counts.tolist()):
                    one = wide[e - k : e]
                    n_all.append(k + 2)
                    a_all.append(hashlib.sha256(edge[0] + one.tobytes() + edge[1]).hexdigest())
                    b_all.append(hashlib.sha256(c.decode_flat(one)).hexdigest())
                    if with_ids:
                        ids_all.append([c.bos, *one.tolist(), c.eos])
            cols = [batch.column(0), pa.array(n_all, pa.int64()), pa.array(a_all, pa.string()), pa.array(b_all, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids_all, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text").mapInArrow(run, schema)
