"""Repeated byte strings by a depth-limited radix sort of sampled suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Suffixes are
sorted only as deep as that takes, by passes from the most significant digit on:

* Sampling. In every window of LENGTH bytes the K-gram of least hash (the leftmost of equals) is
  the window's anchor; equal windows have equal anchors at equal places. Consecutive windows with
  one anchor form a bundle, so one row stands for about (LENGTH - K) / 2 suffixes.
* Pass 0 groups anchors by their K-gram and, in it, bundles by all their bytes. A K-gram that
  occurs once ends its suffixes. Equal bundles are repeated through and through.
* Passes of 64, 8 and 1 suffixes (DIGITS) refine what is left: a bundle's suffixes are split on a
  fixed grid around the anchor; a block's core, the bytes common to its windows, is the next digit
  (LENGTH - 63, LENGTH - 7, LENGTH bytes deep). Groups of one member drop out; blocks that agree
  in all their bytes are repeated; the others go on. After the last pass, whose digit is the window
  itself, equal groups are exactly the repeated windows.

Groups are formed by counting with partial aggregation and by joins that adaptive execution can
split, so a passage in a third of all texts gathers nowhere. Equal members of a group send one of
them on. Groups are compared by 128 bits of hash.

The same passes run over words: WORDS of them in a row that also start anywhere else are a repeated
passage, whatever its bytes. That is reported beside the removal and removes nothing.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .bpe import ragged
from .common import BYTE_VALUE, STEP, Table, mix64, powers, text_parts, words

LENGTH, K = 400, 96
DIGITS = (64, 8, 1)
#: Of passages, in words: the window, its K-gram and the digits.
WORDS, WORDS_K = 50, 12
WORD_DIGITS = (8, 1)
_inverse = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        n = max(n, 2 * len(_inverse))
        _inverse = np.full(n, np.uint64(pow(int(STEP), -1, 1 << 64)), np.uint64)
        _inverse[0] = 1
        np.multiply.accumulate(_inverse, out=_inverse)
    return _inverse


def byte_symbols(column: pa.Array):
    """Yields (first row, a value for each symbol, the symbols' bytes, offsets) over runs of rows; symbols are bytes."""
    for at, data, offs in text_parts(column):
        yield at, BYTE_VALUE[data], data.tobytes(), offs


def word_symbols(column: pa.Array):
    """The same of words: runs of bytes other than ASCII white space, A-Z lowered, of which a hash of 8 bytes stands for each."""
    for at, data, offs in text_parts(column):
        h, _, _, row = words(data, offs)
        yield at, h, h.astype("<u8").tobytes(), np.searchsorted(row, np.arange(len(offs)))


#: (symbols of texts, bytes of a symbol, digits)
BYTES, PASSAGES = (byte_symbols, 1, DIGITS), (word_symbols, 8, WORD_DIGITS)


def anchors(values: np.ndarray, offs: np.ndarray, length: int = LENGTH, k: int = K):
    """Row, anchor, first and last window start (all within values) and K-gram hash of each bundle."""
    size = np.diff(offs)
    rows = np.flatnonzero(size >= length)
    z = np.zeros(0, np.int64)
    if not len(rows):
        return z, z, z, z, np.zeros(0, np.uint64)
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(n)[:n], out=sums[1:])
    h = mix64((sums[k:] - sums[:-k]) * _inverse_powers(n)[: n - k + 1])
    low = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    per = size[rows] - length + 1
    start = ragged(offs[:-1][rows], per)
    row = np.repeat(rows, per)
    at = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    last = np.append(first[1:], len(at)) - 1
    return row[first], at[first], start[first], start[last], h[at[first]]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _sample(kind: tuple, length: int, k: int):
    symbols, width, _ = kind

    def run(batches):
        for batch in batches:
            d1, d2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for at, values, raw, offs in symbols(batch.column(0)):
                row, p, s1, s2, hk = anchors(values, offs, length, k)
                if not len(row):
                    continue
                raw, base = memoryview(raw), offs[row]
                hh = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((width * s1).tolist(), (width * (s2 + length)).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1[at + row]), pa.array(d2[at + row]), *(pa.array((x - base).astype(np.int32)) for x in (p, s1, s2)), _signed(hk), _signed(hh)],
                    ["d1", "d2", "p", "s1", "s2", "hk", "hh"])
    return run


def _contexts(kind: tuple, length: int):
    symbols, width, _ = kind

    def run(batches):
        for batch in batches:
            spots = batch.column(1)
            out: list[list] = [[] for _ in range(6)]
            for at, _, raw, offs in symbols(batch.column(0)):
                raw = memoryview(raw)
                for i, base in enumerate(offs[:-1].tolist()):
                    for s in spots[at + i].as_py():
                        ctx = bytes(raw[width * (base + s["s1"]) : width * (base + s["s2"] + length)])
                        for o, x in zip(out, (s["hk"], s["hh"], s["p"] - s["s1"], s["s2"] - s["s1"], s["open"], ctx)):
                            o.append(x)
            q = np.array(out[2], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(q), pa.array(q - np.array(out[3], np.int32)), pa.array(q), pa.array(out[4], pa.bool_()), pa.array(out[5], pa.binary())],
                ["hk", "hh", "q", "lo", "hi", "open", "ctx"])
    return run


def _digits(kind: tuple, length: int, b: int):
    """Rows of the blocks of b suffixes of each open or providing range lo..hi; o counts symbols from a window's start to its anchor."""
    w = kind[1]

    def run(batches):
        for batch in batches:
            hk, hh, q, lo, hi, op = (batch.column(c).to_pylist() for c in ("hk", "hh", "q", "lo", "hi", "open"))
            out: list[list] = [[] for _ in range(7)]
            for i, ctx in enumerate(batch.column("ctx").to_pylist()):
                ctx = memoryview(ctx)
                for j in range(lo[i] // b, hi[i] // b + 1):
                    o1, o2 = max(lo[i], j * b), min(hi[i], j * b + b - 1)
                    core = q[i] - j * b
                    out[0].append(hk[i])
                    out[1].append(hh[i])
                    out[2].append(o1)
                    out[3].append(o2)
                    out[4].append(op[i])
                    out[5].append(xxhash.xxh3_64_intdigest(ctx[w * core : w * (core - b + 1 + length)], j * 128 + b))
                    out[6].append(xxhash.xxh3_64_intdigest(ctx[w * (q[i] - o2) : w * (q[i] - o1 + length)], o1 * 4096 + o2 + (1 << 40)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32()), pa.array(out[4], pa.bool_()), _signed(out[5]), _signed(out[6])],
                ["hk", "hh", "o1", "o2", "open", "c", "h"])
    return run


def _free(spark) -> None:
    """Shuffle files go when the JVM collects the plans that made them; without this that may be long after their last use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _marks(docs: DataFrame, kind: tuple, length: int, k: int) -> DataFrame:
    """(d1, d2, spans): for each distinct text with repeated windows, the ranges of symbols they cover, unordered and overlapping."""
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= (length if kind is BYTES else 2 * length - 1)).withColumn("rid", F.coalesce("doc_id", F.lit(-1)))
    a = Table(texts.select("text", "d1", "d2").mapInArrow(_sample(kind, length, k), "d1 long, d2 long, p int, s1 int, s2 int, hk long, hh long"), "anchors")
    kept = Table(a.df.groupBy("hk").count().where("count > 1").select("hk"), "anchor-keys")
    s = Table(a.df.join(kept.df, "hk"), "bundles")
    a.drop()
    kept.drop()
    groups = Table(s.df.groupBy("hk", "hh").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "d2", "p", "s1", "s2")).alias("at")), "bundle-groups")
    same = Table(groups.df.where("n > 1").select("hk", "hh"), "bundle-same")
    marks = [s.df.join(same.df, ["hk", "hh"]).select("d1", "d2", F.col("s1").alias("a"), (F.col("s2") + length).alias("b")).distinct()]
    # K-grams with unlike bundles, of which one at least is not known to be repeated, go on.
    mixed = Table(groups.df.groupBy("hk").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("hk"), "mixed")
    going = Table(groups.df.join(mixed.df, "hk").select("hk", "hh", (F.col("n") == 1).alias("open"), "at.*"), "going")
    groups.drop()
    mixed.drop()
    spots = going.df.groupBy("d1", "d2").agg(F.collect_list(F.struct("hk", "hh", "p", "s1", "s2", "open")).alias("spots"))  # a text's own anchors
    lender = texts.groupBy("d1", "d2").agg(F.min("rid").alias("rid"))  # of a text's copies one is read
    spots = Table(spots.join(lender, ["d1", "d2"]), "spots")
    one = texts.select("d1", "d2", "rid", "text").join(spots.df, ["d1", "d2", "rid"])
    contexts = Table(one.select("text", "spots").mapInArrow(_contexts(kind, length), "hk long, hh long, q int, lo int, hi int, open boolean, ctx binary"), "contexts")
    spots.drop()
    del one
    _free(spark)
    parents = contexts.df
    for b in (b for b in kind[2] if b == 1 or 2 * b <= length):
        rows = parents.mapInArrow(_digits(kind, length, b), "hk long, hh long, o1 int, o2 int, open boolean, c long, h long")
        rows = Table(rows, f"digit-{b}")
        g = Table(rows.df.groupBy("c", "h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("open", "hk", "hh", "o1", "o2")).alias("rep")), f"groups-{b}")
        twice = Table(g.df.where("n > 1").select("c", "h"), f"same-{b}")
        found = rows.df.where("open").join(twice.df, ["c", "h"]).select("hk", "hh", "o1", "o2")
        marks.append(found.join(going.df, ["hk", "hh"]).select("d1", "d2", (F.col("p") - F.col("o2")).alias("a"), (F.col("p") - F.col("o1") + length).alias("b")))
        if b == 1:
            break
        left = F.col("rep.open") & (F.col("n") == 1)
        cores = Table(g.df.groupBy("c").agg(F.count(F.lit(1)).alias("kinds"), F.max(left).alias("some")).where("kinds > 1 and some").select("c"), f"cores-{b}")
        nxt = g.df.join(cores.df, "c").select("rep.hk", "rep.hh", F.col("rep.o1").alias("lo"), F.col("rep.o2").alias("hi"), left.alias("open"))
        parents = nxt.join(contexts.df.select("hk", "hh", "q", "ctx"), ["hk", "hh"])
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    return Table(every.groupBy("d1", "d2").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "marks").df


def _merged(many) -> list[list[int]]:
    """Overlapping and touching ranges (a list of structs a, b, or null) made one, in order."""
    merged: list[list[int]] = []
    if many.is_valid:
        st = many.values
        got = np.stack([st.field("a").to_numpy(), st.field("b").to_numpy()], 1)
        for x, y in got[np.argsort(got[:, 0], kind="stable")].tolist():
            if merged and x <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], y)
            else:
                merged.append([x, y])
    return merged


def _cut(with_spans: bool):
    def run(batches):
        for batch in batches:
            n_bytes, gone, runs, sha, spans, said = [], [], [], [], [], []
            for t, many, passages in zip(batch.column(1), batch.column(2), batch.column(3)):
                raw = (t.as_py() or "").encode()
                merged = _merged(many)
                keep, at = hashlib.sha256(), 0
                for x, y in merged:
                    keep.update(raw[at:x])
                    at = y
                keep.update(raw[at:])
                n_bytes.append(len(raw))
                gone.append(sum(y - x for x, y in merged))
                runs.append(len(merged))
                sha.append(keep.hexdigest())
                said.append(sum(y - x for x, y in _merged(passages)))
                spans.append([{"start": x, "stop": y} for x, y in merged])
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, gone, runs)), pa.array(sha, pa.string()), pa.array(said, pa.int64())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words"]
            if with_spans:
                cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names)
    return run


def remove_repeats(df: DataFrame, length: int = LENGTH, k: int = K, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False,
                   n_words: int = WORDS, words_k: int = WORDS_K) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and n_repeated_words of every row (and the removed byte ranges, if asked for).

    n_repeated_words counts the words inside runs of `n_words` words that also start anywhere else; it is
    a finding only and removes nothing. Null is the empty text; texts under `length` bytes lose nothing.
    Rows with equal texts, repeated rows too, are each other's copies and lose everything from `length`
    bytes on. Null ids stay null. Matches never cross rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("d1", F.xxhash64("text")).withColumn("d2", F.xxhash64(F.lit(7), "text"))
    marks = _marks(docs, BYTES, length, k)
    _free(df.sparkSession)
    passages = _marks(docs, PASSAGES, n_words, words_k)
    _free(df.sparkSession)
    both = marks.withColumnRenamed("spans", "cut").join(passages.withColumnRenamed("spans", "said"), ["d1", "d2"], "full")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long" + (", spans array<struct<start:long,stop:long>>" if with_spans else "")
    return docs.join(both, ["d1", "d2"], "left").select("doc_id", "text", "cut", "said").mapInArrow(_cut(with_spans), schema)
