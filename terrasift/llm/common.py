"""Shared pieces of the corpus operators: durable intermediate tables, connected
components, and numpy kernels over batches of UTF-8 text."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a folder of our own if driver and
    executors are one process; else ValueError, since executors could not read each other's files."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="terrasift-")
    return f"file://{_own_dir}"


class Table:
    """A DataFrame written to the shared folder, so that nothing upstream is recomputed and lost
    executors cost nothing but a reread. drop() frees its files once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{scratch_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    return Table(df, name).df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have (Spark compares names without case)."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base = f"_{base}"
    return base


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs to (node, component): the least node that each can reach.

    Labels spread over edges and then jump to their own label's label, so long chains take
    logarithmically many rounds. Every round is a written table; nothing gathers on the driver.
    Raises if it has not settled after `rounds`.
    """
    both = Table(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(),
        "edges",
    )
    labels = Table(both.df.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    for _ in range(rounds):
        near = (
            both.df.join(labels.df, both.df["v"] == labels.df["node"])
            .groupBy("u").agg(F.min("label").alias("m"))
        )
        step = Table(
            labels.df.join(near, labels.df["node"] == near["u"])
            .select("node", "label", F.least("label", "m").alias("new")), "step",
        )
        up = step.df.select(F.col("node").alias("at"), F.col("new").alias("over"))
        nxt = Table(
            step.df.join(up, step.df["new"] == up["at"], "left")
            .select("node", F.col("label").alias("old"), F.least("new", "over").alias("label")), "labels",
        )
        moved = nxt.df.where("old <> label").limit(1).count()
        labels.drop()
        step.drop()
        labels = nxt
        if not moved:
            both.drop()
            return labels.df.select("node", F.col("label").alias("component"))
    raise RuntimeError("connected components have not settled")


# ---------------------------------------------------------------- numpy kernels

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        n = max(n, 2 * len(_powers))
        _powers = np.full(n, STEP, np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
    return _powers


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text that a kernel takes at once where many workers share an executor's memory: its arrays have some 50 bytes a byte.
PART_BYTES = 1 << 18


def text_parts(column: pa.Array, limit: int = 1 << 20):
    """Yields (first row, bytes as uint8, offsets) over runs of rows of about `limit` bytes;
    nulls are empty. Rows are never cut."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, data[offs[at] : offs[to]], (offs[at : to + 1] - offs[at])
        at = to


#: Words of more bytes are hashed by xxhash. A polynomial modulo 2^64 is safe up to there only: from some 1,000 bytes on there are unlike words that it maps to one value whatever its factor.
LONG_WORD = 256


def words(data: np.ndarray, offs: np.ndarray):
    """Hash, start, end and row of each word: runs of bytes that are not ASCII white space, A-Z lowered."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offs[:-1][offs[:-1] < offs[1:]]
    first[heads] |= solid[heads]
    start = np.flatnonzero(first)
    if not len(start):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    row = np.searchsorted(offs, start, "right") - 1
    upto = np.append(start[1:], n)
    pos = np.arange(n, dtype=np.int64)
    pos[start[0] :] -= np.repeat(start, upto - start)
    value = np.where(solid, BYTE_VALUE[LOWER[data]], 0).astype(np.uint64)
    value *= powers(int(pos.max()) + 1)[pos]
    h = np.add.reduceat(value, start)
    length = np.add.reduceat(solid.astype(np.int64), start)
    h = mix64(h)
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(LOWER[data[start[i] : start[i] + length[i]]].tobytes())
    return h, start, start + length, row


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, n: int = 5):
    """Hash and row of every n consecutive words; a row with 1 to n-1 words has one shingle of them all."""
    count = np.bincount(row, minlength=n_rows)
    if len(h) < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = np.cumsum(count)
    factors = powers(n + 8)[3 : 3 + n]
    m = len(h) - n + 1
    out_h, out_r = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if m > 0:
        acc = np.zeros(m, np.uint64)
        for j in range(n):
            acc += h[j : j + m] * factors[j]
        good = row[:m] == row[n - 1 :]
        out_h, out_r = mix64(acc[good]), row[:m][good]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        begin = ends[short] - count[short]
        acc = np.zeros(len(short), np.uint64)
        for j in range(n - 1):
            has = count[short] > j
            acc[has] += h[begin[has] + j] * factors[j]
        acc = mix64(acc ^ np.uint64(0xA5A5A5A5))
        out_h, out_r = np.append(out_h, acc), np.append(out_r, short)
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r
