"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors become one entry with the k + 1 smallest of their ids, which is all that a result can
hold of them. Entries are dealt to shards of about SHARD_ROWS by a hash of the vector, so shards grow
in number, never in size, and each is one task's. A shard's graph has levels of geometrically fewer
entries, each linked to a diverse choice of its nearest on that level, as flat arrays of neighbour
positions; it is written as one row of the index table. Blocks of queries descend a shard's levels
side by side, a beam each on the last, score what they found exactly in double precision on the
original vectors, and the shards' best are merged.

Every query meets every shard (no split of unclustered vectors keeps neighbours together), so shards
are as large as a task can hold: a search grows with the logarithm of a shard's rows only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import ragged
from .common import Table, mix64

SHARD_ROWS = 32_768
QUERY_BLOCK = 8192
M, EF_BUILD, EF_SEARCH = 16, 56, 128
#: Entries of a beam that are expanded at once, queries side by side, and entries linked side by side (a row of a shard's similarities each).
EXPAND, SIDE, LINK_SIDE = 8, 512, 64


class Graph:
    """A hierarchical small-world graph over unit vectors. `flat[l]` is an int32 array
    [n, width] of neighbour positions at level l, filled up with -1."""

    def __init__(self, x: np.ndarray, flat: list[np.ndarray], entry: int):
        self.x, self.flat, self.entry = x, flat, entry

    @classmethod
    def build(cls, x: np.ndarray) -> Graph:
        n = len(x)
        u = (mix64(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2**53
        level = np.minimum((-np.log(u + 1e-300) / np.log(M)).astype(int), 8)
        flat = [cls._links(x, np.flatnonzero(level >= k), 2 * M if k == 0 else M) for k in range(int(level.max()) + 1)]
        return cls(x, flat, int(level.argmax()))

    @staticmethod
    def _links(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Neighbours on one level, whose entries are `at`: each one's own choice, then those that chose it, nearest first."""
        flat = np.full((len(x), width), -1, np.int32)
        n, c = len(at), min(EF_BUILD, len(at) - 1)
        if c < 1:
            return flat
        y = x[at]
        src, dst, near = [], [], []
        for a in range(0, n, LINK_SIDE):
            s = y[a : a + LINK_SIDE] @ y.T
            line = np.arange(len(s))[:, None]
            s[line[:, 0], a + line[:, 0]] = -2
            cand = np.argpartition(s, -c, 1)[:, -c:]
            cand = np.take_along_axis(cand, np.argsort(-s[line, cand], 1, kind="stable"), 1)
            own = s[line, cand]
            z = y[cand]
            between = z @ z.transpose(0, 2, 1)
            # A candidate is chosen if it is nearer to the entry than to any chosen before it; then the nearest of the rest.
            chosen, closest = np.zeros(own.shape, bool), np.full(own.shape, -2, np.float32)
            for j in range(c):
                chosen[:, j] = (closest[:, j] <= own[:, j]) & (chosen.sum(1) < M)
                closest = np.where(chosen[:, j, None], np.maximum(closest, between[:, j]), closest)
            pick = np.argsort(~chosen, 1, kind="stable")[:, :M]
            src.append(np.repeat(a + line[:, 0], pick.shape[1]))
            dst.append(cand[line, pick].ravel())
            near.append(own[line, pick].ravel())
        src, dst, near = (np.concatenate(v) for v in (src, dst, near))
        theirs = np.repeat([0, 1], len(src))
        src, dst, near = np.append(src, dst), np.append(dst, src), np.append(near, near)
        first = np.unique(src * n + dst, return_index=True)[1]  # the entry's own choice where both chose
        src, dst, near, theirs = src[first], dst[first], near[first], theirs[first]
        order = np.lexsort((-near, theirs, src))
        src, dst = src[order], dst[order]
        nth = np.arange(len(src)) - np.searchsorted(src, src)
        keep = nth < width
        flat[at[src[keep]], nth[keep]] = at[dst[keep]]
        return flat

    def _near(self, q: np.ndarray, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.x[at], q[line])

    def _climb(self, q: np.ndarray) -> np.ndarray:
        """For each query the entry nearest to it on the way down to the last level but one."""
        at = np.full(len(q), self.entry)
        best = self._near(q, np.arange(len(q)), at)
        for flat in self.flat[:0:-1]:
            todo = np.arange(len(q))
            while len(todo):
                near = flat[at[todo]]
                s = np.where(near >= 0, np.einsum("ijk,ik->ij", self.x[near], q[todo]), -2)
                j = s.argmax(1)
                s, near = s[np.arange(len(todo)), j], near[np.arange(len(todo)), j]
                up = s > best[todo]
                todo, s, near = todo[up], s[up], near[up]
                at[todo], best[todo] = near, s
        return at

    def nearest(self, q: np.ndarray, ef: int) -> np.ndarray:
        """[queries, up to ef] positions that a beam of ef finds (-1: fewer)."""
        n, wide = len(q), min(ef, len(self.x))
        start = self._climb(q)
        ids = np.full((n, wide), -1, np.int64)
        sims = np.full((n, wide), -2, np.float32)
        done = np.ones((n, wide), bool)
        ids[:, 0], sims[:, 0], done[:, 0] = start, self._near(q, np.arange(n), start), False
        seen = np.zeros((n, len(self.x)), bool)
        seen[np.arange(n), start] = True
        live = np.arange(n)
        while len(live):
            line = np.arange(len(live))[:, None]
            rank = np.where(done[live], -3, sims[live])
            e = min(EXPAND, wide)
            spot = np.argpartition(rank, -e, 1)[:, -e:] if e < wide else np.broadcast_to(np.arange(wide), rank.shape)
            good = rank[line, spot] > -3
            near = np.where(good[:, :, None], self.flat[0][ids[live[:, None], spot]], -1).reshape(len(live), -1)
            done[live[:, None], spot] = True
            near = np.sort(near, 1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[live[:, None], near]
            r, c = np.nonzero(fresh)
            to = near[r, c]
            seen[live[r], to] = True
            s = np.full(near.shape, -2, np.float32)
            s[r, c] = self._near(q, live[r], to)
            most = int(fresh.sum(1).max(initial=0))
            if most:
                s2, n2 = s, near
                if most < s.shape[1]:  # only columns that some query needs
                    top = np.argpartition(s, -most, 1)[:, -most:]
                    s2, n2 = s[line, top], near[line, top]
                all_s = np.concatenate([sims[live], s2], 1)
                all_i = np.concatenate([ids[live], np.where(s2 > -2, n2, -1)], 1)
                all_d = np.concatenate([done[live], s2 <= -2], 1)
                top = np.argpartition(all_s, -wide, 1)[:, -wide:]
                sims[live], ids[live], done[live] = all_s[line, top], all_i[line, top], all_d[line, top]
            live = live[~done[live].all(1)]
        return ids


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def nearest_neighbours(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query (rows whose id is divisible by `every`,
    or the rows of `queries`) the k nearest by cosine among rows of other ids, nearest first, ties
    to the smaller id; fewer where there are fewer.

    Null, empty and zero vectors and those that hold null or non-finite components take no part,
    nor do null ids. Vectors meet only those of their own length. Repeated (id, vector) rows count once.
    """
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda a: F.coalesce(a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda a: a != 0)

    def clean(d):
        return d.where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.size(v).alias("dim"))

    rows = clean(df)
    asked = clean(queries) if queries is not None else rows.where(F.col("vec_id") % every == 0)
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = rows.dropDuplicates(["vec_id", "v"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    entries = Table(entries.select("vec_id", "v", "dim"), "vectors").df
    asked = Table(asked.dropDuplicates(["vec_id", "v"]), "queries").df
    shards = max(1, -(-entries.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def build(table: pa.Table) -> pa.Table:
        ids, x = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        whole, which = np.unique(x, axis=0, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        count = np.bincount(which, minlength=len(whole))
        mixed = np.argsort(mix64(np.arange(1, len(whole) + 1, dtype=np.uint64)))  # insertion in an order unlike the sorted one
        start = np.cumsum(count) - count
        ids = ids[order][ragged(start[mixed], count[mixed])]
        whole, count = whole[mixed], count[mixed]
        top = np.abs(whole).max(1, keepdims=True)
        unit = whole / top
        unit = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(np.float32)
        g = Graph.build(unit)
        cols = {"shard": table.column("shard")[:1], "dim": table.column("dim")[:1]}
        for name, a in (("ids", ids), ("counts", count), ("vectors", whole), ("levels", np.array([len(g.flat), g.entry]))):
            cols[name] = pa.array([a.astype("<f8" if name == "vectors" else "<i8").tobytes()], pa.binary())
        cols["graph"] = pa.array([b"".join(f.astype("<i4").tobytes() for f in g.flat)], pa.binary())
        return pa.table(cols)

    def build_all(batches):
        """A task's shards: one, unless vectors of several lengths meet."""
        held = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if held is not None and len(held):
            for dim, shard in sorted(set(zip(held.column("dim").to_pylist(), held.column("shard").to_pylist()))):
                own = held.filter(pa.compute.and_(pa.compute.equal(held.column("dim"), dim), pa.compute.equal(held.column("shard"), shard)))
                yield from build(own).to_batches()

    # A shard a task, by number: few bytes, but much work each, so adaptive execution must not put them together.
    parts = max(shards, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    dealt = dealt.repartitionById(parts, F.pmod(F.col("shard") + F.xxhash64("dim") % parts, F.lit(parts)).cast("int"))
    index = Table(dealt.select("vec_id", "v", "dim", "shard").mapInArrow(build_all, "shard int, dim int, ids binary, counts binary, vectors binary, levels binary, graph binary"), "graphs").df

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            r = {c: right.column(c)[0].as_py() for c in ("ids", "counts", "vectors", "levels", "graph")}
            ids, count, levels = (np.frombuffer(r[c], "<i8") for c in ("ids", "counts", "levels"))
            x = np.frombuffer(r["vectors"], "<f8").reshape(len(count), -1)
            top = np.abs(x).max(1, keepdims=True)
            y = x / top
            norm = np.sqrt((y * y).sum(1))
            unit = (y / norm[:, None]).astype(np.float32)
            raw, flat, at = np.frombuffer(r["graph"], "<i4"), [], 0
            for level in range(int(levels[0])):
                width = 2 * M if level == 0 else M
                flat.append(raw[at : at + len(x) * width].reshape(len(x), width))
                at += len(x) * width
            g = Graph(unit, flat, int(levels[1]))
            begin = np.cumsum(count) - count
            qs, names = _matrix(left.column("v")), left.column("vec_id").to_numpy()
            qs = qs / np.abs(qs).max(1, keepdims=True)
            size = np.sqrt((qs * qs).sum(1))
            for a in range(0, len(qs), SIDE):
                for i, near in enumerate(g.nearest((qs[a : a + SIDE] / size[a : a + SIDE, None]).astype(np.float32), EF_SEARCH), a):
                    near = near[near >= 0]
                    score = np.clip((y[near] * qs[i]).sum(1) / (norm[near] * size[i]), -1, 1)
                    if len(score) > k + 1:  # entries that tie with the last that can count stay
                        stay = score >= np.partition(score, -k - 1)[-k - 1]
                        near, score = near[stay], score[stay]
                    got = sorted({(-s, int(e)) for s, p in zip(score.tolist(), near.tolist()) for e in ids[begin[p] : begin[p] + count[p]] if e != names[i]})
                    for s, e in got[:k]:
                        out["query_id"].append(names[i])
                        out["vec_id"].append(e)
                        out["score"].append(-s)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = max(shards * blocks, parts)
    asked, spread = (d.repartition(parts, "dim", "shard", "block") for d in (asked, spread))
    found = asked.groupBy("dim", "shard", "block").cogroup(spread.groupBy("dim", "shard", "block")).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
