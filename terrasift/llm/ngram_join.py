"""Jaccard self-join on word shingles with Bayesian candidate pruning.

1. Texts with the same words (by a SHA-256 of all their words) collapse to one node with a count of its copies.
2. Nodes that share a MinHash band meet: BANDS bands of ROWS values, so a pair at similarity s
   shares none with probability (1 - s**ROWS)**BANDS, 1.3e-7 at 0.8 and less above. Members of
   a bucket are linked to its least node only, which keeps the edges linear in the input, and
   the connected components of those edges hold every candidate pair.
   A component of several blocks is compared bucket by bucket instead of as a whole where that
   deals fewer rows: a chain of weakly similar texts then costs a row for each bucket a node is
   in, however long it is. A pair counts in the first band it shares, so no pair counts twice.
3. The nodes of such a group are compared in blocks of bounded size. MinHash values are compared in
   steps; a pair is dropped as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below TOLERANCE. What remains is verified exactly on
   the shingle sets, whose words are compared in full. A block gives a row for each node (its number of links and the least node
   it reaches inside the block), never pairs, so nothing written grows with a group's square.
4. Components of the verified links are the classes.

Words are runs of bytes other than ASCII white space, A-Z lowered. A text of 1 to n-1 words has
one shingle, of them all. Null, empty and blank texts have none: each is a class of its own
without links or copies. Rows without an id get a null class and no links. Rows with one id
share a class. No cap is set on buckets, components or partners.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import distinct
from .common import LOWER, PART_BYTES, SPACE, Table, connected_components, free_name, mix64, saved, shingles, text_parts, words

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-9
BLOCK_NODES, BLOCK_BYTES = 512, 1 << 21
#: Candidate pairs whose MinHash values are compared at once.
PAIRS = 1 << 15
_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(0, 2**32, (HASHES, 2), dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signatures(h: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    """MinHash values, uint32 [n_rows, HASHES]; rows without shingles have the greatest value throughout."""
    out = np.full((n_rows, HASHES), 0xFFFFFFFF, np.uint32)
    if not len(h):
        return out
    lo, hi = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    at = row[first]
    bound = 0
    while bound < len(first):  # pieces that stay in the cache; a row is never cut
        to = max(bound + 1, int(np.searchsorted(first, first[bound] + 32768)))
        a, b = first[bound], first[to] if to < len(first) else len(h)
        x, y, starts = lo[a:b], hi[a:b], first[bound:to] - a
        for k in range(HASHES):
            out[at[bound:to], k] = np.minimum.reduceat(x * _MUL[k, 0] + y * _MUL[k, 1] + _ADD[k], starts)
        bound = to
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.view(np.int64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values, the fewest matches with P(similarity >= threshold | matches) >= tolerance.

    With a uniform prior that posterior is P(Binomial(n + 1, threshold) <= matches)."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def exact_shingles(word: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> list:
    """Of words given as numbers (equal numbers, equal words), each row's sorted distinct runs of n, as numbers that
    are equal only for equal runs; a row of 1 to n-1 words has one run, of them all."""
    run, base = word, int(word.max(initial=0)) + 1
    for j in range(1, n):
        run = np.unique(run[:-1] * base + word[j:], return_inverse=True)[1] if len(run) > 1 else run[:0]
    own = row[: len(run)]
    full = own == row[n - 1 :][: len(own)]
    run, own = run[full], own[full]
    ends = np.searchsorted(own, np.arange(n_rows + 1))
    whole = np.searchsorted(row, np.arange(n_rows + 1))
    short: dict = {}
    out = []
    for i in range(n_rows):
        k = whole[i + 1] - whole[i]
        if 0 < k < n:
            out.append(np.array([-1 - short.setdefault(tuple(word[whole[i] : whole[i + 1]].tolist()), len(short))]))
        else:
            out.append(np.unique(run[ends[i] : ends[i + 1]]))
    return out


def _sets(texts: pa.Array, n: int):
    """Sorted distinct shingles of each text, exact, and signatures."""
    found, sigs, lower, before = [], [], [], 0
    for at, data, offs in text_parts(texts, PART_BYTES):
        h, start, end, row = words(data, offs)
        s, r = shingles(h, row, len(offs) - 1, n)
        sigs.append(signatures(s, r, len(offs) - 1))
        found.append((h, start + before, end - start, row + at))
        lower.append(LOWER[data])
        before += len(data)
    h, start, size, row = (np.concatenate(x) for x in zip(*found))
    word = distinct(np.concatenate(lower), start, size, h)[1] if len(h) else h.astype(np.int64)
    return exact_shingles(word, row, len(texts), n), np.concatenate(sigs)


def _links(sets: list, sigs: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, threshold: float, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of positions (i in left, j in right); with `same`, i before j of one list.
    With a band of 0 or more, only pairs whose first shared band that is."""
    need = least_matches(threshold, TOLERANCE)
    eq = np.zeros((len(left), len(right)), np.int16)
    for k in range(STEP):
        eq += sigs[left, k][:, None] == sigs[right, k][None, :]
    ok = eq >= need[STEP]
    size = np.array([len(s) for s in sets])
    ok &= (size[left] > 0)[:, None] & (size[right] > 0)[None, :]
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    a, b = np.nonzero(ok)
    m = eq[a, b].astype(np.int64)
    a, b = left[a], right[b]
    if band >= 0:
        keys = band_keys(sigs)
        for k in range(band + 1):
            keep = (keys[a, k] == keys[b, k]) == (k == band)
            a, b, m = a[keep], b[keep], m[keep]
    likely = []
    for at in range(0, len(a), PAIRS):
        p, q, same_values = a[at : at + PAIRS], b[at : at + PAIRS], m[at : at + PAIRS]
        for n in range(2 * STEP, HASHES + 1, STEP):
            if not len(p):
                break
            same_values = same_values + (sigs[p, n - STEP : n] == sigs[q, n - STEP : n]).sum(1)
            keep = same_values >= need[n]
            p, q, same_values = p[keep], q[keep], same_values[keep]
        likely.append((p, q))
    if likely:
        a, b = (np.concatenate(x) for x in zip(*likely))
    t = Fraction(str(threshold))
    fits = t.denominator * np.minimum(size[a], size[b]) >= t.numerator * np.maximum(size[a], size[b])
    a, b = a[fits], b[fits]
    if not len(a):
        return a, b
    used = np.unique(np.concatenate([a, b]))
    if len(a) <= 4 * len(used):
        inter = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)])
    else:
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        vocab, col = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
        line = np.repeat(np.arange(len(used)), size[used])
        order = np.argsort(col, kind="stable")
        col, line = col[order], line[order]
        rows_a, rows_b = np.unique(place[a]), np.unique(place[b])
        both = np.zeros((len(rows_a), len(rows_b)), np.float64)
        for c in range(0, len(vocab), 2048):
            lo, hi = np.searchsorted(col, [c, c + 2048])
            x = np.zeros((len(used), 2048), np.float32)
            x[line[lo:hi], col[lo:hi] - c] = 1
            both += x[rows_a] @ x[rows_b].T
        inter = np.rint(both[np.searchsorted(rows_a, place[a]), np.searchsorted(rows_b, place[b])]).astype(np.int64)
    union = size[a] + size[b] - inter
    keep = t.denominator * inter >= t.numerator * union
    return a[keep], b[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position that each of n positions reaches over links."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


_OUT = "node long, links long, text_links long, root long"


def _block(table: pa.Table, n: int, threshold: float) -> pa.RecordBatch:
    node = table.column("node").to_numpy()
    left, same = table.column("in_left").to_numpy(zero_copy_only=False), bool(table.column("same")[0].as_py())
    order = np.argsort(node, kind="stable")
    table, node, left = table.take(pa.array(order)), node[order], left[order]
    if len(np.unique(node)) < len(node):  # repeated rows: of an id's equal texts one is enough
        seen, keep = set(), []
        for i, t in enumerate(zip(node.tolist(), table.column("text").to_pylist())):
            if t not in seen:
                seen.add(t)
                keep.append(i)
        table, node, left = table.take(pa.array(keep)), node[keep], left[keep]
    copies = table.column("copies").to_numpy()
    sets, sigs = _sets(table.column("text").combine_chunks(), n)
    every = np.arange(len(node))
    a, b = _links(sets, sigs, every if same else every[left], every if same else every[~left], same, threshold, int(table.column("band")[0].as_py()))
    links = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
    texts = np.bincount(a, minlength=len(node)) + np.bincount(b, minlength=len(node))
    return pa.RecordBatch.from_arrays(
        [pa.array(node), pa.array(links.astype(np.int64)), pa.array(texts.astype(np.int64)), pa.array(node[_roots(len(node), a, b)])],
        ["node", "links", "text_links", "root"])


def _groups(member: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is compared with what: component, band, key, blocks, node, copies. A component is one group (band -1), or,
    where that deals fewer rows, one for each bucket of two nodes or more. Only components of several blocks are looked into."""
    wide = (
        member.where("blocks > 1").join(nodes.select("node", "bands"), "node")
        .select("component", "node", "copies", "size", "blocks", F.posexplode("bands").alias("band", "key"))
    )
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    buckets = Table(wide.groupBy("component", "band", "key").agg(F.count(F.lit(1)).alias("n"), parts.alias("parts")).where("n > 1"), "buckets").df
    whole = member.where("blocks > 1").groupBy("component").agg(F.sum("blocks").alias("whole"))
    cheaper = Table(
        buckets.groupBy("component").agg(F.sum(F.col("n") * F.col("parts")).alias("apart")).join(whole, "component")
        .where("apart < whole").select("component"), "by-bucket").df
    one = member.join(cheaper, "component", "left_anti").select(
        "component", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("key"), "blocks", "node", "copies")
    many = wide.join(cheaper, "component", "left_semi").join(buckets, ["component", "band", "key"]).select(
        "component", "band", "key", F.col("parts").alias("blocks"), "node", "copies")
    return one.unionByName(many)


def similar_classes(df: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, class_id (the least id of all that links and copies reach),
    n_links (other rows at or above the threshold, copies with them), n_copies (rows with the
    same words, itself with them), n_text_links (different texts at or above the threshold)."""
    spark = df.sparkSession
    src = df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sketch(batches):
        for batch in batches:
            ids = batch.column(0)
            same, size, bands = [], [], []
            for at, data, offs in text_parts(batch.column(1), PART_BYTES):
                h, start, end, row = words(data, offs)
                s, r = shingles(h, row, len(offs) - 1, n)
                keys = band_keys(signatures(s, r, len(offs) - 1))
                solid = ~SPACE[data]
                letters, upto = LOWER[data[solid]], np.append(0, np.cumsum(solid))[offs]
                lens, ends = (end - start).astype("<i8"), np.searchsorted(row, np.arange(len(offs)))
                for i in range(len(offs) - 1):
                    own = hashlib.sha256(lens[ends[i] : ends[i + 1]].tobytes())
                    own.update(letters[upto[i] : upto[i + 1]].tobytes())
                    some = ends[i] < ends[i + 1]
                    same.append(own.digest() if some else None)
                    size.append(int(offs[i + 1] - offs[i]))
                    bands.append(keys[i] if some else None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "words", "size", "bands"])

    drawn = Table(src.mapInArrow(sketch, "doc_id long, words binary, size long, bands array<long>"), "sketches")
    nodes = Table(
        drawn.df.where("doc_id is not null and words is not null").groupBy("words")
        .agg(F.min(F.struct("doc_id", "size", "bands")).alias("least"), F.count(F.lit(1)).alias("copies"))
        .select("words", "copies", F.col("least.doc_id").alias("node"), "least.size", "least.bands"), "nodes")
    keys = nodes.df.select("node", F.explode("bands").alias("key"))
    hubs = Table(keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub < far").select("key", "hub"), "hubs")
    # A node's hubs (BANDS at most) hang on the least of them: a few edges for a whole group, where nodes share their hubs.
    met = keys.join(hubs.df, "key").where("node <> hub").groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    met = Table(met.select("node", "hubs", F.array_min("hubs").alias("v")), "met")
    meets = met.df.select(F.col("node").alias("u"), "v").union(met.df.select(F.explode("hubs").alias("u"), "v").where("u <> v").distinct())
    groups = Table(connected_components(meets), "groups")
    hubs.drop()
    met.drop()

    member = nodes.df.select("node", "copies", "size").join(groups.df, "node")
    sizes = Table(
        groups.df.join(nodes.df.select("node", "size"), "node").groupBy("component")
        .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_NODES), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int").alias("blocks")), "blocks")
    member = Table(member.join(sizes.df, "component"), "members")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # The hint keeps the plan alike at all sizes: texts are dealt once, by id, and only members' go on.
    dealt = src.join(_groups(member.df, nodes.df).hint("shuffle_hash"), src["doc_id"] == F.col("node"))
    dealt = (
        dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", "band", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") <= F.col("other")).alias("in_left"), (F.col("own") == F.col("other")).alias("same"), "node", "copies", "text")
    )
    block = ["component", "band", "key", "i", "j"]
    dealt = dealt.repartition(shuffled, *block).sortWithinPartitions(*block, "node")

    def compare(batches):
        held, key = [], None
        for batch in batches:
            c = [batch.column(k).to_numpy() for k in range(len(block))]
            if not len(c[0]):
                continue
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in c], axis=0)) + 1
            for a, b in zip([0, *cut], [*cut, len(c[0])]):
                at = tuple(x[a] for x in c)
                if held and at != key:
                    yield _block(pa.Table.from_batches(held), n, threshold)
                    held = []
                key = at
                held.append(batch.slice(a, b - a))
        if held:
            yield _block(pa.Table.from_batches(held), n, threshold)

    found = Table(dealt.mapInArrow(compare, _OUT), "links")
    classes = connected_components(found.df.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.df.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    full = Table(
        nodes.df.select("words", "node", "copies").join(counts, "node", "left").join(classes, "node", "left")
        .select("words", F.coalesce("component", "node").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.col("copies").alias("n_copies"), F.coalesce("text_links", F.lit(0)).alias("n_text_links")), "classes")
    rows = drawn.df.select("doc_id", "words").withColumn("own", F.col("doc_id").isNotNull() & F.col("words").isNotNull())
    out = rows.where("own").join(full.df, "words").select("doc_id", "class_id", "n_links", "n_copies", "n_text_links")
    alone = rows.where("not own").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_text_links"))
    return out.unionByName(alone)


def near_dedup(df: DataFrame, n: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df whose id is their class's id, and those without an id; df's columns."""
    name = free_name(df, "__gone")
    gone = saved(similar_classes(df, n, threshold, id_col, text_col).where("class_id <> doc_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    return df.join(gone.hint("shuffle_hash"), df[id_col].cast("long") == F.col(name), "left_anti")
