"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of WINDOW bytes from a bounded
sample of labelled rows. To predict, a text's UTF-8 bytes are cut into windows (all of them),
both directions run over every window with many windows side by side, every byte gets a
distribution over languages, and a document's probabilities are the mean over its bytes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_parts

WINDOW = 64
HIDDEN = 8
#: Of each language so many documents at most are learned from, those of least hash, and so many windows of each at most.
DOCS_PER_LANGUAGE = 600
WINDOWS_PER_DOC = 24
STEPS, BATCH, RATE = 500, 192, 0.02
LANES = 4096


def init(classes: int, seed: int = 3) -> dict[str, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
    h = HIDDEN
    return {"Wf": g(256, 3 * h), "Uf": g(h, 3 * h), "bf": np.zeros(h, np.float32), "Wb": g(256, 3 * h), "Ub": g(h, 3 * h), "bb": np.zeros(h, np.float32),
            "Wo": g(2 * h, classes), "bo": np.zeros(classes, np.float32)}


def _sig(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_direction(x: np.ndarray, w, u, b, keep: bool = False):
    """x [T, B] bytes to states [T, B, H]; gates r, z and candidate c of each step if kept."""
    t_max, n = x.shape
    h = HIDDEN
    states = np.zeros((t_max, n, h), np.float32)
    tape = []
    last = np.zeros((n, h), np.float32)
    for t in range(t_max):
        a, m = w[x[t]], last @ u
        rz = np.tanh(0.5 * (a[:, : 2 * h] + m[:, : 2 * h]))
        rz *= 0.5
        rz += 0.5
        p = m[:, 2 * h :] + b
        c = np.tanh(a[:, 2 * h :] + rz[:, :h] * p)
        z = rz[:, h:]
        new = c + z * (last - c)
        states[t] = new
        if keep:
            tape.append((rz, c, p, last))
        last = new
    return states, tape


def back_direction(x, u, tape, grad, gw, gu, gb):
    """Adds gradients of one direction, given those of its states [T, B, H]."""
    h = HIDDEN
    carry = np.zeros_like(grad[0])
    for t in range(len(tape) - 1, -1, -1):
        rz, c, p, last = tape[t]
        r, z = rz[:, :h], rz[:, h:]
        d = grad[t] + carry
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (last - c) * z * (1 - z)
        dr = dc * p * r * (1 - r)
        dm = np.concatenate([dr, dz, dc * r], 1)
        gu += last.T @ dm
        gb += (dc * r).sum(0)
        np.add.at(gw, x[t], np.concatenate([dr, dz, dc], 1))
        carry = d * z + dm @ u.T


def loss_and_grads(p: dict, x: np.ndarray, live: np.ndarray, y: np.ndarray):
    """x, live [T, B]; y [B]. Mean cross-entropy over live bytes, and gradients."""
    hf, tf = run_direction(x, p["Wf"], p["Uf"], p["bf"], True)
    hb, tb = run_direction(x[::-1], p["Wb"], p["Ub"], p["bb"], True)
    both = np.concatenate([hf, hb[::-1]], 2)
    logit = both @ p["Wo"] + p["bo"]
    logit -= logit.max(2, keepdims=True)
    prob = np.exp(logit)
    prob /= prob.sum(2, keepdims=True)
    n = max(1, live.sum())
    at = np.broadcast_to(y, x.shape)
    picked = np.take_along_axis(prob, at[:, :, None], 2)[:, :, 0]
    loss = -(np.log(picked + 1e-12) * live).sum() / n
    d = prob.copy()
    np.put_along_axis(d, at[:, :, None], np.take_along_axis(d, at[:, :, None], 2) - 1, 2)
    d *= live[:, :, None] / n
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["Wo"] = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, d.shape[2])
    g["bo"] = d.sum((0, 1))
    dh = d @ p["Wo"].T
    back_direction(x, p["Uf"], tf, dh[:, :, :HIDDEN], g["Wf"], g["Uf"], g["bf"])
    back_direction(x[::-1], p["Ub"], tb, dh[::-1, :, HIDDEN:], g["Wb"], g["Ub"], g["bb"])
    return loss, g


def windows(data: np.ndarray, offs: np.ndarray):
    """[n, WINDOW] bytes (0 beyond a text's end), their lengths and rows."""
    size = np.diff(offs)
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offs[:-1][row] + nth * WINDOW
    n = np.minimum(WINDOW, offs[1:][row] - start)
    at = start[:, None] + np.arange(WINDOW)
    live = np.arange(WINDOW) < n[:, None]
    return np.where(live, data[np.minimum(at, max(0, len(data) - 1))], 0).astype(np.uint8) if len(row) else np.zeros((0, WINDOW), np.uint8), n, row


def train(drawn: list[bytes], langs: list[str], seed: int = 11) -> tuple[list[str], dict]:
    """Adam on balanced batches of windows."""
    names = sorted(set(langs))
    r = np.random.Generator(np.random.PCG64(seed))
    pools: list[list] = [[] for _ in names]
    for b, lang in zip(drawn, langs):
        pools[names.index(lang)].append((np.frombuffer(b.ljust(WINDOW, b"\0"), np.uint8), len(b)))
    p = init(len(names))
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    each = max(1, BATCH // len(names))
    for step in range(1, STEPS + 1):
        xs, ns, ys = [], [], []
        for y, pool in enumerate(pools):
            for i in r.integers(0, len(pool), each):
                xs.append(pool[i][0])
                ns.append(pool[i][1])
                ys.append(y)
        x = np.array(xs).T
        live = (np.arange(WINDOW)[:, None] < np.array(ns)[None, :]).astype(np.float32)
        _, g = loss_and_grads(p, x, live, np.array(ys))
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return names, p


def pooled(p: dict, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Mean distribution over each row's bytes, [rows, languages]; zeros for empty rows."""
    rows = len(offs) - 1
    k = p["Wo"].shape[1]
    total = np.zeros((rows, k))
    x_all, n_all, row_all = windows(data, offs)
    top, low = p["Wo"][:HIDDEN], p["Wo"][HIDDEN:]
    for a in range(0, len(x_all), LANES):
        x = np.ascontiguousarray(x_all[a : a + LANES].T)
        n, row = n_all[a : a + LANES], row_all[a : a + LANES]
        hf, _ = run_direction(x, p["Wf"], p["Uf"], p["bf"])
        # Backwards, a window's bytes come after the padding beyond its end, whose states are reset.
        hb = np.zeros_like(hf)
        if (n == WINDOW).all():
            hb = run_direction(x[::-1], p["Wb"], p["Ub"], p["bb"])[0][::-1]
        else:
            full = n == WINDOW
            hb[:, full] = run_direction(x[::-1][:, full], p["Wb"], p["Ub"], p["bb"])[0][::-1]
            part = np.flatnonzero(~full)
            at = n[part][None, :] - 1 - np.arange(WINDOW)[:, None]
            turned = np.where(at >= 0, x[np.maximum(at, 0), part[None, :]], 0)
            got = run_direction(turned, p["Wb"], p["Ub"], p["bb"])[0]
            hb[:, part] = got[np.maximum(at, 0), np.arange(len(part))[None, :]]
        logit = hf @ top
        logit += hb @ low
        logit += p["bo"]
        np.exp(logit, out=logit)  # states are within 1, so this cannot overflow
        logit /= logit.sum(2, keepdims=True)
        logit *= (np.arange(WINDOW)[:, None] < n[None, :])[:, :, None]
        np.add.at(total, row, logit.sum(0, dtype=np.float64))
    size = np.diff(offs)
    return total / np.maximum(size, 1)[:, None]


def cut_windows(batches):
    """(id, text, label) to at most WINDOWS_PER_DOC windows of each row, drawn over its whole text by the id's CRC."""
    for batch in batches:
        out, langs = [], []
        for at, data, offs in text_parts(batch.column(1)):
            x, n, row = windows(data, offs)
            ends = np.searchsorted(row, np.arange(len(offs)))
            for i in range(len(offs) - 1):
                r = np.random.Generator(np.random.PCG64(zlib.crc32(batch.column(0)[at + i].as_py().encode())))
                for j in ends[i] + r.permutation(ends[i + 1] - ends[i])[:WINDOWS_PER_DOC]:
                    out.append(x[j, : n[j]].tobytes())
                    langs.append(batch.column(2)[at + i].as_py())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(langs, pa.string())], ["w", "l"])


def learning_sample(df: DataFrame, id_col: str, text_col: str, label_col: str) -> list:
    """(window, label) rows: of each label about DOCS_PER_LANGUAGE documents at most and WINDOWS_PER_DOC windows of each, from
    rows with a label, a letter and a hash remainder other than 0. Windows are cut where the rows are, so the driver gets at
    most some 1.5 MB a language; of rows with one id and label one is read, however many there are."""
    known = df.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"), F.col(label_col).cast("string").alias("l")).where(
        "l is not null and i is not null and crc32(i) % 5 <> 0")
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().limit(10_001).collect()}
    if len(counts) > 10_000:
        raise ValueError("more than 10,000 languages")
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, DOCS_PER_LANGUAGE / n))]), F.col("l"))
    drawn = known.where(F.conv(F.substring(F.md5(F.concat(F.lit("lang|"), "i")), 1, 12), 16, 10).cast("long") / float(1 << 48) < share)
    one = drawn.where(F.col("t").rlike(r"\p{L}")).groupBy("i", "l").agg(F.min("t").alias("t")).select("i", "t", "l")
    return sorted(((bytes(r.w), r.l) for r in one.mapInArrow(cut_windows, "w binary, l string").collect()), key=lambda x: (x[1], x[0]))


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    held_out: crc32 of the id as text leaves 0 modulo 5 (false for a null id, which is not learned
    from either). Texts that are null or hold no letter are 'und' with score 0, as are all where
    nothing can be learned. Ties go to the first language in sorted order. Repeated rows repeat.
    """
    sample = learning_sample(df, id_col, text_col, label_col)
    names, p = train([w for w, _ in sample], [lang for _, lang in sample]) if sample else (["und"], None)

    def run(batches):
        for batch in batches:
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if p is not None:
                for at, data, offs in text_parts(batch.column(1)):
                    got = pooled(p, data, offs)
                    best = got.argmax(1)
                    for i in np.flatnonzero(np.diff(offs) > 0):
                        pred[at + i], score[at + i] = names[best[i]], min(1.0, got[i, best[i]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    src = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(F.col(text_col).cast("string").rlike(r"\p{L}"), F.col(text_col).cast("string")).alias("text"),
        F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
