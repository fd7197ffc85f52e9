"""Language identification, quality selection, nearest neighbours, licences."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np

from terrasift.llm import language_id as L, nearest, quality as Q
from terrasift.llm.licenses import scan_licenses

WORDS = {"en": "the of and to in is that with for thing", "de": "der die und das nicht ein schön für auch übung", "fr": "le la être déjà pour que dans avec élève où"}


def texts(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(4, 60))), lang, "s"))
    return out


def test_gradients_are_the_slopes():
    p = {k: v.astype(np.float64) for k, v in L.init(3).items()}
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (6, 4)), np.array([0, 1, 2, 1])
    live = (np.arange(6)[:, None] < np.array([6, 4, 2, 6])).astype(float)
    _, g = L.loss_and_grads(p, x, live, y)
    for k in p:
        flat = p[k].reshape(-1)
        spots = [int(x[2, 1]) * (flat.size // 256) + 1] if k.startswith("W") and k != "Wo" else [0, flat.size - 1]
        for i in spots:
            old, h = flat[i], 1e-3
            flat[i] = old + h
            a, _ = L.loss_and_grads(p, x, live, y)
            flat[i] = old - h
            b, _ = L.loss_and_grads(p, x, live, y)
            flat[i] = old
            assert abs((a - b) / (2 * h) - g[k].reshape(-1)[i]) < 2e-3


def test_language_held_out(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 150)
    rows = [*texts(400), (900, None, "en", "s"), (901, "123 !!", "de", "s"), (902, "", None, "s"), (None, "the thing", "en", "s"), (903, "der die und " * 5000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = L.identify_languages(df).collect()
    assert len(got) == len(rows)
    by = {g.doc_id: g for g in got}
    for i in (900, 901, 902):
        assert by[i].lang_pred == "und" and by[i].score == 0
    assert by[903].lang_pred == "de"
    held = [i for i, *_ in texts(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(by[i].held_out for i in held)
    right = sum(by[i].lang_pred == lang for i, _, lang, _ in texts(400) if by[i].held_out)
    assert right >= 0.95 * len(held) and all(0 <= g.score <= 1 for g in got)
    assert L.identify_languages(df.limit(0)).count() == 0


def test_quality_selects_what_looks_like_the_target(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS["en"].split()) + ("" if i % 4 else "!!") for _ in range(r.randint(20, 80))), "s") for i in range(400)]
    rows += [(1000, None, "s"), (1001, "", None), (None, "the thing", "s"), (5, rows[5][1], "s"), (1002, "the of and " * 30_000, "x")]
    labels = [(i, int(i % 4 > 0), 0) for i in range(0, 400, 3)] + [(0, None, None), (7, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, _, least = Q.select_quality(df, lab)
    got = got.collect()
    assert len(got) == len(rows)
    bad = [g.kept for g in got if g.doc_id is not None and g.doc_id < 400 and g.doc_id % 4 == 0]
    assert all(g.kept for g in got if g.doc_id is not None and g.doc_id < 400 and g.doc_id % 4) and sum(bad) < 0.2 * len(bad)
    kept = Q.quality_filter(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(g.kept for g in got)
    none, _, _ = Q.select_quality(df, lab.limit(0))
    assert none.where("not kept").count() == 0
    assert Q.select_quality(df.limit(0), lab)[0].count() == 0


def test_kth_largest(spark):
    r = random.Random(1)
    v = [r.choice([r.random(), 0.5]) for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    for k in (1, 2, 1500, 2999, 3000):
        want = sorted(v, reverse=True)[k - 1] if k < 3000 else float("-inf")
        assert Q.kth_largest(df, "x", k, few=50) == want


def test_neighbours_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nearest, "SHARD_ROWS", 300)
    r = np.random.default_rng(5)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[::9] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(2000, None, 0), (2050, [0.0] * 16, 0), (2100, [float("nan")] + [1.0] * 15, 0), (2150, [float("inf")] + [1.0] * 15, 0), (2200, [], 0), (None, x[1].tolist(), 0), (2250, [None] + [1.0] * 15, 0), (50, x[50].tolist(), 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank int")
    got = nearest.nearest_neighbours(df).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 900, 50):
        own = sorted((g for g in got if g.query_id == q), key=lambda g: g["rank"])
        assert [g["rank"] for g in own] == [1, 2, 3, 4, 5]
        s = u @ u[q]
        best = [i for i in sorted(range(900), key=lambda i: (-round(s[i], 12), i)) if i != q][:5]
        hit += len(set(best) & {g.vec_id for g in own})
        total += 5
        assert all(abs(g.score - s[g.vec_id]) < 1e-9 for g in own)
    assert hit / total >= 0.9
    assert {g.query_id for g in got} == set(range(0, 900, 50))
    assert nearest.nearest_neighbours(df.limit(0)).count() == 0
    few = nearest.nearest_neighbours(df.where("vec_id in (0, 9)"))
    assert [tuple(r)[:3] for r in few.collect()] == [(0, 1, 9)]


def test_licences(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/b/LICENSE", mit), (2, "a/b/c/x.py", "code"), (3, "a/b/c/y.py", "code\n" + apache), (4, "z/w.py", None), (5, "COPYING", apache), (6, None, ""), (7, "a/d/LICENSE.txt", "nothing of the kind"),
            (8, "a/d/e.py", "copyright someone"), (2, "a/b/c/x.py", "code"), (None, "a/b/n.py", "x" * 100_000)]
    df = spark.createDataFrame([(*r, "l") for r in rows], "doc_id long, path string, text string, license string")
    got = {(g.doc_id, g.path): (g.license, g.origin, g.from_dir) for g in scan_licenses(df).collect()}
    assert got[1, "a/b/LICENSE"] == ("MIT", "file", None)
    assert got[2, "a/b/c/x.py"] == ("MIT", "inherited", "a/b")
    assert got[3, "a/b/c/y.py"] == ("Apache-2.0", "header", None)
    assert got[4, "z/w.py"] == ("Apache-2.0", "inherited", "")
    assert got[8, "a/d/e.py"] == ("Apache-2.0", "inherited", "")
    assert got[None, "a/b/n.py"] == ("MIT", "inherited", "a/b")
    assert scan_licenses(df).count() == len(rows)
    assert scan_licenses(df.limit(0)).count() == 0
    assert math.isclose(1.0, [g for g in scan_licenses(df).collect() if g.doc_id == 1][0].score, abs_tol=1e-6)


def test_neighbours_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>, v string"
    bad = spark.createDataFrame([(0, None, "a"), (50, [0.0, 0.0], "a"), (100, [float("nan"), 1.0], "b")], schema)
    assert nearest.nearest_neighbours(bad).count() == 0
    rows = [(i, [1.0, 2.0], "same") for i in range(300)] + [(1000, [2.0, 4.0], "same way"), (1001, [2.0, -1.0], "across"), (2000, [1.0, 0.0, 0.0], "longer"), (2001, [1.0, 0.1, 0.0], "longer")]
    df = spark.createDataFrame(rows, schema)
    got = nearest.nearest_neighbours(df)
    got = {q: [(g.vec_id, round(g.score, 9)) for g in sorted(got.where(f"query_id = {q}").collect(), key=lambda g: g["rank"])] for q in (0, 50, 1000, 2000)}
    assert got[0] == [(i, 1.0) for i in (1, 2, 3, 4, 5)] and got[50] == got[1000] == [(i, 1.0) for i in (0, 1, 2, 3, 4)]
    assert [i for i, _ in got[2000]] == [2001]
    asked = nearest.nearest_neighbours(df, k=2, queries=spark.createDataFrame([(1001, [2.0, -1.0], ""), (-5, [1.0, 0.0, 0.0], "")], schema)).collect()
    assert sorted((g.query_id, g["rank"], g.vec_id) for g in asked) == [(-5, 1, 2000), (-5, 2, 2001), (1001, 1, 0), (1001, 2, 1)]


def test_graphs_recall():
    r = np.random.default_rng(2)
    x = r.standard_normal((6000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = nearest.Graph.build(x)
    q = x[::40]
    found = g.nearest(q, nearest.EF_SEARCH)
    s = q @ x.T
    best = np.argsort(-s, 1)[:, :6]
    assert np.mean([np.isin(best[i], found[i]).mean() for i in range(len(q))]) > 0.95 and len(g.flat) > 2


def test_pooled_probabilities_byte_by_byte():
    """Against one window and one byte at a time, in double precision; short, exact and long texts, one of them empty."""
    p = L.init(3, seed=8)
    texts = [b"", b"a", b"x" * L.WINDOW, "é日 mixed text ".encode() * 17, b"tail" * 33]
    offs = np.append(0, np.cumsum([len(t) for t in texts]))
    got = L.pooled(p, np.frombuffer(b"".join(texts), np.uint8), offs)
    h, sig = L.HIDDEN, lambda v: 1 / (1 + np.exp(-v))

    def states(window, w, u, b):
        out, last = [], np.zeros(h)
        for c in window:
            a, m = w[c].astype(float), last @ u.astype(float)
            r, z = sig(a[:h] + m[:h]), sig(a[h : 2 * h] + m[h : 2 * h])
            last = (1 - z) * np.tanh(a[2 * h :] + r * (m[2 * h :] + b)) + z * last
            out.append(last)
        return out

    for t, g in zip(texts, got):
        every = []
        for at in range(0, len(t), L.WINDOW):
            w = t[at : at + L.WINDOW]
            for f, b in zip(states(w, p["Wf"], p["Uf"], p["bf"]), reversed(states(w[::-1], p["Wb"], p["Ub"], p["bb"]))):
                e = np.exp(np.concatenate([f, b]) @ p["Wo"].astype(float) + p["bo"])
                every.append(e / e.sum())
        assert np.allclose(g, np.mean(every, 0) if every else 0, atol=1e-4)


def test_language_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 20)
    rows = [(1, "same words here", lang) for lang in ("b", "a")] * 50 + [(1, "other", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(L.learning_sample(df, "doc_id", "text", "lang")) == 2  # one row an id and label
    got = L.identify_languages(df).collect()
    assert len(got) == 101 and len({(g.lang_pred, g.score) for g in got if g.lang_pred}) <= 2
    monkeypatch.setattr(L, "train", lambda w, langs: (["a", "b"], {k: v * 0 for k, v in L.init(2).items()}))
    assert {(g.lang_pred, g.score) for g in L.identify_languages(df).collect()} == {("a", 0.5)}


def naive_features(text):
    """Buckets of tokens and neighbours, with plain integers."""
    m = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    from terrasift.llm.common import BYTE_VALUE, STEP
    tokens = re.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\t-\r\x1c-\x20]+", (text or "").encode())
    hs = [mix(sum(int(BYTE_VALUE[c]) * pow(int(STEP), i, 1 << 64) for i, c in enumerate(t)) & m) for t in tokens]
    return [h % Q.BUCKETS for h in hs] + [mix((a * 3 + b) & m) % Q.BUCKETS for a, b in zip(hs, hs[1:])]


def test_quality_against_plain_counts(spark):
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["ab", "cd!", "é", "f_g", "x-y", "\t", "9"]) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(100, None), (7, "again"), (None, "no id")]
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(40)] + [(0, 1, 0)]
    got, _, _ = Q.select_quality(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    good = {i for i in range(1, 40) if i % 3 and i % 7}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(naive_features(t))
        if i in good:
            target.update(naive_features(t))
    n_raw, n_target = sum(raw.values()) + Q.BUCKETS, sum(target.values()) + Q.BUCKETS
    score = [sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in naive_features(t)) for _, t in rows]
    noise = lambda i: -math.log(-math.log((int(hashlib.md5(f"quality|{'null' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48))
    key = [s + noise(i) for s, (i, _) in zip(score, rows)]
    fine = len([i for i in range(1, 40) if i % 3])  # the labels of 0 disagree
    k = math.ceil((fine + Q.SLACK * (39 - fine)) / 39 * len(rows))
    least = sorted(key, reverse=True)[k - 1]
    want = sorted(((i, round(s, 6), round(x, 6), x >= least) for (i, _), s, x in zip(rows, score, key)), key=str)
    assert sorted(((g.doc_id, round(g.score, 6), round(g.draw_key, 6), g.kept) for g in got.collect()), key=str) == want


def test_quality_ties_at_the_last_place(spark):
    df = spark.createDataFrame([(5, "the same words")] * 40 + [(6, "bad ! bad !")] * 10, "doc_id long, text string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.select_quality(df, labels)[0].groupBy("doc_id", "kept").count().collect()
    assert {(g.doc_id, g.kept): g["count"] for g in got} == {(5, True): 40, (6, False): 10}
    assert Q.quality_filter(df.limit(0), labels).count() == 0


STANDARD = "/usr/share/common-licenses"
WHOLE = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0",
         "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_whole_licence_texts_and_sentences_in_comments(spark):
    rows = [(i, f"{n}/LICENSE", open(f"{STANDARD}/{n}", errors="replace").read(), x) for i, (n, x) in enumerate(WHOLE.items()) if os.path.exists(f"{STANDARD}/{n}")]
    notice = "\n * ".join(["/* This program is free software; you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by",
                           "the Free Software Foundation; either version 2 of the License, or", "(at your option) any later version. */"])
    rows += [(100, "x/a.py", "# Copyright 2020 Acme. Released under the MIT License. And more words follow here.\ncode", "MIT"), (101, "y/a.py", notice, "GPL-2.0"),
             (102, "z/a.py", "// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), (103, "v/a.py", "This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0")]
    got = scan_licenses(spark.createDataFrame([r[:3] for r in rows], "doc_id long, path string, text string")).collect()
    assert {g.doc_id: g.license for g in got} == {r[0]: r[3] for r in rows}


def test_licence_ties(spark):
    mit, bsd = "Released under the MIT License.", "Released under the BSD 3-Clause License."
    rows = [(1, "a/x.py", f"{mit}\n{bsd}"), (2, "b/LICENSE.z", mit), (3, "b/LICENSE.a", bsd), (4, "b/x.py", "code")]
    got = {g.doc_id: (g.license, g.origin) for g in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("BSD-3-Clause", "header") and got[4] == ("BSD-3-Clause", "inherited")  # first identifier; first path
