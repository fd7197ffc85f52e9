import hashlib
import random
from collections import Counter, defaultdict

from terrasift.llm import mixing
from terrasift.llm.exact_dedup import exact_dedup, exact_groups

SCHEMA = "doc_id long, text string, source string, salt string, rn int"


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[low(r[1])]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), hashlib.sha256(low(r[1]).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus():
    r = random.Random(2)
    rows = []
    for i in range(400):
        t = r.choice(["", None, "Same", "same", "SAME", "É", "é", "ΑΣ", "ας", "x" * 1000 + str(i % 3), "x" * 999 + "Y" + str(i % 3), f"own {i}", "İ", "i̇"])
        rows.append((i, t, "s", "a", i))
    rows += [(500, "dup row", "s", "a", 1), (500, "dup row", "s", "a", 1), (None, "null id", "s", None, None), (None, "null id", None, "a", 1), (7, "null id", "s", "a", 0), (600, "y" * 300_000, "s", "b", 2)]
    return rows


def check(spark, rows):
    got = exact_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=str) == brute(rows)
    kept = Counter(g.text_sha256 for g in got if g.kept)
    assert set(kept) == {b[3] for b in brute(rows)} and set(kept.values()) <= {1}


def test_against_brute_force(spark):
    check(spark, corpus())


def test_salted_groups_agree(spark, monkeypatch):
    import terrasift.llm.exact_dedup as m
    monkeypatch.setattr(m, "HOT_ROWS", 2)
    check(spark, corpus())


def test_rows_that_stay_keep_their_columns(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = exact_dedup(df)
    assert out.columns == df.columns
    assert out.count() == len({low(r[1]) for r in corpus()})
    assert exact_dedup(df.limit(0)).count() == 0


def poisson_count(rate, u):
    from math import exp
    p = cdf = exp(-rate)
    k = 0
    while cdf < u and k < 80:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_counts_follow_the_inverse_distribution(spark):
    rows = [(i, "t", "ab"[i % 4 == 0], None, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r.doc_id for r in mixing.mix_sources(df, {"a": 1.0, "b": 1.0}, budget=1.5).collect())
    for i, _, s, _, _ in rows:
        n = 1500 if s == "a" else 500
        u = (int(hashlib.md5(f"mix|{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        assert got[i] == poisson_count(1.5 * 2000 / 2 / n, u)
    share = sum(v for i, v in got.items() if i % 4 == 0) / sum(got.values())
    assert abs(share - 0.5) < 0.05


def test_order_is_global_and_rates_may_be_large(spark):
    df = spark.createDataFrame([(1, "a", "x", None, 0), (2, "b", "x", None, 0), *[(i, "c", "y", None, 0) for i in range(3, 203)]], SCHEMA)
    out = mixing.mix_sources(df, {"x": 1.0, "y": 0.0}).collect()
    assert {r.doc_id for r in out} == {1, 2} and 120 < len(out) < 290
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)


def test_odd_sources(spark):
    df = spark.createDataFrame([(1, None, None, "a", 0), (None, "", "s", "b", 1), (1, None, None, "a", 0)], SCHEMA).withColumnRenamed("salt", "copy").withColumnRenamed("rn", "rate")
    out = mixing.mix_sources(df, None, budget=3.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "rate", "_copy", "_rate", "shuffle_key"]
    assert out.count() >= 1
    assert mixing.mix_sources(df.limit(0), None).count() == 0


def test_large_rates_are_poisson(spark):
    """Rates of 50.5: mean and variance both near it; the sum of three draws of a third each."""
    rows = [(i, "t", "few", None, 0) for i in range(400)] + [(i, "t", "many", None, 0) for i in range(400, 20_200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r.doc_id for r in mixing.mix_sources(df, {"few": 1.0, "many": 0.0}).select("doc_id").collect())
    n = [got[i] for i in range(400)]
    rate = 20_200 / 400
    mean = sum(n) / 400
    assert abs(mean - rate) < 1.5 and 0.75 * rate < sum((x - mean) ** 2 for x in n) / 399 < 1.3 * rate
    for i in range(400):
        us = [(int(hashlib.md5(x.encode()).hexdigest()[:12], 16) + 0.5) / 2**48 for x in (f"mix|{i}", f"mix|{i}|2", f"mix|{i}|3")]
        assert got[i] == sum(poisson_count(rate / 3, u) for u in us)


def test_one_document_of_a_heavy_source_is_copied_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_A_TASK", 32)
    df = spark.createDataFrame([(1, "a", "x", None, 0), *[(i, "c", "y", None, 0) for i in range(2, 202)]], SCHEMA)
    out = mixing.mix_sources(df, {"x": 1.0, "y": 0.0}).collect()
    assert {r.doc_id for r in out} == {1} and sorted(r.copy for r in out) == list(range(1, len(out) + 1)) and 140 < len(out) < 270


def test_columns_named_like_the_inner_ones(spark):
    df = spark.createDataFrame([(i, "t", "s", "a", i) for i in range(30)], SCHEMA)
    want = sorted(r.doc_id for r in mixing.mix_sources(df, None).collect())
    for name in ("__src", "__rate", "__u", "__n", "__copy", "__key"):
        out = mixing.mix_sources(df.withColumnRenamed("rn", name), None)
        assert name in out.columns and sorted(r.doc_id for r in out.collect()) == want
        assert all(r[name] == r.doc_id for r in out.collect())
