import random
from collections import Counter, defaultdict

from terrasift.llm.ngram_join import least_matches, near_dedup, similar_classes

SCHEMA = "doc_id long, text string, class_id string"


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return low.split()


def brute(rows, n=5, num=4, den=5):
    """(class, links) by id, from all pairs."""
    sets = []
    for _, t in rows:
        w = words_of(t)
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    index = defaultdict(list)
    inter = Counter()
    for i, s in enumerate(sets):
        for x in s:
            for j in index[x]:
                inter[j, i] += 1
            index[x].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = Counter()
    for (i, j), k in inter.items():
        if den * k >= num * (len(sets[i]) + len(sets[j]) - k):
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b, key=lambda r: rows[r][0])] = min(a, b, key=lambda r: rows[r][0])
    return {rows[i][0]: (rows[find(i)][0], links[i]) for i in range(len(rows))}


def corpus(seed=5):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows, k = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 12, 40, 120]))]
        for _ in range(r.choice([1, 2, 6, 20])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((k, " ".join(w)))
            k += 1
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    got = similar_classes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    want = brute(rows)
    assert {g.doc_id: (g.class_id, g.n_links) for g in got} == want


def test_small_blocks_agree(spark, monkeypatch):
    import terrasift.llm.ngram_join as m
    rows = corpus(9)
    monkeypatch.setattr(m, "BLOCK_NODES", 4)
    got = m.similar_classes(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert {g.doc_id: (g.class_id, g.n_links) for g in got} == brute(rows)


def test_chains_are_compared_by_bucket(spark, monkeypatch):
    """A chain of overlapping texts is one component; what is dealt grows with its length, and results are all pairs'."""
    import terrasift.llm.ngram_join as m
    monkeypatch.setattr(m, "BLOCK_NODES", 4)
    dealt, groups = [], m._groups

    def counting(member, nodes):
        found = groups(member, nodes)
        dealt.append(found.selectExpr("sum(blocks)", "min(band)").first())
        return found

    monkeypatch.setattr(m, "_groups", counting)
    r = random.Random(3)
    stream = [f"w{r.randrange(10**6)}" for _ in range(2600)]
    for n in (120, 240):
        rows = [(k, " ".join(stream[k * 10 : k * 10 + 110])) for k in range(n)]
        got = m.similar_classes(spark.createDataFrame([(*x, "x") for x in rows], SCHEMA)).collect()
        assert {g.doc_id: (g.class_id, g.n_links) for g in got} == brute(rows)
    (small, _), (large, band) = dealt
    assert band >= 0 and large < 2.3 * small


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "one two three four five six", "a"), (4, "a b", "b"), (5, "A  b", "b"),
            (6, "one two three four five six", "a"), (6, "one two three four five six", "a"), (7, "x" * 200_000, "a")]
    got = sorted(map(tuple, similar_classes(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "class_id", "n_links", "n_copies").collect()), key=str)
    assert got == sorted([(1, 1, 0, 1), (2, 2, 0, 1), (3, 3, 0, 1), (None, None, 0, 1), (4, 4, 1, 2), (5, 4, 1, 2), (6, 6, 1, 2), (6, 6, 1, 2), (7, 7, 0, 1)], key=str)
    kept = near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "class_id"] and kept.count() == len(rows) - 1
    assert similar_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pruning_bound():
    need = least_matches(0.8, 1e-9)
    assert need[20] < need[100] < need[200] < 160


def thue(n, a, b):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_words_that_a_polynomial_hash_cannot_tell_apart(spark):
    a, b = thue(1024, "a", "b"), thue(1024, "b", "a")
    rows = [(1, a, "x"), (2, b, "x"), (3, f"one two three four {a}", "x"), (4, f"one two three four {b}", "x"), (5, a.upper(), "x")]
    got = similar_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {g.doc_id: (g.class_id, g.n_copies) for g in got} == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (1, 2)}
    clash = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("class_id", "__gone")
    assert sorted(r.doc_id for r in near_dedup(clash).collect()) == [1, 2, 3, 4]


def _peak(run):
    """Most bytes that numpy and Python held at once beyond what they held before, and the result."""
    import tracemalloc
    tracemalloc.start()
    try:
        got = run()
        return tracemalloc.get_traced_memory()[1], got
    finally:
        tracemalloc.stop()


def test_a_block_takes_little_more_than_its_texts():
    import numpy as np
    import pyarrow as pa

    import terrasift.llm.ngram_join as N
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 12))) for _ in range(4000)]
    texts = [" ".join(rng.choices(vocab, k=550)) for _ in range(1000)] + ["", "one two", "x" * 300_000]
    size = sum(map(len, texts))
    N._sets(pa.array(texts[:2]), 5)
    peak, (sets, sigs) = _peak(lambda: N._sets(pa.array(texts, pa.string()), 5))
    assert peak < 20 * size, (peak, size)  # taken whole, one array of positions alone has 8 bytes a byte
    assert [len(s) for s in sets[-3:]] == [0, 1, 1]
    for i in (0, 500, 999):
        w = texts[i].split()
        assert len(sets[i]) == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
        assert (sigs[i] == N._sets(pa.array([texts[i]]), 5)[1][0]).all()

    n = 1024  # all pairs are candidates and all of them are links
    same, one = [np.arange(50)] * n, np.repeat(sigs[:1], n, 0)
    half = np.arange(n // 2)
    peak, (a, b) = _peak(lambda: N._links(same, one, half, half + n // 2, False, 0.8))
    assert len(a) == len(b) == (n // 2) ** 2 and len(set(zip(a.tolist(), b.tolist()))) == len(a)
    assert peak < 40e6, peak


def test_words_are_compared_in_pieces(monkeypatch):
    import numpy as np

    from terrasift.llm import bpe
    rng = random.Random(6)
    words = [rng.choice(["ab", "cd", "abc", "x" * 40, "y" * 40]).encode() for _ in range(500)]
    lens = np.array([len(w) for w in words])
    for pieces in (1, 64, 1 << 18):
        monkeypatch.setattr(bpe, "COMPARED", pieces)
        one, which = bpe.distinct(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lens) - lens, lens, np.zeros(500, np.uint64))
        assert [words[one[i]] for i in which] == words and len(one) == len(set(words))
