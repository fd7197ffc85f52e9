import hashlib
import random
import re
from collections import Counter

from terrasift.llm.repeated_spans import remove_repeats

SCHEMA = "doc_id long, text string, spans string"


def brute(rows, length, n_words=8):
    lists = [[w for w in re.split(r"[\t-\r\x1c-\x20]+", "".join(c.lower() if c < "\x80" else c for c in t or "")) if w] for _, t in rows]
    said = Counter(tuple(w[a : a + n_words]) for w in lists for a in range(len(w) - n_words + 1))
    covered = [len({x for a in range(len(w) - n_words + 1) if said[tuple(w[a : a + n_words])] > 1 for x in range(a, a + n_words)}) for w in lists]
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[a : a + length] for _, r in raws for a in range(len(r) - length + 1))
    out = []
    for (i, r), n in zip(raws, covered):
        gone = bytearray(len(r))
        for a in range(len(r) - length + 1):
            if seen[r[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(1 for a in range(len(r)) if gone[a] and (a == 0 or not gone[a - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest(), n))
    return sorted(out, key=str)


def got(spark, rows, length, k):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return sorted(map(tuple, remove_repeats(df, length, k, n_words=8, words_k=3).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    passages = [" ".join(word() for _ in range(r.randint(4, 60))) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(1, 5)):
            if r.random() < 0.5:
                p = r.choice(passages)
                a = r.randrange(len(p))
                parts.append(p[a : a + r.randint(10, 300)])
            else:
                parts.append(" ".join(word() for _ in range(r.randint(1, 25))))
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, rows[4][1][:-1] + "Z")]
    return rows


def test_against_every_window(spark):
    rows = corpus(1)
    assert got(spark, rows, 60, 16) == brute(rows, 60)


def test_periodic_and_odd_rows(spark):
    rows = [(1, "ab" * 400), (2, "x" * 500), (3, "x" * 90), (4, None), (5, ""), (6, "short"), (None, "q" * 39), (7, "abc" * 50 + "ab" * 60), (8, "same text that is repeated by a whole row" * 3),
            (8, "same text that is repeated by a whole row" * 3)]
    assert got(spark, rows, 60, 16) == brute(rows, 60)
    assert got(spark, [], 60, 16) == []


def test_window_of_the_query(spark):
    r = random.Random(4)
    base = "".join(r.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, base), (2, base[:399]), (3, "q" + base[100:500] + "z"), (4, "q" + base[100:499] + "zz"), (5, base[1000:1700] + "." + base[1701:2600]), (6, base[2000:2401])]
    assert got(spark, rows, 400, 96) == brute(rows, 400)


def test_long_passages_that_are_short_in_bytes(spark):
    """A passage of over 50 short words, under 400 bytes, in a very long text and a short one: found, not removed."""
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passage = " ".join(word(4) for _ in range(55))
    own = lambda n: " ".join(word(6) for _ in range(n))
    df = spark.createDataFrame([(1, f"{own(30_000)} {passage} {own(20)}", "x"), (2, passage.replace(" ", "\n").upper(), "x"), (3, own(300), "x")], SCHEMA)
    got = {g.doc_id: (g.n_removed, g.n_repeated_words) for g in remove_repeats(df).collect()}
    assert got == {1: (0, 55), 2: (0, 55), 3: (0, 0)}
