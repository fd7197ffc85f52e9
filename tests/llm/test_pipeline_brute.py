"""The pipeline's rows against plain Python, stage by stage, on a table with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from terrasift.llm import mixing, quality as Q
from terrasift.llm.common import Table

from .test_exact_and_mixing import low, poisson_count
from .test_models import naive_features
from .test_ngram_join import brute

public = pytest.importorskip("public_tokenizers")


def corpus():
    r = random.Random(12)
    vocab = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(90):
        t = " ".join(r.choice(vocab) + ("!!" if i % 5 == 0 else "") for _ in range(r.choice([3, 12, 60])))
        rows.append((i, t, "en", r.choice(["src0", "src5", "elsewhere", None]), i))
    near = rows[7][1].split() if len(rows[7][1].split()) == 60 else [r.choice(vocab) for _ in range(60)]
    rows += [(200, " ".join(near), "en", "src0", 1), (201, " ".join(near[:59] + ["other"]), "en", "src1", 1), (202, " ".join(near).upper(), None, "src0", None),
             (203, None, "en", "src0", None), (204, "", None, None, 0), (205, " \n", "en", "src2", 0), (206, "long " * 30_000, "en", "src3", 1)]
    return rows


def test_rows_of_the_pipeline(spark, tmp_path):
    import sentencepiece

    import corpus_pipeline as p
    rows, labels = corpus(), [(i, int(i % 5 > 0), 0) for i in range(0, 90, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted(tuple(r) for r in p.run(spark, str(tmp_path)).collect())

    # quality
    good = {i for i, q, _ in labels if q}
    raw, target = np.ones(Q.BUCKETS), np.ones(Q.BUCKETS)
    feats = {r[0]: naive_features(r[1]) for r in rows}
    for i, f in feats.items():
        np.add.at(raw, f, 1)
        if i in good:
            np.add.at(target, f, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    u = lambda *s: (int(hashlib.md5("|".join(map(str, s)).encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    key = {i: ratio[f].sum() - math.log(-math.log(u("quality", i))) for i, f in feats.items()}
    k = math.ceil((len(good) + Q.SLACK * (len(labels) - len(good))) / len(labels) * len(rows))
    cut = sorted(key.values(), reverse=True)[k - 1]
    docs = [r for r in rows if key[r[0]] >= cut]
    assert {r[0] for r in rows if r[0] in good} <= {r[0] for r in docs}
    # exact copies: the largest id stays
    last = {low(r[1]): r for r in sorted(docs)}
    docs = sorted(last.values())
    # near copies: the least id of a class stays
    classes = brute([(r[0], r[1]) for r in docs])
    docs = [r for r in docs if classes[r[0]][0] == r[0]]
    # mixing
    weight = {s: mixing.QUERY_WEIGHTS.get(s, mixing.OTHER_WEIGHT) for s in {r[3] or "" for r in docs}}
    size = {s: sum((r[3] or "") == s for r in docs) for s in weight}
    rate = {s: len(docs) * w / sum(weight.values()) / size[s] for s, w in weight.items()}
    assert max(rate.values()) <= mixing.MAX_DRAWN_RATE
    docs = [r for r in docs for _ in range(poisson_count(rate[r[3] or ""], u("mix", r[0])))]
    # encoding
    lib = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = []
    for r in docs:
        ids = lib.encode(r[1] or "", add_bos=True, add_eos=True)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert got == sorted(want) and len(got) > 40


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline as p
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, __gone string, copy int, `row` string"
    rows = [(i, f"some words of text number {i} that stand here", "en", "src0", 1, "s", "g", 3, "r") for i in range(12)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for i, (_, stage) in enumerate(p.STAGES):
            out = Table(stage(spark, docs, str(tmp_path)), "stage").df
            if i < 4:
                assert out.columns == docs.columns
                docs = out
        assert out.count() == docs.count() and (not data) == (not out.count())
