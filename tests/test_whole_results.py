"""Queries return all that they are asked for, on small tables of their own."""

from collections import Counter

from terrasift import catalog
from terrasift.functions.text import STOP_WORDS

from .test_functions import buffer_counts


def folder(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_anchored_ngrams_of_any_count(spark, tmp_path):
    texts = {1: "alpha beta gamma delta epsilon", 2: "red red red blue red red green", 3: "lone word"}
    assert not set(" ".join(texts.values()).split()) & set(STOP_WORDS)
    d = folder(spark, tmp_path, "documents", sorted(texts.items()), "doc_id long, text string")
    got = {(r.doc_id, r.key): r.cnt for r in catalog.queries()["anchored_ngrams"](spark, d).collect()}
    assert got == {(i, k): n for i, t in texts.items() for k, n in buffer_counts(t.split()).items()}
    assert {1, 2} <= set(Counter(got.values()))


MIXED = [(i, f"text {i}", "en", ("src0", "src5", "elsewhere", None)[i % 4], 6) for i in range(400)]


def test_mixing_keeps_null_and_unknown_sources(spark, tmp_path):
    import corpus_pipeline
    from terrasift.llm.queries import queries
    d = folder(spark, tmp_path, "documents", MIXED, "doc_id long, text string, lang string, source string, n_chars int")
    rows = queries()["op3_mix_sources"](spark, d).collect()
    assert {r.source: r.rate for r in rows} == {"src0": round(16 / 7, 9), **dict.fromkeys(("src5", "elsewhere", None), round(4 / 7, 9))}
    staged = corpus_pipeline.mixing_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()
    assert sorted(r.doc_id for r in staged) == sorted(r.doc_id for r in rows)
    assert 30 < sum(r.source is None for r in staged) < 90


LICENCES = {
    "# Copyright 2020 Acme. Released under the MIT License.": "MIT",
    "one two three four five six seven eight nine ten eleven twelve Released under the MIT License. thirteen fourteen fifteen sixteen seventeen eighteen nineteen": "MIT",
    " * Licensed under the\n * Apache License,\n * Version 2.0. Some other words of the file follow here": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "the driver must show a license at the border": None,
}


def test_licences_inside_longer_lines_and_close_variants(spark):
    from terrasift.llm.licenses import scan_licenses
    rows = [(i, f"d{i}/a.txt", t) for i, t in enumerate(LICENCES)]
    got = {r.doc_id: r.license for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == dict(enumerate(LICENCES.values()))


def test_vbyte_large_of_keys_whose_product_leaves_a_long(spark, tmp_path):
    keys = [1, 7, 271_171, 271_172, 900_000, 9_000_001, 1 << 40]
    d = folder(spark, tmp_path, "orders", [(k,) for k in keys], "o_orderkey long")
    got = {r.o_orderkey: (r.size, r.back) for r in catalog.queries()["vbyte_large"](spark, d).collect()}
    n = {k: k * (7919 << 32) % ((1 << 62) + 1) + 3 for k in keys}
    assert got == {k: (max(1, -(-n[k].bit_length() // 7)), True) for k in keys}


def test_gazetteer_needs_no_index(spark, tmp_path):
    import shutil

    from terrasift.plans import overlay as O
    d = shutil.copytree("/root/testdata/sf0.001", tmp_path / "t")
    assert catalog.queries()["county_population"](spark, str(d)).count() and O.gazetteer(spark, str(d)).count() > 25
    assert [k for k in O._kept if k[1] == str(d)] == [(spark.sparkContext.applicationId, str(d), "geo")]


def test_documents_are_dealt_by_size_and_counted_without_another_shuffle(spark, monkeypatch):
    from terrasift.plans import overlay as O
    few = O.dealt(spark, "/root/testdata/sf0.001").rdd.getNumPartitions()
    monkeypatch.setattr(O, "DEALT_BYTES", 1 << 12)
    assert O.dealt(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 2 * few
    plan = catalog.queries()["positional_postings"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_tags_by_class_equal_tags_by_place(spark):
    from terrasift.operators import geo as G
    rows = [(1, "ohio", "STATE", None, 1), (2, "iowa", "STATE", None, 2), (3, "lake", "COUNTY", None, 1), (9, "usa", "NATION", None, None), (8, "lake", "CITY", 900_000, None)]
    rows += [(100 + i, "lake", "CITY", 900_000, 1 + i % 2) for i in range(30)] + [(200, "ohio", "CITY", 900_000, 2)]
    geo = spark.createDataFrame([(*r, "s" if r[4] else "") for r in rows], "id long, name string, type string, population int, state_id long, state_name string")
    texts = {1: "ohio lake " * 3, 2: "lake " * 5, 3: "iowa lake usa " * 4, 4: "ohio iowa lake " * 3, 5: "ohio ohio lake lake lake"}
    grams = G.grams_of_words(spark.createDataFrame([(i, t.split()) for i, t in texts.items()], "doc_id long, words array<string>")).cache()
    names, out = G.name_keys(geo), lambda df: sorted(map(tuple, df.collect()))
    tags = G.place_tags(G.place_counts(grams, names), geo)
    places = G.place_classes(names, geo)
    by_class = G.class_tags(G.key_counts(grams, places), places)
    assert by_class.count() < tags.count() and out(tags) == out(G.tags_of_classes(by_class, places))
    assert out(G.place_totals(tags)) == out(G.class_totals(by_class).join(places, G.CLASS).select("geo_id", "total"))
    m = spark.createDataFrame([(s, d) for s in (7, 8) for d in range(1, 6 - s % 2)], "sub_id long, doc_id long")
    assert out(G.suggest(m, tags, 0.01, 5)) == out(G.suggest_classes(m, by_class, places, 0.01, 5)) != []
