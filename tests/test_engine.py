"""Whole searches on a small corpus and gazetteer, sources and sinks, streaming."""

import pytest
from pyspark.sql import functions as F

from terrasift.engine import Engine
from terrasift.operators import evaluate as E, geo as G, graph, match as M, rank as R
from terrasift.operators.index import Index, build_index
from terrasift.sources import readers, sinks
from terrasift.streaming import incremental

DOCS = [
    (1, "Springfield zoo guide", "the springfield zoo in springfield ohio has a zoo and a park " * 3),
    (2, "Springfield Illinois", "springfield illinois zoo zoo zoo and lakes of illinois " * 3),
    (3, "Dayton", "dayton ohio zoo zoo animals near springfield " * 3),
    (4, "Statue", "the statue of liberty in new york"),
    (5, "York", "york new statue liberty"),
    (6, "one", "alone"),
]


@pytest.fixture(scope="module")
def geo(spark):
    cities = spark.createDataFrame(
        [(100, "Springfield", "OH", "1", 300000, 0.0, 0.0, 1.0, 2.0), (101, "Springfield", "IL", "2", 250000, 900000.0, 0.0, 1.0, 2.0), (102, "Dayton", "OH", "1", 150000, 1000.0, 0.0, 1.0, 2.0),
         (103, "New York City", "NY", "", 8000000, 0.0, 5e6, 1.0, 2.0)],
        "id long, name string, admin1 string, admin2 string, population int, x double, y double, lat double, lon double")
    counties = spark.createDataFrame([("US.OH.001", "Clark", 10, 1.0, 2.0), ("US.IL.002", "Sangamon", 11, 1.0, 2.0)], "code string, name string, id long, lon double, lat double")
    states = spark.createDataFrame([("US.OH", "Ohio", 1, 1.0, 2.0), ("US.IL", "Illinois", 2, 1.0, 2.0), ("US.NY", "New York", 3, 1.0, 2.0)], "code string, name string, id long, lon double, lat double")
    return Engine.load_places(cities, counties, states).cache()


@pytest.fixture(scope="module")
def engine(spark, geo):
    source = spark.createDataFrame(DOCS, "doc_id long, title string, text string")
    return Engine.index(source, geo, G.neighbours(geo.where("type = 'CITY'")))


def test_gazetteer(geo):
    at = {r.id: r for r in geo.collect()}
    assert (at[100].county_id, at[100].state_id, at[100].state_name) == (10, 1, "Ohio")
    assert (at[103].county_id, at[103].state_id) == (None, 3)
    parents = {r.id: r.parent_id for r in G.parents(geo).collect()}
    assert parents[103] == 3 and parents[10] == 1 and parents[1] == G.NATION_ID
    keys = {(r.key, r.id) for r in G.name_keys(geo).collect()}
    assert ("dayton ohio", 102) in keys and ("springfield", 100) in keys and ("new york city", 103) in keys


def test_index_and_phrases(spark, engine):
    ix = engine.index if isinstance(engine.index, Index) else None
    assert ix.docs.count() == 5
    q = M.query_frame(spark, [(0, ["statue liberty"]), (1, ["zoo", "ohio"]), (2, ["zoo", "nowhere"])])
    found = {(r.sub_id, r.doc_id) for r in M.matches(ix, q).collect()}
    assert found == {(0, 4), (0, 5), (1, 1), (1, 3)}


def test_ambiguous_search(engine):
    a = engine.search("springfield zoo")
    assert a.query.supporting == ["zoo"] and set(a.query.candidates) <= {100, 101}
    assert a.query.mode in ("AMBIGUOUS", "EXPANSION", "NONE") and a.results.count() == 3
    assert a.decisions[0][2] is True
    assert "Springfield" in (a.geojson or "Springfield")
    assert "<html>" in engine.html(a)


def test_place_choice_and_best(engine):
    a = engine.search("springfield zoo", place=[100], uname=["ohio"])
    assert a.query.supporting and "ohio" in a.query.tokens
    b = engine.search("zoo", place=[100, 101], best=True)
    scores = [r.score for r in b.results.collect()]
    assert scores == sorted(scores, reverse=True) and b.results.count() == 3
    assert engine.search("the of").results.count() == 0
    with pytest.raises(ValueError):
        engine.search("zoo", ranker="other")


def test_feedback_sums_to_one(engine):
    p = engine.prf("springfield zoo").collect()
    assert abs(sum(r.prob for r in p) - 1) < 1e-5


def test_resolve_uniqify_expand(spark, geo):
    c = spark.createDataFrame([(0, 0, 100), (0, 1, 1), (1, 0, 100), (1, 1, 101)], "query long, ord int, id long")
    assert {(r.query, r.id) for r in G.resolve(c, geo).collect()} == {(0, 100), (1, 100), (1, 101)}
    u = G.uniqify(c.join(geo.select("id", "name", "type", "state_name", "county_name"), "id"))
    assert {(r.query, r.unique_name) for r in u.collect()} == {(0, "Springfield"), (0, "Ohio"), (1, "Springfield,Ohio"), (1, "Springfield,Illinois")}
    near = G.neighbours(geo.where("type = 'CITY'"))
    assert {(r.id, r.near_id) for r in near.collect()} == {(100, 102), (102, 100)}
    e = G.expand(spark.createDataFrame([(0, 100), (1, 1)], "query long, id long"), geo, near)
    assert {(r.query, r.kind, r.id) for r in e.collect()} == {(0, "near", 102), (0, "county", 10), (1, "counties", 10), (1, "cities", 100), (1, "cities", 102)}


def test_page_rank_forms(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("d", "c")], "src string, dst string")
    got = {r.v: r["rank"] for r in graph.pagerank_parity(edges).collect()}
    s = {"a": 0, "b": 0.5, "c": 2.5, "d": 0}
    assert all(abs(got[v] - (0.1 + 0.9 * x) * (1 + 0.9 * x) / 4) < 1e-12 for v, x in s.items())
    full = {r.v: r["rank"] for r in graph.pagerank(edges, 30).collect()}
    assert abs(sum(full.values()) - 1) < 1e-9 and max(full, key=full.get) == "c"
    folded = graph.fold(edges, spark.createDataFrame([("b", "a")], "alias string, canonical string"))
    assert {(r.src, r.dst) for r in folded.collect()} == {("a", "c"), ("d", "c")}


def test_metrics(spark):
    res = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("q", 3, 3), ("p", 9, 1)], "query string, doc_id long, rank int")
    jud = spark.createDataFrame([("q", 2, "Perfect"), ("q", 3, "Fair"), ("q", 8, "Good")], "query string, doc_id long, grade string")
    got = {r["query"]: r for r in E.evaluate(res, jud).collect()}
    assert got["q"].precision_1 == 0 and got["q"].precision_5 is None and got["q"].reciprocal_rank == 0.5
    assert got["p"].average_precision == 0 and abs(got["q"].average_precision - (0 + 1 / 2 + 1 / 3) / 3) < 1e-12
    assert E.evaluate(res, jud, -1).count() == 2
    v = spark.createDataFrame([(i, float(i), float(-i)) for i in range(1, 8)], "doc long, x double, y double")
    assert abs(E.spearman(v, False).first().rho + 1) < 1e-12


def test_save_load_and_stream(spark, engine, tmp_path):
    engine.index.save(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    assert again.terms.count() == engine.index.terms.count()
    spark.createDataFrame(DOCS[:3], "doc_id long, title string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, title string, text string").parquet(str(tmp_path / "in"))
    incremental.start(stream, str(tmp_path / "inc"), str(tmp_path / "ck")).awaitTermination()
    spark.createDataFrame(DOCS[3:], "doc_id long, title string, text string").write.mode("append").parquet(str(tmp_path / "in"))
    incremental.start(stream, str(tmp_path / "inc"), str(tmp_path / "ck")).awaitTermination()
    ix = incremental.load(spark, str(tmp_path / "inc"))
    key = lambda d: sorted(map(tuple, d.select("term", "df", "ctf").collect()))
    assert key(ix.terms) == key(engine.index.terms)


def test_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "A").write_text("<title>A</title><p>one two</p>")
    (tmp_path / "c" / ".hidden").write_text("x")
    d = readers.html_corpus(spark, str(tmp_path / "c")).collect()
    assert [(r.file_name, r.text) for r in d] == [("A", "A one two")]
    (tmp_path / "n.txt").write_text("1,5:6\n\n2,\n3,1\n")
    n = readers.neighbour_file(spark, str(tmp_path / "n.txt"))
    assert sorted(map(tuple, n.collect())) == [(1, 5, 1), (1, 6, 2), (3, 1, 1)]
    assert sorted(r.line for r in sinks.neighbour_lines(n).collect()) == ["1,5:6", "3,1"]
    (tmp_path / "j.tsv").write_text("q\t1\tPerfect\nq\t2\tBad\n")
    assert readers.judgments(spark, str(tmp_path / "j.tsv")).count() == 2
    (tmp_path / "r.tsv").write_text("q\t7\tx\nq\t5\tx\np\t1\tx\n")
    assert {(r["query"], r.doc_id, r["rank"]) for r in readers.ranked_results(spark, str(tmp_path / "r.tsv")).collect()} == {("q", 7, 1), ("q", 5, 2), ("p", 1, 1)}
    (tmp_path / "st.csv").write_text("code,x,name,id,lon,lat\nUS.GA,,Georgia,1,-83,32\nXX,,No,2,0,0\n")
    assert [(r.code, r.id) for r in readers.states(spark, str(tmp_path / "st.csv")).collect()] == [("US.GA", 1)]


def test_empty_corpus(spark):
    ix = build_index(spark.createDataFrame([], "doc_id long, text string"))
    q = M.query_frame(spark, [(0, ["a"])])
    assert R.top_k(R.score(ix, q), 3).count() == 0
    assert ix.stats.select(F.col("n_docs")).first()[0] == 0


def test_page_rank_blend(spark, engine):
    from dataclasses import replace
    ix = replace(engine.index, docs=engine.index.docs.withColumn("page_rank", F.when(F.col("doc_id") == 3, 9.0).otherwise(0.0)))
    q = M.query_frame(spark, [(0, ["zoo"])])
    plain = {r.doc_id: r.score for r in R.score(ix, q).collect()}
    mixed = {r.doc_id: r.score for r in R.score(ix, q, blend_page_rank=True).collect()}
    assert abs(mixed[3] - 10 * plain[3]) < 1e-9 and mixed[1] == plain[1]
    assert R.by_page_rank(ix, q, 1).first().doc_id == 3


def test_crawler():
    from terrasift.operators.crawl import Crawler
    web = {"http://a.x/": '<a href="/b"> <a href="/c#z"> <a href="http://other.y/">', "http://a.x/b": '<a href="/">', "http://a.x/c": ""}

    def fetch(url):
        if url not in web:
            raise OSError(url)
        return web[url]

    for order in ("fifo", "random"):
        c = Crawler(fetch, "a.x", order)
        assert {u for u, _ in c.run(["http://a.x/", "ftp://a.x/"])} == set(web)
        assert c.visits["http://a.x/"] == 2 and len(c) == 0


def test_server(engine):
    import threading
    from urllib.request import urlopen

    from terrasift.server import make_server
    s = make_server(engine, 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{s.server_address[1]}"
    lines = urlopen(f"{base}/search?query=zoo+ohio&numdocs=5").read().decode().splitlines()
    assert {x.split("\t")[0] for x in lines} == {"1", "3"}
    assert "<html>" in urlopen(f"{base}/search?query=zoo&format=html").read().decode()
    assert "zoo" in urlopen(f"{base}/prf?query=zoo").read().decode()
    assert urlopen(f"{base}/other").read().decode() == "Only /search is handled!"
    s.shutdown()


def test_neighbours_of_a_crowd(spark):
    """Against all pairs, with crowded and lonely cells, ties and unknown populations; no pairs pass between stages."""
    import random
    rnd = random.Random(5)
    spot = lambda i: (rnd.randrange(40_000), rnd.randrange(40_000)) if i % 3 else (rnd.randrange(-400_000, 400_000), rnd.randrange(-400_000, 400_000))
    rows = [(i, *spot(i), rnd.choice([None, 5, 5, 80, 900])) for i in range(700)]
    cities = spark.createDataFrame(rows, "id long, x long, y long, population int")
    by = sorted(rows, key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    for top in (5, 20):
        want = {(a[0], b[0], k) for a in rows for k, b in enumerate([b for b in by if b[0] != a[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 50_000 ** 2][:top], 1)}
        near = G.neighbours(cities, top=top)
        assert {(r.id, r.near_id, r["rank"]) for r in near.collect()} == want
        plan = near._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Window" not in plan
    assert G.neighbours(cities.limit(0)).collect() == []


def test_document_index_and_its_lookups(spark):
    """Against the index by terms: counts, phrases, strengths; and no row a query and document is shuffled."""
    import random

    from terrasift.operators import feedback
    from terrasift.operators.index import document_index
    from terrasift.operators.understand import segment_batch
    rnd = random.Random(8)
    words = "er lake ohio mill pond the".split()
    source = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(14)))) for i in range(60)] + [(90, None), (91, "lone")], "doc_id long, text string")
    old, new = build_index(source), document_index(source)
    rows = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    for table in ("docs", "occurrences", "frequencies", "terms", "stats"):
        assert rows(getattr(old, table)) == rows(getattr(new, table))
    asked = [["lake"], ["lake ohio", "er"], ["er", "mill", "mill"], ["ohio ohio ohio"], ["er", "nowhere"], ["pond", "er", "lake"], ["er", "lake", "pond"]]
    q = M.query_frame(spark, list(enumerate(asked)))
    hits = lambda ix: M.token_hits(ix, q).select("sub_id", "ord", "token", "n_words", "doc_id", "tf")
    assert rows(hits(old)) == rows(hits(new)) and rows(hits(new))
    assert rows(segment_batch(old, q.where("token not like '% %'"))) == rows(segment_batch(new, q.where("token not like '% %'")))
    top = R.top_k(R.score(new, q), 3)
    assert rows(feedback.document_term_probabilities(old, top)) == rows(feedback.document_term_probabilities(new, top))
    for part in (q, q.where("token not like '% %'")):
        cols = ("sub_id", "n_hits", "total", "norm", "strength")
        assert rows(R.strengths(new, part).select(*cols)) == rows(R.sums(R.score(old, part)).select(*cols))
    many = spark.createDataFrame([(f"{s}", i, t) for s in range(500) for i, t in enumerate(("er", "lake"))], "sub_id string, ord int, token string")
    got = R.strengths(new, many)
    assert got.count() == 500 and "doc_id" not in got._jdf.queryExecution().optimizedPlan().toString()
