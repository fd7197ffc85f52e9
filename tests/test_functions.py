import random

import pytest
from pyspark.sql import functions as F

from terrasift.functions import text as T
from terrasift.functions.stemmer import stem
from terrasift.operators import understand as U
from terrasift.sources import readers


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_cleaners(spark):
    assert one(spark, "O'Fallon, St. Louis!", T.index_clean) == "o fallon  st  louis "
    assert one(spark, "O'Fallon", T.mining_clean) == "ofallon"
    assert one(spark, '  "New York" Zoo? ', T.query_clean) == '"new york" zoo'
    assert one(spark, " a  zoo in the Bronx ", lambda c: T.drop_stop_words(T.split_words(T.index_clean(c)))) == ["zoo", "bronx"]


def test_vbyte_codes(spark):
    r = random.Random(1)
    n = [0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28, *[r.randrange(2**31) for _ in range(50)]]
    got = spark.createDataFrame([(x,) for x in n], "n long").select("n", T.vbyte_encode(F.col("n")).alias("c"), T.vbyte_size(F.col("n")).alias("s")).collect()
    for g in got:
        want = []
        x = g.n
        while True:
            want.insert(0, x % 128)
            x //= 128
            if not x:
                break
        want[-1] += 128
        assert g.c == want and g.s == len(want)
    stream = [b for g in got for b in g.c]
    back = spark.createDataFrame([(stream,)], "c array<int>").select(T.vbyte_decode(F.col("c")).alias("n")).first().n
    assert back == [g.n for g in got]


def buffer_counts(words):
    """The three-word buffer, literally."""
    out, buf = {}, []
    for w in words:
        if len(buf) == 3:
            buf.pop(0)
        buf.append(w)
        for k in range(1, len(buf) + 1):
            key = " ".join(buf[:k])
            out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("n", range(9))
def test_anchored_ngrams_by_simulation(spark, n):
    from terrasift.operators.geo import grams_of_occurrences, grams_of_words, ngram_counts
    words = [f"w{i}" for i in range(n)]
    occ = spark.createDataFrame([(w, 1, i) for i, w in enumerate(words)], "term string, doc_id long, pos int")
    own = spark.createDataFrame([(1, words)], "doc_id long, words array<string>")
    for grams in (grams_of_occurrences(occ), grams_of_words(own)):
        assert {r.key: r.cnt for r in ngram_counts(grams, True).collect()} == buffer_counts(words)


def test_place_counts(spark):
    from terrasift.operators.geo import grams_of_occurrences, grams_of_words, place_counts
    texts = {1: "new york city in new york".split(), 2: ["york"], 3: [], 4: "new new york new".split()}
    own = spark.createDataFrame(list(texts.items()), "doc_id long, words array<string>")
    occ = spark.createDataFrame([(w, d, i) for d, ws in texts.items() for i, w in enumerate(ws)], "term string, doc_id long, pos int")
    names = spark.createDataFrame([("new york", 7), ("new york", 8), ("york", 9), ("new york city", 10), ("a b c d", 11), ("absent", 12)], "key string, id long")
    expected = {(1, 7): 2, (1, 8): 2, (1, 9): 2, (1, 10): 1, (2, 9): 1, (4, 7): 1, (4, 8): 1, (4, 9): 1}
    for grams in (grams_of_words(own), grams_of_occurrences(occ)):
        assert {(r.doc_id, r.geo_id): r.cnt for r in place_counts(grams, names).collect()} == expected


def test_stemmer():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "triplicate": "triplic",
             "revival": "reviv", "adjustment": "adjust", "probate": "probat", "rate": "rate", "controll": "control", "is": "is", "sky": "sky"}
    assert {w: stem(w) for w in pairs} == pairs


def test_html(spark):
    page = '<html><head><title> A &amp; B </title><style>p{}</style></head><body><table class="infobox x"><tr><td>Box</td></tr></table><p><b>One</b> two<p>three</p><!-- no --><script>var t="</p>";</script>tail</body></html>'
    assert one(spark, page, T.html_title) == "A &amp; B"
    assert one(spark, page, T.html_fields) == "A & B Box One two three"
    assert one(spark, '<a class="x" href="Other_page">x</a>\n<a href="/root">y</a><a href="a#b">z</a>', T.link_targets) == ["Other_page"]
    assert one(spark, "New York - Wikipedia, the free encyclopedia", T.redirect_key) == "new_york"


def test_urls(spark):
    assert one(spark, "http://a.b/c/d?e=f#g", T.url_file) == "c_d"
    assert one(spark, "http://a.b/c#g", T.clean_url) == "http://a.b/c"
    assert one(spark, "no url", T.url_ok) is False


def test_codes_and_grades(spark):
    d = spark.createDataFrame([("GA", "5"), ("GA", "015"), ("GA", "")], "a string, b string").select(T.admin2_code(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in d] == ["US.GA.005", "US.GA.015", "US.GA."]
    assert [one(spark, g, T.grade_gain) for g in ("Perfect", "EXCELLENT", "good", "Fair", "x")] == [10, 7, 5, 1, 0]


def test_tokenizer():
    assert U.tokenize('where is the "Statue of Liberty" in New-York?') == ["statue liberty", "new", "york"]
    assert U.tokenize('"of the"') == []
    assert U.tokenize("") == []


def test_segmentation_keeps_frequent_phrases():
    counts = {"new": 100, "york": 90, "new york": 85, "zoo": 40}
    assert U.best_segmentation(["new", "york", "zoo"], counts, 1000) == ["new york", "zoo"]
    assert U.best_segmentation(["a", "b"], {}, 1000) == ["a", "b"]


def test_options_and_requests():
    lines = ["# comment", *[f"{k}: v:{i}" for i, k in enumerate(readers.OPTION_KEYS)]]
    assert readers.parse_options(lines)["corpus_prefix"] == "v:0"
    with pytest.raises(ValueError):
        readers.parse_options(lines[:-1])
    r = readers.parse_request("query=new+york&NUMDOCS=x&numterms=3&best=TRUE&place=1,2&uname=ohio")
    assert (r["query"], r["numdocs"], r["numterms"], r["best"], r["place"], r["uname"]) == ("new york", 10, 3, True, [1, 2], ["ohio"])


def test_cleaning_takes_the_stated_characters(spark):
    import re
    every = "".join(chr(c) for c in range(1, 0x2200)) + "\U0001f600"
    df = spark.createDataFrame([(every,)], "text string")
    ascii_space = r"\t\n\x0b\f\r "
    for made, pattern, put in ((T.index_clean, rf"[^A-Za-z0-9{ascii_space}]", " "), (T.mining_clean, rf"[^A-Za-z0-9{ascii_space}]", ""), (T.display_clean, r"[^A-Za-z0-9 ]", "")):
        expected = re.sub(pattern, put, every)
        assert df.select(made(F.col("text"))).first()[0] == (expected if made is T.display_clean else expected.lower())


def test_pages_with_attributes_several_infoboxes_and_references(spark):
    from terrasift.functions import text as T
    html = ('<title>T &amp;lt;</title><table class="infobox vcard"><tr><td>one</td></tr></table><p class="a">&#233;t&#xE9; &copy; &nosuch; &#1114112; A&B; &</p>'
            "<table class='infobox'>two</table><pre>no</pre><p>three</p><p\nid=x>four")
    df = spark.createDataFrame([(html,), ("no references",), (None,)], "html string")
    got = [r.t for r in df.select(T.html_fields(F.col("html")).alias("t")).collect()]
    assert got[0] == "T &lt; one two été © &nosuch; &#1114112; A&B; & three four"
    assert [r.t for r in df.select(T.unescape(F.col("html")).alias("t")).collect()][1:] == ["no references", None]


def test_byte_codes_of_hashed_ids_and_of_negatives(spark):
    from terrasift.functions import text as T
    ns = [0, 127, 128, 2**35 - 1, 2**35, 2**36 + 3, 2**62 + 12345, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n long")
    got = df.select("n", T.vbyte_size(F.col("n")).alias("k"), T.vbyte_encode(F.col("n")).alias("c"), F.get(T.vbyte_decode(T.vbyte_encode(F.col("n"))), F.lit(0)).alias("back")).collect()
    for r in got:
        size = max(1, -(-r.n.bit_length() // 7))
        assert r.k == len(r.c) == size and r.back == r.n and [x >= 128 for x in r.c] == [False] * (size - 1) + [True]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(-5,)], "n long").select(T.vbyte_encode(F.col("n"))).collect()


def test_first_of_repeated_ids_and_resolving(spark):
    from terrasift.operators import geo as G
    df = spark.createDataFrame([(i % 50, f"name{i}") for i in range(5000)], "id long, name string").coalesce(1)
    assert {(r.id, r.name) for r in G.first_rows(df, "id").collect()} == {(i, f"name{i}") for i in range(50)}


def test_command_line_evaluates_and_correlates(spark, tmp_path, capsys):
    from terrasift.__main__ import main
    (tmp_path / "o").write_text("".join(f"{k}:x\n" for k in readers.OPTION_KEYS))
    (tmp_path / "r").write_text("q\t1\ta\nq\t2\tb\n")
    (tmp_path / "j").write_text("q\t1\tPerfect\nq\t2\tBad\n")
    (tmp_path / "x").write_text("3\n2\n\n1\n")
    (tmp_path / "y").write_text("30\n20\n10\n")
    main(["--options", str(tmp_path / "o"), "--mode", "evaluate", "--results", str(tmp_path / "r"), "--judgments", str(tmp_path / "j"), "--metric", "6"])
    assert capsys.readouterr().out.split() == ["q", "1.0"]
    main(["--options", str(tmp_path / "o"), "--mode", "spearman", "--x", str(tmp_path / "x"), "--y", str(tmp_path / "y"), "--out", str(tmp_path / "out")])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "out"), sep="\t").collect()] == [("3", "1.0")]
