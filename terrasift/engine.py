"""Engine: build or load an index and gazetteer, then search, mine and give feedback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import text as T
from .functions.scoring import place_boost
from .operators import feedback, geo as G, graph, rank, render, understand as U
from .operators.index import Index, build_index, document_words
from .operators.match import matches, query_frame

RANKERS = {"geocomprehensive": "bm25", "bm25": "bm25", "tfidf": "tfidf", "cosine": "cosine", "lucene_tfidf": "lucene_tfidf", "pagerank": "pagerank"}
KEEP_AMBIGUOUS, KEEP_EXPANDED, LEAST_EXPANDED, GOOD_ENOUGH = 0.7, 0.75, 0.5, 1.0
MOST_PLACES, SUGGEST_LEAST = 10, 10.0


@dataclass
class Answer:
    query: U.GeoQuery
    results: DataFrame           # rank, doc_id, title, url, score, page_rank, num_views
    decisions: list[tuple]       # (what, strength, kept)
    geojson: str | None = None


class Engine:
    """All modes of the search engine as calls. `geo` and `near` may be None: then no place is known."""

    def __init__(self, spark: SparkSession, index: Index, geo: DataFrame | None = None, near: DataFrame | None = None, tags: DataFrame | None = None):
        self.spark, self.index = spark, index
        self.geo = geo
        self.near = near
        self.names = G.name_keys(geo) if geo is not None else spark.createDataFrame([], "key string, id long")
        self.tags = tags
        if tags is None and geo is not None:
            self.tags = G.place_tags(G.place_counts(G.grams_of_occurrences(index.occurrences), self.names), geo)

    # -- build ------------------------------------------------------------
    @classmethod
    def index(cls, source: DataFrame, geo: DataFrame | None = None, near: DataFrame | None = None, path: str | None = None) -> Engine:
        ix = build_index(source)
        tags = None if geo is None else G.place_tags(G.place_counts(G.grams_of_words(document_words(source)), G.name_keys(geo)), geo)
        e = cls(source.sparkSession, ix, geo, near, tags)
        if path:
            ix.save(path)
            if e.tags is not None:
                e.tags.write.mode("overwrite").parquet(f"{path}/doc_geo")
        return e

    @classmethod
    def load(cls, spark: SparkSession, path: str, geo: DataFrame | None = None, near: DataFrame | None = None) -> Engine:
        tags = spark.read.parquet(f"{path}/doc_geo") if geo is not None else None
        return cls(spark, Index.load(spark, path), geo, near, tags)

    @staticmethod
    def load_places(cities: DataFrame, counties: DataFrame, states: DataFrame) -> DataFrame:
        return G.assemble(cities, counties, states)

    @staticmethod
    def mine(pages: DataFrame, parity: bool = True, pattern: str = T.STRICT_LINK) -> DataFrame:
        """(v, rank) of a corpus (page, html)."""
        edges = graph.fold(graph.page_edges(pages, pattern, pages.select("page")), graph.redirects(pages))
        return graph.pagerank_parity(edges) if parity else graph.pagerank(edges)

    # -- search -----------------------------------------------------------
    def _strengths(self, queries: list[tuple], boosts: DataFrame | None, scorer: str) -> dict:
        """Strength by sub-query, for all of them in one job; 0 where nothing matches."""
        frame = query_frame(self.spark, queries)
        got = {r["sub_id"]: r["strength"] for r in rank.sums(rank.score(self.index, frame, scorer, boosts)).collect()}
        return {s: got.get(s, 0.0) or 0.0 for s, _ in queries}

    def _rows(self, ids: list[int]) -> dict[int, dict]:
        return {r["id"]: r.asDict() for r in self.geo.where(F.col("id").isin(ids)).collect()} if ids and self.geo is not None else {}

    def search(self, query: str, numdocs: int = 10, ranker: str = "geocomprehensive", place: list[int] | None = None, best: bool = False, uname: list[str] | None = None) -> Answer:
        if ranker not in RANKERS:
            raise ValueError(f"unknown ranker {ranker}")
        q = U.understand(self.spark, self.index, self.names, query, place, uname)
        q.best = best
        log: list[tuple] = []
        if not q.tokens:
            return Answer(q, self._present(self.spark.createDataFrame([], "sub_id long, rank int, doc_id long, score double")), log)
        if RANKERS[ranker] == "pagerank":
            return Answer(q, self._present(rank.by_page_rank(self.index, query_frame(self.spark, [(0, q.tokens)]), numdocs)), log)
        scorer = RANKERS[ranker]
        boosts = self._boosts(q.candidates)
        if best:
            rows = self._rows(q.candidates)
            subs = [(i, [*q.supporting, rows[i]["name"].lower().strip()]) for i in q.candidates if i in rows]
            if not subs:
                return Answer(q, self._present(self.spark.createDataFrame([], "sub_id long, rank int, doc_id long, score double")), log)
            ranked = rank.top_k(rank.score(self.index, query_frame(self.spark, subs), scorer, boosts), numdocs)
            merged = rank.merge_best(ranked, numdocs).select(F.lit(0).alias("sub_id"), F.lit(0).alias("rank"), "doc_id", "score")
            return Answer(q, self._present(merged), log)
        frame = query_frame(self.spark, [(0, q.tokens)])
        scored = rank.score(self.index, frame, scorer, boosts)
        results = self._present(rank.top_k(scored, numdocs))
        base = self._strengths([(0, q.tokens)], boosts, scorer)[0]
        log.append((f"query {' | '.join(q.tokens)}", base, True))
        if self.tags is not None and q.supporting:
            sup = query_frame(self.spark, [(0, q.supporting)])
            q.suggestions = [r["geo_id"] for r in G.suggest(matches(self.index, sup), self.tags, SUGGEST_LEAST).orderBy("rank").collect()]
        if q.candidates and self.geo is not None:
            self._resolve(q)
            if len(q.candidates) > 1:
                self._disambiguate(q, base, boosts, scorer, log)
            if len(q.candidates) == 1 and q.supporting:
                self._expand(q, base, boosts, scorer, log)
        return Answer(q, results, log, self._geojson(q))

    def _boosts(self, ids: list[int]) -> DataFrame | None:
        if not ids or self.geo is None:
            return None
        return F.broadcast(self.geo.where(F.col("id").isin(ids)).select(F.lower(F.trim("name")).alias("token"), place_boost(F.col("type")).alias("boost")).groupBy("token").agg(F.max("boost").alias("boost")))

    def _resolve(self, q: U.GeoQuery) -> None:
        frame = self.spark.createDataFrame([(0, i, c) for i, c in enumerate(q.candidates)], "query long, ord int, id long")
        q.candidates = [r["id"] for r in G.resolve(frame, self.geo).orderBy("ord").collect()]

    def _disambiguate(self, q, base, boosts, scorer, log) -> None:
        frame = self.spark.createDataFrame([(0, i, c) for i, c in enumerate(q.candidates)], "query long, ord int, id long")
        named = G.uniqify(frame.join(self.geo.select("id", "name", "type", "state_name", "county_name"), "id")).collect()
        q.unique_names = {r["id"]: r["unique_name"] for r in named}
        subs = [(c, [*q.tokens, *[w.strip().lower() for w in q.unique_names[c].split("#")[0].split(",")[1:]]]) for c in q.candidates]
        got = self._strengths(subs, boosts, scorer)
        log += [(f"candidate {q.unique_names[c]}", got[c], got[c] > KEEP_AMBIGUOUS * base) for c in q.candidates]
        q.candidates = sorted((c for c in q.candidates if got[c] > KEEP_AMBIGUOUS * base), key=lambda c: (-round(got[c], 6), c))
        if len(q.candidates) > 1:
            q.mode = "AMBIGUOUS"

    def _expand(self, q, base, boosts, scorer, log) -> None:
        near = self.near if self.near is not None else self.spark.createDataFrame([], "id long, near_id long, rank int")
        frame = self.spark.createDataFrame([(0, q.candidates[0])], "query long, id long")
        ids = list(dict.fromkeys(r["id"] for r in G.expand(frame, self.geo, near, MOST_PLACES).orderBy("kind", "rank").collect()))
        rows = self._rows(ids)
        subs = []
        for i in ids:
            r = rows[i]
            small = r["type"] == "CITY" and (r["population"] or 0) <= G.BIG_CITY
            subs.append((i, [*q.supporting, r["name"].lower().strip(), *([r["state_name"].lower().strip()] if small and r["state_name"] else [])]))
        got = self._strengths(subs, boosts, scorer) if subs else {}
        keep = {i: got[i] > LEAST_EXPANDED and got[i] > KEEP_EXPANDED * base for i in ids}
        log += [(f"expansion {rows[i]['name']}", got[i], keep[i]) for i in ids]
        q.expanded = sorted((i for i in ids if keep[i]), key=lambda i: (-round(got[i], 6), i))
        if q.expanded:
            q.mode = "EXPANSION"

    def _geojson(self, q: U.GeoQuery) -> str | None:
        ids = q.candidates + q.expanded
        if not ids or q.mode == "NONE" or self.geo is None:
            return None
        names = [(0, i, c, q.unique_names.get(c)) for i, c in enumerate(ids)]
        rows = self.spark.createDataFrame(names, "query long, ord int, id long, unique_name string").join(self.geo, "id")
        out = render.candidates(rows.withColumn("unique_name", F.coalesce("unique_name", "name"))) if q.mode == "AMBIGUOUS" else render.primary_and_expanded(rows)
        return out.first()["geojson"]

    def _present(self, ranked: DataFrame) -> DataFrame:
        docs = self.index.docs.select("doc_id", "title", "url", "page_rank", "num_views")
        return ranked.join(docs, "doc_id").select("rank", "doc_id", "title", "url", "score", "page_rank", "num_views").orderBy(F.desc("score"), "doc_id")

    def html(self, answer: Answer) -> str:
        q = answer.query
        names = {i: r["name"] for i, r in self._rows(q.suggestions).items()}
        return render.page(q.text, q.mode, [r.asDict() for r in answer.results.collect()], answer.geojson, [names[i] for i in q.suggestions if i in names], q.candidates + q.expanded)

    def prf(self, query: str, numdocs: int = 10, numterms: int = 10, over_documents: bool = False) -> DataFrame:
        """Term probabilities in the query's results: of its own tokens, or of all their terms."""
        q = U.understand(self.spark, self.index, self.names, query)
        frame = query_frame(self.spark, [(0, q.tokens)])
        top = rank.top_k(rank.score(self.index, frame), numdocs)
        out = feedback.document_term_probabilities(self.index, top, numterms) if over_documents else feedback.query_term_probabilities(self.index, top, frame, numterms)
        return out.select("token", "prob")
