"""Gazetteer operators: hierarchy, names, expansion, qualification, place tags and suggestions.

A gazetteer is one table: id, name, type (CITY, COUNTY, STATE, NATION), population (null for
other than cities), lat, lon, x, y, county_id, state_id, nation_id, state_name, county_name.
Ancestors are columns, so tests on the tree are comparisons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from terrasift.functions import text as T

BIG_CITY = 200_000
MIN_COUNT = 3
SUGGEST_BASE, SUGGEST_LEAST, SUGGEST_TOP = 0.05, 10.0, 10
NEAR_DISTANCE, NEAR_TOP = 50_000, 20
NATION_ID = 6252001
#: Up to this many distinct names are broadcast (they are counted first).
BROADCAST_NAMES = 200_000


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """Of rows that repeat a key the first, in the order in which the table is read."""
    cols = [c for c in df.columns if c != key]
    first = df.withColumn("__at", F.monotonically_increasing_id()).groupBy(key).agg(F.min_by(F.struct(*cols), "__at").alias("__row"))
    return first.select(*[F.col(key) if c == key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def assemble(cities: DataFrame, counties: DataFrame, states: DataFrame, nation_name: str = "United States of America") -> DataFrame:
    """One table from the three files' rows. Of repeated ids the first counts. A city takes its
    county by code, else its state (as New York City does); the District of Columbia hangs on the nation."""
    spark = cities.sparkSession
    st = first_rows(states, "id").select(
        F.col("id").cast("long").alias("id"), "name", "code", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    co = first_rows(counties, "id").select(
        F.col("id").cast("long").alias("id"), "name", "code", T.state_code(F.col("code")).alias("state_code"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    s = st.select(F.col("code").alias("state_code"), F.col("id").alias("state_id"), F.col("name").alias("state_name")).groupBy("state_code").agg(F.min("state_id").alias("state_id"), F.min_by("state_name", "state_id").alias("state_name"))
    c = co.select(F.col("code").alias("county_code"), F.col("id").alias("county_id"), F.col("name").alias("county_name")).groupBy("county_code").agg(F.min("county_id").alias("county_id"), F.min_by("county_name", "county_id").alias("county_name"))
    ci = first_rows(cities, "id").withColumn("county_code", T.admin2_code(F.col("admin1"), F.coalesce("admin2", F.lit("")))).withColumn(
        "state_code", F.concat(F.lit("US."), F.col("admin1"))).join(c, "county_code", "left").join(s, "state_code", "left")
    none = F.lit(None)
    cols = lambda kind, **k: [F.col("id").cast("long").alias("id"), "name", F.lit(kind).alias("type"), k.get("population", none).cast("int").alias("population"),
                              F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), k.get("x", none).cast("double").alias("x"), k.get("y", none).cast("double").alias("y"),
                              k.get("county_id", none).cast("long").alias("county_id"), k.get("state_id", none).cast("long").alias("state_id"), F.lit(NATION_ID).cast("long").alias("nation_id"),
                              F.coalesce(k.get("state_name", none.cast("string")), F.lit("")).alias("state_name"), F.coalesce(k.get("county_name", none.cast("string")), F.lit("")).alias("county_name")]
    nation = spark.createDataFrame([(NATION_ID, nation_name, 0.0, 0.0)], "id long, name string, lat double, lon double").select(*cols("NATION"))
    return (
        nation.unionByName(st.select(*cols("STATE", state_id=F.col("id"), state_name=F.col("name"))))
        .unionByName(co.join(s, "state_code", "left").select(*cols("COUNTY", county_id=F.col("id"), county_name=F.col("name"), state_id=F.col("state_id"), state_name=F.col("state_name"))))
        .unionByName(ci.select(*cols("CITY", population=F.col("population"), x=F.col("x"), y=F.col("y"), county_id=F.col("county_id"), county_name=F.col("county_name"), state_id=F.col("state_id"), state_name=F.col("state_name"))))
    )


def parents(geo: DataFrame) -> DataFrame:
    """(id, parent_id)."""
    return geo.where("type <> 'NATION'").select("id", F.when(F.col("type") == "CITY", F.coalesce("county_id", "state_id", "nation_id")).when(
        F.col("type") == "COUNTY", F.coalesce("state_id", "nation_id")).otherwise(F.col("nation_id")).alias("parent_id"))


def name_keys(geo: DataFrame) -> DataFrame:
    """(key, id): lower-case name, with the state's for small cities."""
    low = F.trim(F.regexp_replace(T.index_clean(F.col("name")), r"\s+", " "))
    state = F.trim(F.regexp_replace(T.index_clean(F.col("state_name")), r"\s+", " "))
    return geo.select(F.when(F.col("population").isNull() | (F.col("population") >= BIG_CITY), low).otherwise(F.concat_ws(" ", low, state)).alias("key"), "id")


def resolve(candidates: DataFrame, geo: DataFrame) -> DataFrame:
    """candidates (query, ord, id): of a query whose candidates hold one another, only the first
    that lies in another stays; other queries keep all. Each candidate looks its own ancestors up
    among its query's candidates: a few rows each, not all pairs of the query."""
    above = F.array_distinct(F.filter(F.array("county_id", "state_id", "nation_id"), lambda x: x.isNotNull() & (x != F.col("id"))))
    up = candidates.join(geo, "id").select("query", "ord", F.explode(above).alias("up"))
    inside = up.join(candidates.select("query", F.col("id").alias("up")).distinct(), ["query", "up"]).groupBy("query").agg(F.min("ord").alias("first"))
    return candidates.join(inside, "query", "left").where(F.col("first").isNull() | (F.col("ord") == F.col("first"))).select("query", "ord", "id")


def uniqify(rows: DataFrame) -> DataFrame:
    """rows (query, ord, id, name, type, state_name, county_name) with unique_name: the name, then
    name,state, then name,county,state while names collide; what still collides gets its id."""
    n = F.count(F.lit(1))
    out = rows.withColumn("u", F.col("name"))
    out = out.withColumn("k", n.over(Window.partitionBy("query", "u"))).withColumn(
        "u", F.when((F.col("k") > 1) & (F.col("type") != "STATE") & (F.col("state_name") != ""), F.concat_ws(",", "name", "state_name")).otherwise(F.col("u")))
    out = out.withColumn("k", n.over(Window.partitionBy("query", "u"))).withColumn(
        "u", F.when((F.col("k") > 1) & (F.col("type") != "STATE") & (F.col("county_name") != ""), F.concat_ws(",", "name", "county_name", "state_name")).otherwise(F.col("u")))
    out = out.withColumn("k", F.row_number().over(Window.partitionBy("query", "u").orderBy("ord", "id")))
    return out.withColumn("unique_name", F.when(F.col("k") == 1, F.col("u")).otherwise(F.concat_ws("#", "u", F.col("id").cast("string")))).drop("u", "k")


def county_population(geo: DataFrame) -> DataFrame:
    return geo.where("type = 'CITY' and county_id is not null").groupBy("county_id").agg(F.sum("population").alias("population"))


def expand(candidates: DataFrame, geo: DataFrame, near: DataFrame | None, most: int = 10) -> DataFrame:
    """candidates (query, id) to (query, kind, rank, id): for a city its county and nearest `most`
    neighbours; for a county its largest cities; for a state its most populous counties and cities."""
    c = candidates.join(geo, "id").select("query", F.col("id").alias("cid"), "type", F.col("county_id").alias("c_county"))
    cities = geo.where("type = 'CITY'")
    by_pop = lambda *k: Window.partitionBy(*k).orderBy(F.desc("population"), "id")
    if near is None:
        near = geo.sparkSession.createDataFrame([], "id long, near_id long, rank int")
    nearby = c.where("type = 'CITY'").join(near, c["cid"] == near["id"]).where(F.col("rank") <= most).select("query", F.lit("near").alias("kind"), F.col("rank").cast("int"), F.col("near_id").alias("id"))
    county = c.where("type = 'CITY' and c_county is not null").select("query", F.lit("county").alias("kind"), F.lit(1).alias("rank"), F.col("c_county").alias("id"))
    pops = geo.where("type = 'COUNTY'").join(county_population(geo).withColumnRenamed("population", "pop"), "county_id", "left").select("id", "state_id", F.coalesce("pop", F.lit(0)).alias("population"))
    counties = c.where("type = 'STATE'").join(pops, c["cid"] == pops["state_id"]).withColumn("rank", F.row_number().over(by_pop("query", "cid"))).where(F.col("rank") <= most).select("query", F.lit("counties").alias("kind"), "rank", "id")
    in_state = c.where("type = 'STATE'").join(cities, c["cid"] == cities["state_id"]).withColumn("rank", F.row_number().over(by_pop("query", "cid"))).where(F.col("rank") <= most).select("query", F.lit("cities").alias("kind"), "rank", "id")
    in_county = c.where("type = 'COUNTY'").join(cities, c["cid"] == cities["county_id"]).withColumn("rank", F.row_number().over(by_pop("query", "cid"))).where(F.col("rank") <= most).select("query", F.lit("cities").alias("kind"), "rank", "id")
    out = nearby
    for more in (county, counties, in_state, in_county):
        out = out.unionByName(more)
    return out


def neighbours(cities: DataFrame, distance: float = NEAR_DISTANCE, top: int = NEAR_TOP) -> DataFrame:
    """(id, near_id, rank): other cities within `distance` in x and y's units, the most populous first; id is a key.
    Each city goes to the nine grid cells around its own. A cell's cities walk down its candidates by population,
    some at a time, until they have `top`: no pair is made that is not compared then, and only results are rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    limit = float(distance) ** 2
    at = lambda c: F.floor(F.col(c) / F.lit(float(distance)))
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    dealt = cities.where("x is not null and y is not null").select("id", "x", "y", "population", at("x").alias("gx"), at("y").alias("gy"), F.explode(steps).alias("s")).select(
        "id", "x", "y", "population", (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), ((F.col("s.dx") == 0) & (F.col("s.dy") == 0)).alias("own"))
    names = ["id", "near_id", "rank"]

    def run(cell: pa.Table) -> pa.Table:
        cell = cell.take(pc.sort_indices(cell, sort_keys=[("population", "descending"), ("id", "ascending")], null_placement="at_end"))
        ids, x, y = (cell[c].to_numpy() for c in ("id", "x", "y"))
        left = np.flatnonzero(cell["own"].to_numpy(zero_copy_only=False))  # cities that have fewer than `top` so far
        have = np.zeros(len(ids), "int64")
        out: list[tuple] = []
        start, size = 0, 64
        while len(left) and start < len(ids):
            to = slice(start, start + size)
            for q in np.array_split(left, -(-len(left) * size // 1_000_000)):
                dx, dy = x[q, None] - x[None, to], y[q, None] - y[None, to]
                hit = (dx * dx + dy * dy <= limit) & (ids[q, None] != ids[None, to])
                n = have[q, None] + np.cumsum(hit, axis=1)
                have[q] = n[:, -1]
                i, j = np.nonzero(hit & (n <= top))
                out.append((ids[q[i]], ids[start + j], n[i, j].astype("int32")))
            left = left[have[left] < top]
            start, size = start + size, min(2 * size, 4096)
        parts = [np.concatenate(c) if out else np.zeros(0, t) for c, t in zip(zip(*out) if out else [()] * 3, ("int64", "int64", "int32"))]
        return pa.table([pa.array(c, t) for c, t in zip(parts, (pa.int64(), pa.int64(), pa.int32()))], names=names)

    return dealt.groupBy("gx", "gy").applyInArrow(run, "id long, near_id long, rank int")


def grams_of_words(words: DataFrame) -> DataFrame:
    """(doc_id, words) to (doc_id, pos, n, t1, t2, t3): each word with the two after it, made inside its row, without a shuffle."""
    size = F.size("words")
    rest = lambda k: F.slice("words", k, F.greatest(size, F.lit(1)))
    zipped = F.arrays_zip(F.col("words").alias("t1"), rest(2).alias("t2"), rest(3).alias("t3"))
    return words.select("doc_id", size.alias("n"), F.posexplode(zipped).alias("pos", "g")).select("doc_id", "pos", "n", "g.t1", "g.t2", "g.t3")


def grams_of_occurrences(occurrences: DataFrame) -> DataFrame:
    """The same from an index that has come without its texts: one shuffle and sort by document."""
    doc = Window.partitionBy("doc_id")
    w = doc.orderBy("pos")
    return occurrences.select("doc_id", "pos", F.count(F.lit(1)).over(doc).alias("n"), F.col("term").alias("t1"), F.lead("term", 1).over(w).alias("t2"), F.lead("term", 2).over(w).alias("t3"))


def _keys(grams: DataFrame, edge_effects: bool) -> DataFrame:
    """(doc_id, key, x) of the one- to three-word strings that start at each word; x is how often one counts."""
    texts = (F.col("t1"), F.when(F.col("t2").isNotNull(), F.concat_ws(" ", "t1", "t2")), F.when(F.col("t3").isNotNull(), F.concat_ws(" ", "t1", "t2", "t3")))
    counts = [T.anchored_weight(F.col("n"), F.col("pos"), k) if edge_effects else F.lit(1) for k in (1, 2, 3)]
    each = F.array(*[F.struct(t.alias("key"), x.cast("int").alias("x")) for t, x in zip(texts, counts)])
    return grams.select("doc_id", F.explode(each).alias("k")).select("doc_id", "k.key", "k.x").where("key is not null and x > 0")


def ngram_counts(grams: DataFrame, edge_effects: bool = False) -> DataFrame:
    """(doc_id, key, cnt) of all one- to three-word strings; with edge_effects, as a three-word
    buffer anchored at its oldest word counts them."""
    return _keys(grams, edge_effects).groupBy("doc_id", "key").agg(F.sum("x").alias("cnt"))


def place_counts(grams: DataFrame, names: DataFrame, edge_effects: bool = False) -> DataFrame:
    """(doc_id, geo_id, cnt) before any threshold. Strings meet the distinct names in one lookup
    each and are counted; only then do the places that share a name take that count each, so a
    threshold on it applies before. A place has one name (of several rows with its id, the least)."""
    known = names.groupBy(F.col("id").alias("geo_id")).agg(F.min("key").alias("key"))
    hit = _keys(grams, edge_effects).join(known.select("key").distinct(), "key").groupBy("doc_id", "key").agg(F.sum("x").alias("cnt"))
    return hit.join(known, "key").select("doc_id", "geo_id", "cnt")


def place_tags(counts: DataFrame, geo: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Counts of at least `least`; cities and counties only where their state is tagged too. A window
    over each document's own few places tells which, so that the counts are made once."""
    many = counts.where(F.col("cnt") >= least).join(geo.select(F.col("id").alias("geo_id"), "type", "state_id"), "geo_id")
    states = F.collect_set(F.when(F.col("type") == "STATE", F.col("geo_id"))).over(Window.partitionBy("doc_id"))
    return many.withColumn("states", states).where("type in ('STATE', 'NATION') or array_contains(states, state_id)").select("doc_id", "geo_id", "cnt")


#: Columns of a class of places: those of one name that are tagged in the same documents, namely under one state, or (free) anywhere.
CLASS = ["key", "free", "state_id"]


def place_classes(names: DataFrame, geo: DataFrame) -> DataFrame:
    """(geo_id, key, free, state_id, type). A place has one name (of several rows with its id, the least); those that no state can vouch for are left out."""
    known = names.groupBy(F.col("id").alias("geo_id")).agg(F.min("key").alias("key"))
    free = F.col("type").isin("STATE", "NATION")
    rows = known.join(geo.select(F.col("id").alias("geo_id"), "type", "state_id"), "geo_id")
    return rows.select("geo_id", "key", free.alias("free"), F.when(free, F.lit(0).cast("long")).otherwise(F.col("state_id")).alias("state_id"), "type").where("state_id is not null")


def key_counts(grams: DataFrame, places: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(doc_id, key, cnt) of the places' names that a document has at least `least` times."""
    keys = places.select("key").distinct()
    small = keys.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    return _keys(grams, False).join(F.broadcast(keys) if small else keys, "key").groupBy("doc_id", "key").agg(F.sum("x").alias("cnt")).where(F.col("cnt") >= least)


def class_tags(counts: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, key, free, state_id, cnt): place_tags() by class, each of which stands for all its places."""
    states = counts.join(places.where("type = 'STATE'").select("key", F.col("geo_id").alias("state_id")), "key").select("doc_id", "state_id").distinct()
    rows = counts.join(places.select(*CLASS).distinct(), "key")
    bound = rows.where("not free").join(states, ["doc_id", "state_id"], "left_semi")
    return rows.where("free").select("doc_id", *CLASS, "cnt").unionByName(bound.select("doc_id", *CLASS, "cnt"))


def tags_of_classes(tags: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, geo_id, cnt): each class's places are one list, and rows fan out last, after all shuffles and sorts."""
    lists = places.groupBy(*CLASS).agg(F.collect_list("geo_id").alias("ids"))
    return tags.join(lists, CLASS).select("doc_id", F.explode("ids").alias("geo_id"), "cnt")


def class_totals(tags: DataFrame) -> DataFrame:
    return tags.groupBy(*CLASS).agg(F.sum("cnt").alias("total"))


def suggest_classes(matches: DataFrame, tags: DataFrame, places: DataFrame, least: float = SUGGEST_LEAST, top: int = SUGGEST_TOP) -> DataFrame:
    """suggest() by class: its places weigh the same, so only the `top` least ids of each can be among the best."""
    found = matches.select("sub_id", "doc_id").distinct().join(tags, "doc_id").groupBy("sub_id", *CLASS).agg(F.sum("cnt").alias("cnt"))
    weighed = found.join(class_totals(tags), CLASS).select("sub_id", *CLASS, F.round(F.col("cnt") * (SUGGEST_BASE + 1.0 / F.col("total")), 6).alias("weight")).where(F.col("weight") > least)
    first = places.withColumn("k", F.row_number().over(Window.partitionBy(*CLASS).orderBy("geo_id"))).where(F.col("k") <= top).select("geo_id", *CLASS)
    w = Window.partitionBy("sub_id").orderBy(F.desc("weight"), "geo_id")
    return weighed.join(first, CLASS).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("sub_id", "rank", "geo_id", "weight")


def place_totals(tags: DataFrame) -> DataFrame:
    return tags.groupBy("geo_id").agg(F.sum("cnt").alias("total"))


def suggest(matches: DataFrame, tags: DataFrame, least: float = SUGGEST_LEAST, top: int = SUGGEST_TOP) -> DataFrame:
    """(sub_id, rank, geo_id, weight): places of the documents (sub_id, doc_id) that match, by count * (0.05 + 1 / total)."""
    found = matches.select("sub_id", "doc_id").distinct().join(tags, "doc_id").groupBy("sub_id", "geo_id").agg(F.sum("cnt").alias("cnt"))
    weighed = found.join(place_totals(tags), "geo_id").select("sub_id", "geo_id", F.round(F.col("cnt") * (SUGGEST_BASE + 1.0 / F.col("total")), 6).alias("weight")).where(F.col("weight") > least)
    w = Window.partitionBy("sub_id").orderBy(F.desc("weight"), "geo_id")
    return weighed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("sub_id", "rank", "geo_id", "weight")
