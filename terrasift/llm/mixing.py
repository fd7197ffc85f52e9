"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

Each document gets a uniform number from its seeded hash and a count from the inverse of the
Poisson distribution at its source's rate, is exploded by that count, and all copies are put
in one global random order by range-partitioning and sorting on a second hash. A rate above
MAX_DRAWN_RATE is drawn as the sum of equal independent parts, each from a uniform number of its
own, which is Poisson of that rate again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

#: Rates above this are drawn in parts that add up: below exp(-20) the uniform number's digits would not do.
MAX_DRAWN_RATE = 20.0
#: Copies of one document that one task makes where some source's rate is above this; more go to other tasks.
COPIES_A_TASK = 2048
_TERMS = 80
#: Counted before the join; beyond it the join shuffles, and AQE splits its hot sources.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 48 bits of an MD5 of the parts, alike in any engine."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 48))


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) >= u, X ~ Poisson(rate), rate <= MAX_DRAWN_RATE."""
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc, i):
        p = acc["p"] * rate / i
        more = acc["cdf"] < u
        return F.struct(
            F.when(more, p).otherwise(acc["p"]).alias("p"),
            F.when(more, acc["cdf"] + p).otherwise(acc["cdf"]).alias("cdf"),
            F.when(more, i).otherwise(acc["k"]).alias("k"),
        )

    found = F.aggregate(F.sequence(F.lit(1), F.lit(_TERMS)), zero, step, lambda acc: acc["k"])
    return F.when(u <= F.exp(-rate), F.lit(0)).otherwise(found)


def poisson_count(first: Column, seed: str, ident: Column, rate: Column) -> Column:
    """A Poisson draw at any rate; `first` is the uniform number of seed and ident, a column of its own so that it is made once."""
    parts = F.greatest(F.ceil(rate / MAX_DRAWN_RATE), F.lit(1)).cast("int")
    later = lambda j: poisson_inverse(uniform(F.lit(seed), ident, j.cast("string")), rate / parts)
    rest = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, j: n + later(j))
    return F.when(rate > MAX_DRAWN_RATE, poisson_inverse(first, rate / parts) + rest).otherwise(poisson_inverse(first, rate))


def source_rates(df: DataFrame, weights: dict[str, float] | None, source_col: str, budget: float, other: float = 0.0) -> tuple[DataFrame, int, float]:
    """(source, n_docs, rate), how many sources there are, and the greatest rate: rate = budget * N * weight share / n_docs, so a source's expected
    rows hold its share of budget * N. weights=None: every source alike; a source that is not in
    `weights` gets weight `other`. A null source is a source of its own, named ''."""
    counts = df.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        weighted = counts.withColumn("w", F.lit(1.0))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        weighted = counts.withColumn("w", F.coalesce(F.element_at(F.create_map(*pairs), F.col("src")), F.lit(float(other))))
    sums = weighted.agg(F.coalesce(F.sum("w"), F.lit(0.0)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.col("w") / F.col("n_docs")), F.lit(0.0))).first()
    rate = F.lit(float(budget) * sums[1] / sums[0]) * F.col("w") / F.col("n_docs") if sums[0] > 0 else F.lit(0.0)
    return weighted.select("src", "n_docs", rate.alias("rate")), sums[2], float(budget) * sums[1] / sums[0] * sums[3] if sums[0] > 0 else 0.0


def mix_sources(df: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, seed: str = "mix",
                id_col: str = "doc_id", source_col: str = "source", keep_columns: list[str] | None = None, other: float = 0.0) -> DataFrame:
    """Rows of df repeated by their Poisson counts, in random global order; adds copy (from 1),
    rate and shuffle_key (under free names if df has such columns; see `mixed_columns`).

    Rows that repeat an id repeat its draw. Null ids draw as 'null'. Texts are not looked at.
    Counts are Poisson at every rate. An empty table gives an empty result.
    """
    names = mixed_columns(df)
    cols = keep_columns or df.columns
    src, rate, ident, u, n, copy, key = (free_name(df, f"__{x}") for x in ("src", "rate", "id", "u", "n", "copy", "key"))
    rates, n_sources, top = source_rates(df, weights, source_col, budget, other)
    rates = rates.select(F.col("src").alias(src), F.col("rate").alias(rate))
    body = df.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias(src),
                     F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias(ident))
    rated = body.join(F.broadcast(rates) if n_sources <= BROADCAST_SOURCES else rates, src)
    drawn = rated.withColumn(u, uniform(F.lit(seed), F.col(ident))).withColumn(n, poisson_count(F.col(u), seed, F.col(ident), F.col(rate))).where(F.col(n) > 0)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    upto = F.col(n)
    if top > COPIES_A_TASK:
        drawn = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n), F.lit(COPIES_A_TASK)))).repartition(parts, ident, copy)
        upto = F.least(F.col(copy) + (COPIES_A_TASK - 1), upto)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.col(copy) if top > COPIES_A_TASK else F.lit(1), upto)))
    keyed = copies.withColumn(key, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(ident), F.col(copy))))
    out = keyed.repartitionByRange(parts, key).sortWithinPartitions(key, ident, copy)
    return out.select(*[F.col(f"`{c}`") for c in cols], F.col(copy).alias(names["copy"]), F.col(rate).alias(names["rate"]), F.col(key).alias(names["shuffle_key"]))


def mixed_columns(df: DataFrame) -> dict[str, str]:
    return {c: free_name(df, c) for c in ("copy", "rate", "shuffle_key")}


#: What the registered query aims at.
QUERY_WEIGHTS = {f"src{i}": w for i, w in enumerate([4.0, 3.0, 2.0, 2.0] + [1.0] * 16)}
#: Of a source that is not listed, and of documents without one.
OTHER_WEIGHT = 1.0

ORACLE = """
with recursive w as (select 'src' || i as src, case i when 0 then 4.0 when 1 then 3.0 when 2 then 2.0 when 3 then 2.0 else 1.0 end::double as w from range(20) t(i)),
c as (select coalesce(source, '') as src, count(*) as n from documents group by 1),
cw as (select c.src, n, coalesce(w.w, 1) as w from c left join w on w.src = c.src),
r as (select src, 1.0::double * (select sum(n) from cw)::double * w / (select sum(w) from cw) / n as rate from cw),
m as (select src, rate, greatest(ceil(rate / 20), 1)::int as parts, rate / greatest(ceil(rate / 20), 1) as each from r),
p as (select src, each, 0 as k, exp(-each) as p, exp(-each) as cdf from m
      union all select src, each, k + 1, p * each / (k + 1), cdf + p * each / (k + 1) from p where k < 80),
d as (select doc_id, text, lang, source, n_chars, rate, src, unnest(range(1, parts + 1)) as part from documents join m on src = coalesce(source, '')),
u as (select *, (('0x' || substr(md5('mix|' || doc_id || case part when 1 then '' else '|' || part end), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u from d),
n as (select u.doc_id, u.text, u.lang, u.source, u.n_chars, u.rate, count(p.k) as n from u join p on p.src = u.src and p.cdf < u.u group by all)
select doc_id, text, lang, source, n_chars, copy::int as copy, round(rate, 9) as rate, md5('mix|order|' || doc_id || '|' || copy) as shuffle_key
from (select *, unnest(range(1, n + 1)) as copy from n)
"""
