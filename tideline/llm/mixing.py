"""Mixing sources to target weights by whole-document repetition.

Tokens are aggregated per source, the aggregate gives each source a repetition rate, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, partitions

#: Modulus and number of candidate seeds of the Bernoulli draws; seed k multiplies by MULT[k] and adds ADD[k].
PRIME = 2_147_483_647
SEEDS = 64
MULT = [(48_271 * (k + 1) ** 3 + 16_807) % PRIME for k in range(SEEDS)]
ADD = [(69_621 * (k + 7) ** 5 + 12_345) % PRIME for k in range(SEEDS)]
#: A table of sources is broadcast up to this many rows (about 100 bytes each); beyond, the join is left to Spark.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with ix: its place by code point of source, null last, from 0. Sources are dealt by range, numbered within
    their range, and moved on by what the ranges before hold, so no task sees all of them."""
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    x = durable(sizes.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()))
    counts = sorted((r["part"], r["n"]) for r in x.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, n = [], 0
    for part, k in counts:
        starts.append((part, n))
        n += k
    offset = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    inner = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return x.withColumn("inner", inner).join(offset, "part").withColumn("ix", F.col("start") + F.col("inner")).drop("part", "start", "inner")


def source_targets(sizes: DataFrame, weights: list[int], cap: float) -> DataFrame:
    """(source, source_size, target, ix) by water filling. sizes: (source, source_size), a row per source.

    Sources by code point, null last, take `weights` in turn. A target stops at cap times the source's size; what is
    over goes to the others by weight. The level, the target of a weight of 1, is that of the sources that are not capped;
    raising it caps further sources, so it is worked out anew until none is added: a sum over sources each time.
    """
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("ix") % len(weights) + 1).cast("int"))
    x = _numbered(sizes).withColumn("w", weight)
    x = durable(x.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("w")))
    level, capped = 0.0, -1.0
    while True:
        over = F.col("ratio") < F.lit(level)
        r = x.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, F.col("cap")).otherwise(0.0)).alias("capped"), F.sum(F.when(over, 0).otherwise(F.col("w"))).alias("w")).first()
        if not r["w"] or r["capped"] == capped:  # no source or every source is capped; or nothing new is
            break
        capped = r["capped"]
        level = (r["all"] - capped) / r["w"]
    target = F.least(F.col("cap"), F.lit(float(level)) * F.col("w")) if r["w"] else F.col("cap")
    return x.select("source", "source_size", target.alias("target"), "ix")


def _draw(h: Column, k: int | Column) -> Column:
    """A hash below 2**28 to a number below PRIME, by seed k."""
    mult = F.lit(MULT[k]) if isinstance(k, int) else F.element_at(F.array(*map(F.lit, MULT)), k + 1)
    add = F.lit(ADD[k]) if isinstance(k, int) else F.element_at(F.array(*map(F.lit, ADD)), k + 1)
    return (h * mult.cast("long") + add.cast("long")) % F.lit(PRIME).cast("long")


def _hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 7), 16, 10).cast("long")


def mix_rates(sizes: DataFrame, weights: list[int], cap: float) -> tuple[DataFrame, bool]:
    """One row per source: (t_source, source_size, target, whole, frac, seed), and whether it may be broadcast.

    rate = target / source_size; whole is its floor and frac its fraction in units of 1 / PRIME. sizes has a row
    (id, source, size) per document. Of SEEDS fixed seeds a source takes the one whose copies come nearest to its target
    (ties: the first), so a few very long documents cannot carry it far off, and reruns agree. Under one seed a document's
    chance of the extra copy is the fraction; a seed that is chosen by what it gives makes draws within a source depend on
    each other a little, and the share of documents drawn stays near the fraction.
    """
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(rate)).withColumn("frac", (rate - F.floor(rate)) * F.lit(float(PRIME)))
    targets = durable(targets.withColumnRenamed("source", "t_source"))
    small = targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast(targets) if small else targets
    j = sizes.withColumn("h", _hash(F.col("id"))).join(side, F.col("source").eqNullSafe(F.col("t_source")))
    sums = j.groupBy("t_source", "source_size", "target", "whole", "frac").agg(
        *[F.sum(F.when(_draw(F.col("h"), k) < F.col("frac"), F.col("size")).otherwise(F.lit(0))).alias(f"s{k}") for k in range(SEEDS)]
    )
    need = F.col("target") - F.col("whole") * F.col("source_size")
    off = F.array(*[F.struct(F.abs(F.col(f"s{k}") - need).alias("off"), F.lit(k).alias("seed")) for k in range(SEEDS)])
    return durable(sums.select("t_source", "source_size", "target", "whole", "frac", F.array_min(off)["seed"].alias("seed"))), small


def copies(doc_id: Column) -> Column:
    """Of a row joined with its source's rates: floor(rate) plus the seeded draw. Rows of one id draw alike."""
    return (F.col("whole") + (_draw(_hash(doc_id), F.col("seed")) < F.col("frac")).cast("long")).cast("long")


def plan_mix(docs: DataFrame, weights: list[int] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies), one row per row of docs. Null texts count no words, null sources are
    one source, null ids draw alike, repeated rows are documents each; sources of equal names cannot be, so there are no
    ties; an empty table gives an empty one; texts of any length are counted whole; other columns take no part."""
    sizes = durable(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size")))
    rates, small = mix_rates(sizes, list(weights), cap)
    out = sizes.join(F.broadcast(rates) if small else rates, F.col("source").eqNullSafe(F.col("t_source")))
    return out.select("id", "source", "size", "source_size", "target", copies(F.col("id")).alias("copies"))


def mix(docs: DataFrame, weights: list[int] = (5, 2, 1), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents themselves: each row of docs as often as its copies say, with docs's columns.

    Null texts count no words, a null source is a source of its own, repeated rows are documents each (those of one id
    are drawn alike), and documents without words are emitted at their source's rate like any other. No document is
    copied more than ceil(cap) times, as no rate is above cap. An empty table gives an empty one. Other columns are
    carried as they are, whatever their names.
    """
    sizes = durable(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size")))
    rates, small = mix_rates(sizes, list(weights), cap)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    j = packed.join(F.broadcast(rates) if small else rates, F.col(f"d.`{source_col}`").eqNullSafe(F.col("t_source")))
    j = j.select("d", copies(F.col(f"d.`{id_col}`")).alias("n")).where("n > 0").select("d", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return j.select(*[F.col(f"d.`{c}`") for c in docs.columns])


def mixing_report(docs: DataFrame, weights: list[int] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The digest columns of the contract: doc_id, size, source_size, target, taken. Odd rows and tables are as in plan_mix."""
    p = plan_mix(docs, weights, cap)
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle(weights: list[int] = (5, 2, 1), cap: float = 3.0) -> str:
    """DuckDB SQL for mixing_report over documents: the water level by trying every source as the first uncapped one."""
    w = ", ".join(map(str, weights))
    seeds = ", ".join(f"({k}, {MULT[k]}, {ADD[k]})" for k in range(SEEDS))
    return f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
  ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 7))::bigint as h from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as ix from d group by source),
c as (select *, {float(cap)!r} * source_size as cap, ([{w}])[1 + ix % {len(weights)}] as w from s),
r as (select *, cap / w as ratio from c),
l as (select a.ratio, a.ix, ((select sum(source_size) from r) - coalesce((select sum(b.cap) from r b where (b.ratio, b.ix) < (a.ratio, a.ix)), 0.0))
  / (select sum(b.w) from r b where (b.ratio, b.ix) >= (a.ratio, a.ix)) as level from r a),
v as (select arg_min(level, ratio) as level from l where ratio >= level),
t as (select r.source, r.source_size, case when v.level is null then r.cap else least(r.cap, v.level * r.w) end as target from r, v),
u as (select *, case when source_size > 0 then target / source_size else 0.0 end as rate from t),
f as (select *, floor(rate)::bigint as whole, (rate - floor(rate)) * {float(PRIME)!r} as frac from u),
k(seed, m, a) as (values {seeds}),
q as (select f.source, k.seed, sum(case when (d.h * k.m + k.a) % {PRIME} < f.frac then d.size else 0 end) as got
  from d join f on d.source is not distinct from f.source, k group by 1, 2),
b as (select q.source, arg_min(seed, abs(got - (f.target - f.whole * f.source_size)) * 1000.0 + seed * 1e-9) as seed from q join f on q.source is not distinct from f.source group by 1)
select d.doc_id, d.size::bigint as size, f.source_size, f.target,
  (d.size * (f.whole + ((d.h * k.m + k.a) % {PRIME} < f.frac)::int))::bigint as taken
from d join f on d.source is not distinct from f.source join b on b.source is not distinct from d.source join k on k.seed = b.seed"""
