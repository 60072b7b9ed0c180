"""Importance resampling towards a target distribution.

Hashed features of the corpus and of the target are counted in buckets; a bucket's gain is the logarithm of what the target
has of it against the corpus. A document's weight reads an array of gains, and weight and seeded noise give an integer
score. The exact histogram of scores, summed from the top, gives each score the rank of its first document and the score
at which the draw ends; within a score that survives, documents are numbered by id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, durable, fresh, partitions, release

#: A word is a run of digits, a to z, and anything beyond ASCII, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Buckets of the feature hash (their counts and gains are small arrays at the driver), words of the longest feature.
BUCKETS, LONGEST = 10_000, 1
#: Words that a document needs to be drawn, and the share that is drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024


def literal_array(values: list[int], kind: str) -> Column:
    """An array column that is one constant of the plan, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def bucketed(text: Column, longest: int, buckets: int) -> tuple[Column, Column]:
    """(words, buckets of all features: runs of 1 to `longest` words joined by a space, each as often as it occurs)."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def runs(k: int) -> Column:
        run = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) >= k, run).otherwise(F.array().cast("array<string>"))

    every = F.concat(words, *map(runs, range(2, longest + 1))) if longest > 1 else words
    return words, F.transform(every, lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int"))


def _counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one row for each bucket reaches the driver."""
    out = np.zeros(buckets, np.int64)
    for b, n in features.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """By bucket, floor(1000 ln) of the smoothed ratio of its share in the target and in the source."""
    n, all_s, all_t = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return [math.floor(1000 * math.log((float(target[b]) + 1) * all_s / ((float(source[b]) + 1) * all_t))) for b in range(n)]


def scored(docs: DataFrame, target: DataFrame, doc: str, text: str, longest: int, buckets: int, seed: int) -> DataFrame:
    """(id, body, n_words, n_features, weight, score), a row for each row of docs. body hashes the text."""
    words, hashed = bucketed(F.col(f"`{text}`"), longest, buckets)
    slim = docs.select(F.col(f"`{doc}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("body"), hashed.alias("buckets"), *([F.size(words).alias("n_words")] if longest > 1 else []))
    features = durable(slim)  # texts are cut into words once
    gain = literal_array(gains(_counts(features, buckets), _counts(target.select(hashed.alias("buckets")), buckets)), "int")
    n = F.size("buckets").cast("long")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + gain[b])
    x = features.select("id", "body", (F.col("n_words") if longest > 1 else F.size("buckets")).alias("n_words"), n.alias("n_features"), total.alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    out = durable(x.select("id", "body", "n_words", "n_features", weight.alias("weight")).withColumn("score", F.col("weight") + noise))
    release(features)
    return out


def ranked(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(id, body, n_features, weight, score, rank), a row for each row of docs; rank is null for what is not drawn.

    Scores are integers, and neither weights (at most 1000 ln 2**126) nor noise grow with the corpus, so their histogram is
    a bounded array at the driver. Survivors are dealt by range of score and id; each score is numbered piece by piece, with
    what pieces before hold added, so a score that very many documents share is no single group. A null text has no features
    and weight 0. Rows without id draw like an empty id and come last among ties; rows of one id draw alike and are ordered by
    a hash of their text; equal rows are rows each. Texts are read whole. An empty target weighs features by the corpus
    alone; an empty docs gives an empty table. Other columns take no part, whatever their names.
    """
    spark = docs.sparkSession
    x = scored(docs, target, doc, text, longest, buckets, seed)
    fits = F.col("n_words") >= least_words
    histogram = sorted(((r["score"], r["n"]) for r in x.where(fits).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    scores, above, n = [], {}, 0
    for score, k in histogram:  # from the top: how many documents have a greater score
        scores.append(score)
        above[score] = n
        n += k
    draw = percent * n // 100
    cutoff = next((s for s in reversed(scores) if above[s] < draw), None)
    columns = ["id", "body", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return x.select(*columns, none)
    order = [F.col("id").asc_nulls_last(), F.col("body")]
    survives = fits & (F.col("score") >= cutoff)
    pieces = durable(x.where(survives).repartitionByRange(partitions(spark), F.col("score").desc(), *order).withColumn("piece", F.spark_partition_id()))
    starts, seen = [], {}
    for piece, score, k in sorted(map(tuple, pieces.groupBy("piece", "score").agg(F.count("*").alias("n")).collect())):  # a row for each score and each border of pieces
        starts.append((piece, score, above[score] + seen.get(score, 0)))
        seen[score] = seen.get(score, 0) + k
    table = pa.table([pa.array(c, t) for c, t in zip(zip(*starts, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["piece", "score", "start"])
    number = F.row_number().over(Window.partitionBy("piece", "score").orderBy(*order)) + F.col("start")
    drawn = pieces.join(F.broadcast(spark.createDataFrame(table)), ["piece", "score"]).withColumn("rank", number.cast("long"))
    drawn = drawn.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    return drawn.unionByName(x.where(~survives).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, doc: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The documents that are drawn, with docs's columns. Odd rows are as in `ranked`; of equal rows as many stay as are drawn."""
    key, body, nth = fresh(docs, "key", "body", "nth")
    drawn = ranked(docs, target, percent, least_words, doc, text, longest, buckets, seed).where(F.col("rank").isNotNull())
    drawn = drawn.groupBy(F.col("id").alias(key), F.col("body").alias(body)).agg(F.count("*").alias(nth))
    same = F.col(f"`{doc}`").eqNullSafe(F.col(key)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(body))
    copy = F.row_number().over(Window.partitionBy(F.col(f"`{doc}`"), F.col(body)).orderBy(F.lit(0)))
    out = docs.join(drawn, same).withColumn(key, copy).where(F.col(key) <= F.col(nth))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def resampling_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The columns of the contract: doc_id, n_features, weight, score, rank. Odd rows and tables are as in `ranked`."""
    x = ranked(docs.select("doc_id", "text"), target.select("text"))
    return x.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


ORACLE = r"""
with lut as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
g as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
f as (select doc_id, unnest(words) as w from d), fb as (select unnest(words) as w from g),
v as (select distinct w from (select w from f union all select w from fb)),
x as (select w, hex(encode(w)) as x from v),
c as (select w, xor(list_reduce(list_concat([4294967295::bigint], list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint)),
  lambda a, b: xor(a // 256, (t[(xor(a, b) % 256 + 1)::int])::bigint)), 4294967295::bigint) % 10000 as b from x, lut),
s as (select b, count(*) as n from f join c using (w) group by b), t as (select b, count(*) as n from fb join c using (w) group by b),
z as (select (select coalesce(sum(n), 0) from s)::double as s, (select coalesce(sum(n), 0) from t)::double as t),
k as (select s.b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (z.s + 10000) / ((s.n + 1)::double * (z.t + 10000))))::bigint as gain from s left join t using (b), z),
m as (select doc_id, sum(gain) as total, count(*) as n from f join c using (w) join k using (b) group by doc_id),
p as (select d.doc_id, len(d.words)::bigint as n_features, case when m.n is null then 0 else (m.total - ((m.total % m.n) + m.n) % m.n) // m.n end::bigint as weight,
  ('0x' || substr(sha256('2024:' || coalesce(cast(d.doc_id as varchar), '')), 1, 8))::bigint as h from d left join m on d.doc_id = m.doc_id),
q as (select *, (weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))))::bigint as score from p),
r as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n from q where n_features >= 20)
select q.doc_id, n_features, weight, score, case when r.place <= 10 * r.n // 100 then r.place::bigint end as rank from q left join r on q.doc_id = r.doc_id"""
