"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Shingle hashes are binned once by their high bits and each bin keeps its least hash; an empty bin borrows from the first
full bin on a probing sequence of its own (optimal densification); the lowest bits of each bin are packed, and the likeness
of two fingerprints is the share of equal bins, corrected for bins that are equal by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh, partitions

#: BINS bins (a power of two) of BITS low bits each (a divisor of 64); SHINGLE words to a shingle.
BINS, BITS, SHINGLE = 128, 4, 5
PER_LONG = 64 // BITS
_LOW = sum(1 << (BITS * i) for i in range(PER_LONG))
#: Probes that are tried one by one before all are looked at.
PROBES = 6


def _probe(i: Column, a: Column) -> Column:
    """The a-th bin that an empty bin i looks at: a random start and an odd random stride, so all bins come in turn."""
    h = F.xxhash64(i)
    start, stride = h.bitwiseAND(F.lit(BINS - 1)), F.shiftright(h, 32).bitwiseAND(F.lit(BINS // 2 - 1)) * 2 + 1
    return (start + a * stride).bitwiseAND(F.lit(BINS - 1)).cast("int")


def fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with array<bigint> `out`: BINS low-bit groups of the column `text`, packed; empty for a text without words.

    A text of fewer than SHINGLE words is one shingle; a null is an empty text.
    """
    w, h, m, d, v = fresh(df, "w", "h", "m", "d", "v")
    x = df.withColumn(w, F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", -1), ""), lambda s: F.xxhash64(s)))
    n = F.size(w)
    run = lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(SHINGLE)])
    none = F.array().cast("array<bigint>")
    hashes = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), run)).when(n > 0, F.array(F.xxhash64(F.col(w)))).otherwise(none)
    x = x.withColumn(h, F.sort_array(hashes)).drop(w)
    bin_of = lambda z: (F.shiftright(z, 64 - (BINS.bit_length() - 1)) + F.lit(BINS // 2)).cast("int")  # noqa: E731  bins ascend with the signed hash
    x = x.withColumn(h, F.filter(F.col(h), lambda z, i: (i == 0) | (bin_of(z) != bin_of(F.get(F.col(h), i - 1)))))
    # used again below: an expression that is used once would move into the lambda and be evaluated for each bin
    x = x.withColumn(m, F.map_from_arrays(F.transform(F.col(h), bin_of), F.col(h))).drop(h)
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    x = x.withColumn(d, F.transform(every, lambda i: F.try_element_at(F.col(m), i)))
    at = lambda j: F.get(F.col(d), j)
    rest = lambda i: at(_probe(i, F.get(F.filter(every, lambda a: at(_probe(i, a)).isNotNull()), 0)))
    # hashed with the bin's number: bins that borrow one value would else all agree by one chance of 2**-BITS
    filled = F.transform(F.col(d), lambda z, i: F.xxhash64(F.coalesce(z, *[at(_probe(i, F.lit(a))) for a in range(PROBES)], rest(i)), i).bitwiseAND(F.lit((1 << BITS) - 1)))
    x = x.withColumn(v, F.when(F.size(m) > 0, filled).otherwise(none))
    pack = [F.aggregate(F.slice(F.col(v), g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda acc, z: F.shiftleft(acc, BITS).bitwiseOR(z)) for g in range(BINS // PER_LONG)]
    return x.withColumn(out, F.when(F.size(v) > 0, F.array(*pack)).otherwise(none)).drop(m, d, v)


def as_text(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda z: F.lpad(F.hex(z), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: (equal share - chance) / (1 - chance). Two fingerprints of no words are alike, one is unlike any other."""
    x = [F.get(a, g).bitwiseXOR(F.get(b, g)) for g in range(BINS // PER_LONG)]
    unequal = []
    for z in x:
        y = z
        for s in range(1, BITS):
            y = y.bitwiseOR(F.shiftrightunsigned(z, s))
        unequal.append(F.bit_count(y.bitwiseAND(F.lit(_LOW).cast("long"))))
    share = 1 - sum(unequal[1:], unequal[0]) / F.lit(float(BINS))
    chance = 2.0**-BITS
    score = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(score)


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next, n): the next greater id, after the last the first. ids: (id, n) with distinct ids.

    Ids are dealt by range; within a range the next one is a lead, at its end the next range's first, of which there are
    as many as ranges.
    """
    x = durable(ids.repartitionByRange(partitions(ids.sparkSession), "id").withColumn("part", F.spark_partition_id()))
    heads = x.groupBy("part").agg(F.min("id").alias("head"))
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), F.min("head").over(Window.partitionBy())).alias("after"))
    lead = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return x.withColumn("lead", lead).join(F.broadcast(heads), "part").select("id", F.coalesce("lead", "after").alias("next"), "n")


def fingerprint_report(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest columns of the contract: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    A null text is empty. Rows without id are left out, rows of one id are one document with the least of their texts. Of
    a single document the next is itself. Texts of any length are read whole, an empty table gives an empty one, and other
    columns take no part. Texts cross the network once, by id, and so does the prefix that the document before needs; a
    fingerprint is made once and travels alone.
    """
    slim = docs.where(F.col(f"`{doc}`").isNotNull()).select(F.col(f"`{doc}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    if not slim.groupBy("id").count().where("count > 1").isEmpty():
        slim = slim.groupBy("id").agg(F.min("text").alias("text"))
    order = durable(next_ids(slim.select("id", F.char_length("text").alias("n"))))
    prints = durable(fingerprint(slim, "text", "print").select("id", "print"))  # 64 bytes each
    pair = order.join(prints, "id").join(prints.select(F.col("id").alias("next"), F.col("print").alias("next_print")), "next").select("id", "print", "next_print")
    # by the one who comes next: what its forerunner needs of it
    asked = order.select(F.col("next").alias("id"), F.col("id").alias("fore"), F.floor(F.col("n") / 4).cast("int").alias("k"))
    given = slim.join(asked, "id").select(F.col("fore").alias("id"), F.substring("text", F.lit(1), F.col("k")).alias("head"))
    x = slim.join(given, "id").join(pair, "id").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")), F.col("head"))
    x = x.withColumn("edited", edited).drop("head", "text")
    x = x.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    x = fingerprint(x, "edited", "edited_print").drop("edited")
    return x.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
