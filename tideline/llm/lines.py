"""Line dedup across documents.

Lines are hashed, the hashes are range-partitioned with a secondary sort by document and position, first occurrences are
streamed from the sorted runs, and what comes back per document is a bitmap of the lines to drop, never text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, durable, fresh, partitions

#: A key with more than a HOT-th of all lines, and more than LEAST, is settled by its aggregate alone, so at most HOT keys are
#: broadcast; all others go through the sorted stream.
HOT, LEAST = 2_000, 1_000


def line_keys(docs: DataFrame, doc: str, text: str, min_chars: int) -> DataFrame:
    """(h1, h2, doc, body, pos) of each line whose key has at least min_chars code points; 128 bits of hash. body hashes the
    whole text, which tells rows of one id apart."""
    line = F.posexplode(F.split(ascii_lower(F.col(f"`{text}`")), "\n", -1)).alias("pos", "line")
    key = F.btrim(F.col("line"), F.lit(SPACE))
    some = docs.where(F.col(f"`{doc}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    x = some.select(F.col(f"`{doc}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("body"), line).select("doc", "body", "pos", key.alias("key"))
    return x.where(F.char_length("key") >= min_chars).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "body", "pos")


def drop_bitmaps(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """(doc, body, words): for texts that lose lines, an array of (word, bits): bit b of word w marks line 64 w + b.

    Words without a dropped line are left out, which compresses the bitmap. A key stays in the smallest document that
    holds it, there with all its lines.
    """
    spark = docs.sparkSession
    keys = durable(line_keys(docs, doc, text, min_chars))
    limit = max(least, keys.count() // hot)
    few = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where(F.col("n") > limit).select("h1", "h2", "first")
    few = F.broadcast(durable(few))  # at most `hot` rows, as each has more than a hot-th of the lines
    of_hot = keys.join(few, ["h1", "h2"]).select("doc", "body", "pos", "first")
    rest = keys.join(few, ["h1", "h2"], "left_anti")
    n = partitions(spark)
    run = rest.repartitionByRange(n, "h1", "h2").sortWithinPartitions("h1", "h2", "doc", "pos")
    w = Window.partitionBy("h1", "h2").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_rest = run.select("doc", "body", "pos", F.first("doc").over(w).alias("first"))
    dropped = of_rest.unionByName(of_hot).where(F.col("first") < F.col("doc"))
    word = F.expr("pos div 64").cast("int")
    bits = dropped.groupBy("doc", "body", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return bits.groupBy("doc", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def line_dedup(docs: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = 10, counts: bool = False, hot: int = HOT, least: int = LEAST) -> DataFrame:
    """docs with the text that is left; with counts, also n_lines and n_dropped, in place of columns of these names.

    A null or empty text has one empty line and stays as it is. Rows without id take no part and stay unchanged. Rows
    of one id are one document: none loses what only another of them holds, and each loses its own lines that a smaller
    id holds. Lines whose key is shorter than min_chars always stay. A document that loses all lines has an empty text.
    Texts of any length are split whole; an empty table gives an empty one. Other columns are carried, whatever their names.
    """
    doc_, body_, words, lines, kept = fresh(docs, "doc", "body", "words", "lines", "kept")
    marks = drop_bitmaps(docs, doc, text, min_chars, hot, least).select(F.col("doc").alias(doc_), F.col("body").alias(body_), F.col("words").alias(words))
    j = docs.join(marks, (F.col(f"`{doc}`") == F.col(doc_)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(body_)), "left")
    j = j.withColumn(lines, F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1))
    word = lambda i: F.coalesce(F.try_element_at(F.col(words), F.shiftright(i, 6)), F.lit(0).cast("long"))
    stays = lambda x, i: F.getbit(word(i), F.pmod(i, F.lit(64))) == 0
    j = j.withColumn(kept, F.when(F.col(words).isNull(), F.col(lines)).otherwise(F.filter(F.col(lines), stays)))
    left = F.when(F.col(words).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.col(kept), "\n"))
    more = {"n_lines": F.size(lines).cast("long"), "n_dropped": (F.size(lines) - F.size(kept)).cast("long")} if counts else {}
    columns = [left.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in more]
    return j.select(*columns, *(c.alias(name) for name, c in more.items()))


def line_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract: doc_id, n_lines, n_dropped, kept_sha256. Odd rows and tables are as in line_dedup."""
    x = line_dedup(docs.select("doc_id", "text"), counts=True)
    return x.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from d),
k as (select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
f as (select key, min(doc_id) as first, count(distinct doc_id) as n from k where length(key) >= 10 group by key),
m as (select k.*, coalesce(f.n > 1 and f.first < k.doc_id, false) as dropped from k left join f on k.key = f.key)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where dropped))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from m group by doc_id"""
