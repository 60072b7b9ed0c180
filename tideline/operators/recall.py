"""Exact recall of ground-truth strings, and sentences that point at something."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words of an item by which texts are looked up, and letters of a short one.
PROBE = 3
#: Items that are sent to the texts, and their characters, for each of which an automaton takes some fifty bytes in a worker.
FEW_ITEMS, FEW_CHARS = 20_000, 2_000_000


def normalize(text: Column) -> Column:
    """Asterisks, pipes, hashes and backticks become spaces, white space one space; trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.translate(text, "*|#`", "    "), r"[ \t\n\r\x0b\x0c]+", " ")))


def found_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) where the normalised text (doc_id, text) holds the normalised item (item_id, text).

    Items are counted first. Up to FEW_ITEMS of them, of FEW_CHARS characters in all, go to where the texts are, as one
    automaton that finds all of them in a text in one pass, so texts are read once and are not sent. More are joined by hash:
    only an item's first and last word may be part of a longer one, so inner words are looked up whole, by the hash of an
    item's second to fourth word among the three-word runs of a text, and what meets is compared. Items of fewer than five
    words have no such run; of these the first three characters are looked for among a text's characters.
    """
    t = texts.select("doc_id", F.coalesce(normalize(F.col("text")), F.lit("")).alias("body"))
    i = items.select("item_id", normalize(F.col("text")).alias("want")).where("want <> ''")
    n, chars = i.agg(F.count("*"), F.coalesce(F.sum(F.char_length("want")), F.lit(0))).first()
    return _by_automaton(t, i) if n <= FEW_ITEMS and chars <= FEW_CHARS else _by_hash(t, i.withColumn("w", F.split("want", " ")))


def _by_automaton(t: DataFrame, i: DataFrame) -> DataFrame:
    kinds = ", ".join(f"{c} {x.schema[c].dataType.simpleString()}" for x, c in ((i, "item_id"), (t, "doc_id")))
    wanted: dict[str, list[Any]] = {}
    for item, want in i.collect():  # no more than FEW_ITEMS
        wanted.setdefault(want, []).append(item)
    held = t.sparkSession.sparkContext.broadcast(wanted) if wanted else None
    if held is None:
        return t.where(F.lit(False)).select(F.lit(None).cast(i.schema["item_id"].dataType).alias("item_id"), "doc_id")
    item_type = to_arrow_type(i.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        all_items = list(held.value.values())
        automaton = ahocorasick.Automaton()
        for k, want in enumerate(held.value):
            automaton.add_word(want, k)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for row, body in enumerate(batch.column(1).to_pylist()):
                for k in {k for _, k in automaton.iter(body)}:
                    found += all_items[k]
                    at += [row] * len(all_items[k])
            yield pa.RecordBatch.from_arrays([pa.array(found, item_type), batch.column(0).take(pa.array(at, pa.int64()))], ["item_id", "doc_id"])

    return t.mapInArrow(run, kinds)


def _by_hash(t: DataFrame, i: DataFrame) -> DataFrame:
    gram = lambda w, k: F.xxhash64(*[F.get(w, k + j) for j in range(PROBE)])
    is_long = F.size("w") >= PROBE + 2
    long = i.where(is_long).select("item_id", "want", gram(F.col("w"), F.lit(1)).alias("gram"))
    short = i.where(~is_long).select("item_id", "want", F.substring("want", 1, PROBE).alias("gram"))
    # words and characters are columns: inside the lambda they would be split anew for each run
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - PROBE, F.lit(0))), lambda k: gram(F.col("w"), k))
    at = F.sequence(F.lit(1), F.greatest(F.size("c"), F.lit(1)))
    cut = lambda m: F.transform(at, lambda k: F.array_join(F.slice("c", k, m), ""))
    letters = F.array_distinct(F.flatten(F.array(*map(cut, range(1, PROBE + 1)))))
    meets = t.withColumn("w", F.split("body", " ")).select("doc_id", F.explode(F.array_distinct(runs)).alias("gram")).join(long.select("item_id", "gram"), "gram")
    brief = t.withColumn("c", F.split("body", "")).select("doc_id", F.explode(letters).alias("gram")).join(short.select("item_id", "gram"), "gram")
    hits = meets.unionByName(brief).select("doc_id", "item_id").distinct().join(i.select("item_id", "want"), "item_id").join(t, "doc_id")
    return hits.where(F.contains("body", "want")).select("item_id", "doc_id")


def missed_items(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Items that no text holds."""
    return items.select("item_id").join(found_items(texts, items), "item_id", "left_anti")


def lookup(wanted: DataFrame, known: DataFrame, on: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of wanted joined with what is known of them, rows of wanted that are skipped as nothing is known of them)."""
    return wanted.join(known, on), wanted.join(known, on, "left_anti")


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows by the columns of order."""
    return df.orderBy(*order).limit(n)


def recall_by_group(hits: DataFrame, items: DataFrame, group: str) -> DataFrame:
    """(group, hits, total, recall), and the total in the row of a null group; without items there is no recall."""
    h = hits.select("item_id").distinct().withColumn("hit", F.lit(1))
    x = items.join(h, "item_id", "left").rollup(group).agg(F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("total"))
    return x.withColumn("recall", F.round(F.try_divide("hits", "total"), 6))


def items_of_markdown(lines: DataFrame) -> DataFrame:
    """(heading, item) from lines (doc, line_ix, line): a numbered line's first backticked span belongs to the heading
    above it; items before any heading are left out."""
    w = Window.partitionBy("doc").orderBy("line_ix").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike(r"^#+\s"), F.regexp_replace(F.col("line"), r"^#+\s+", ""))
    x = lines.withColumn("heading", F.last(head, ignorenulls=True).over(w))
    item = F.regexp_extract("line", r"^\s*\d+\.\s[^`]*`([^`]+)`", 1)
    return x.select("doc", "line_ix", "heading", item.alias("item")).where("heading is not null and item <> ''")


#: Words that point at something in view; a candidate has two at least and so many characters.
POINTING, LEAST, MOST = r"\b(this|here|that|these|there)\b", 40, 200


def pointing_sentences(texts: DataFrame) -> DataFrame:
    """(doc_id, sent_ix, sentence, pointers) of sentences that end at . ! ? or a line's end."""
    s = texts.select("doc_id", F.posexplode(F.split("text", r"[.!?\n]", -1)).alias("sent_ix", "s")).withColumn("sentence", F.trim("s"))
    n = F.regexp_count(F.lower("sentence"), F.lit(POINTING)).cast("long")
    return s.select("doc_id", "sent_ix", "sentence", n.alias("pointers")).where((F.col("pointers") >= 2) & F.char_length("sentence").between(LEAST, MOST))


def densest_per_bucket(candidates: DataFrame, seconds: float = 180.0, per_sentence: float = 4.0) -> DataFrame:
    """(doc_id, bucket, sent_ix, pointers): the candidate with most pointers in each span, of equals the first. A sentence
    without a clock starts per_sentence seconds after the one before."""
    start = F.col("sent_ix") * per_sentence
    c = candidates.withColumn("bucket", F.floor(start / seconds))
    k = F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy(F.desc("pointers"), "sent_ix"))
    return c.withColumn("k", k).where("k = 1").select("doc_id", "bucket", "sent_ix", "pointers")
