"""The transcript document of a recording and how it is written."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotADocument(ValueError):
    """What was read is JSON, but no object, or no JSON at all."""


def read_document(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        try:
            doc = json.load(f)
        except ValueError as e:
            raise NotADocument(path) from e
    if not isinstance(doc, dict):
        raise NotADocument(path)
    return doc


def is_object(text: Column) -> Column:
    """Whether a text is a JSON object; from_json alone would take an array for a null."""
    return F.coalesce(F.trim(text).startswith("{") & F.json_object_keys(text).isNotNull(), F.lit(False))


def write_text(path: str, text: str, fsync: bool = False) -> None:
    """Readers see all of the old text or all of the new; a failure leaves no temporary file behind."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(prefix=".", suffix=".tmp", dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            if fsync:
                f.flush()
                os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def documents(sentences: DataFrame, media: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(rec_id, document): one struct per recording (rec_id, audio, model), sentences in order; labels (rec_id, sent_ix,
    speaker, provenance) add speaker after end, and speakers and diarization after model. Nothing else changes."""
    s = sentences
    speaker: list[Column] = []
    if labels is not None:
        s = s.join(labels, ["rec_id", "sent_ix"], "left")
        speaker = [F.col("speaker")]
    item = F.struct(F.col("sent_ix"), F.struct("start", "end", *speaker, "text", "tokens").alias("s"))
    agg = [F.array_sort(F.collect_list(item), lambda a, b: a["sent_ix"] - b["sent_ix"]).alias("all")]
    if labels is not None:
        agg += [F.array_sort(F.collect_set("speaker")).alias("speakers"), F.first("provenance", ignorenulls=True).alias("diarization")]
    x = media.join(s.groupBy("rec_id").agg(*agg), "rec_id", "left")
    none = F.array().cast(x.schema["all"].dataType)
    lines = F.transform(F.coalesce("all", none), lambda z: z["s"])
    extra = [F.col("speakers"), F.col("diarization")] if labels is not None else []
    text = F.array_join(F.transform(lines, lambda z: F.trim(z["text"])), " ")
    return x.select("rec_id", F.struct("audio", "model", *extra, text.alias("text"), lines.alias("sentences")).alias("document"))


def with_marks(docs: DataFrame, marks: DataFrame, meta: DataFrame) -> DataFrame:
    """(rec_id, document) with marks (t, score, look; three places, halves to even) and marks_meta at the end."""
    m = marks.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct(F.bround("t", 3).alias("t"), "score", F.bround("look", 3).alias("look")))).alias("marks"))
    x = docs.join(m, "rec_id", "left").join(meta, "rec_id", "left")
    none = F.array().cast(x.schema["marks"].dataType)
    return x.select("rec_id", F.col("document").withField("marks", F.coalesce("marks", none)).withField("marks_meta", F.col("marks_meta")).alias("document"))


def to_text(docs: DataFrame) -> DataFrame:
    """(rec_id, json): null fields are left out, so what is absent has not been run."""
    return docs.select("rec_id", F.to_json("document").alias("json"))


def append_lines(rows: DataFrame, folder: str) -> None:
    """Adds rows as JSON lines to what the folder holds."""
    rows.write.mode("append").json(folder)


def write_twice(path: str, base: dict[str, Any], label: Callable[[dict[str, Any]], dict[str, Any] | None]) -> dict[str, Any]:
    """Writes the document without labels first, then with them: whatever the optional stage does, the base is there. None
    from label leaves it as it is; errors of label go on, with the base written."""
    write_text(path, json.dumps(base, ensure_ascii=False))
    if (labelled := label(base)) is not None:
        write_text(path, json.dumps(labelled, ensure_ascii=False))
        return labelled
    return base


def size_overhead(docs: DataFrame, variants: dict[str, Column]) -> DataFrame:
    """(rec_id, variant, overhead): by how much each variant's JSON is longer than the document's."""
    base = F.length(F.to_json("document"))
    out = [F.struct(F.lit(k).alias("variant"), F.round(F.length(F.to_json(v)) / base - 1, 6).alias("overhead")) for k, v in variants.items()]
    return docs.select("rec_id", F.inline(F.array(*out)))
