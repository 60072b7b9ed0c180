"""Checkpoints judged as a table: which of many documents a run may go on from.

Documents are parsed to VARIANT, so what a value is in the JSON counts, not what it could be cast to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_TOKEN = {"id": "bigint", "text": "string", "start": "double", "duration": "double", "confidence": "double"}
#: Numbers are compared as such, whole or not, as far as this type holds them.
_EXACT = "decimal(38,10)"


def _kind(v: Column) -> Column:
    """What a value is: BIGINT, DECIMAL(..), DOUBLE, STRING, ..., and null for one that is not there."""
    return F.schema_of_variant(v)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_number(v: Column) -> Column:
    kind = _kind(v)
    return (kind == "BIGINT") | kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT")


def _same(v: Column, wanted: Column, text: bool) -> Column:
    """Whether a JSON value equals the wanted one: a text a text, a number a number of its value, null an explicit null."""
    if text:
        equal = (_kind(v) == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    else:
        equal = _is_number(v) & (F.try_variant_get(v, "$", _EXACT) == wanted.cast(_EXACT))
    return F.when(wanted.isNull(), F.is_variant_null(v)).otherwise(equal)


def judged(checkpoints: DataFrame, fingerprint: str = "fingerprint", document: str = "document") -> DataFrame:
    """checkpoints (rec_id, document, fingerprint struct) with void, next_start and tokens.

    void is null for a checkpoint to go on from, else the first thing that is wrong: `json` (none, or not an object),
    `fingerprint` (any field other, missing or more than in the struct), `next_start` (must be a whole number as such: neither
    44.0 nor "44"), `tokens` (not a list, or one of them lacks a field or has one of a wrong kind: id must be whole, text a
    text, the others numbers, whole or not). A void one has no next_start and no tokens; nothing is an error. Keys that are
    there twice, and numbers that JSON does not know, are not JSON. A null document is no checkpoint.
    """
    fields = checkpoints.schema[fingerprint].dataType
    assert isinstance(fields, StructType)
    v = F.try_parse_json(F.col(document))
    x = checkpoints.withColumn("__v", v)
    doc = F.col("__v")
    of = _at(doc, "$.fingerprint")
    keys = F.array_sort(F.json_object_keys(F.to_json(of)))
    same = keys == F.array(*map(F.lit, sorted(f.name for f in fields)))
    for f in fields:
        same = same & _same(_at(doc, f"$.fingerprint.{f.name}"), F.col(f"{fingerprint}.{f.name}"), isinstance(f.dataType, StringType))
    whole = _kind(_at(doc, "$.next_start")) == "BIGINT"
    tokens = F.try_variant_get(doc, "$.tokens", "array<variant>")
    listed = _kind(_at(doc, "$.tokens")).startswith("ARRAY")
    sound = lambda t: (_kind(_at(t, "$.id")) == "BIGINT") & (_kind(_at(t, "$.text")) == "STRING") & _is_number(_at(t, "$.start")) & _is_number(_at(t, "$.duration")) & _is_number(_at(t, "$.confidence"))
    good = listed & F.forall(tokens, lambda t: F.coalesce(sound(t), F.lit(False)))
    holds = lambda c: F.coalesce(c, F.lit(False))
    void = (
        F.when(~holds(_kind(doc).startswith("OBJECT")), "json").when(~holds(F.is_variant_null(of) == F.lit(False)) | ~holds(same), "fingerprint")
        .when(~holds(whole), "next_start").when(~holds(good), "tokens")
    )
    of_token = lambda t: F.struct(*[F.try_variant_get(t, f"$.{k}", kind).alias(k) for k, kind in _TOKEN.items()])
    x = x.withColumn("__void", void)
    valid = F.col("__void").isNull()
    return x.select(
        *[F.col(f"`{c}`") for c in checkpoints.columns], F.col("__void").alias("void"),
        F.when(valid, F.try_variant_get(doc, "$.next_start", "bigint")).alias("next_start"), F.when(valid, F.transform(tokens, of_token)).alias("tokens"),
    )


def going_on(recordings: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(rec_id, next_start, tokens) for recordings (rec_id, fingerprint struct): from where each is to be processed. A recording
    without a checkpoint (rec_id, document) that holds begins at 0 with no tokens."""
    x = judged(recordings.join(checkpoints.select("rec_id", "document"), "rec_id", "left"))
    none = F.array().cast(x.schema["tokens"].dataType)
    return x.select("rec_id", F.coalesce("next_start", F.lit(0)).cast("long").alias("next_start"), F.coalesce("tokens", none).alias("tokens"))
