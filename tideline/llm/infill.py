"""Fill-in-middle transformation by escaped marker injection.

A delimiter that the text cannot hold, as what looks like it is escaped, is appended to each unit by one regexp_replace. Its
count is the number of units, and substring_index at ranked places gives the parts, which are unescaped and assembled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: A unit is a line with its newline, or what is left after the last newline.
LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, and the character that escapes it and itself.
_DELIMITER, _ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """The text without the delimiter: escape + `e` stands for the escape character, escape + `d` for the delimiter."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(f"{_ESCAPE}e")), F.lit(_DELIMITER), F.lit(f"{_ESCAPE}d"))


def unescaped(part: Column) -> Column:
    """The text of a part of a marked text: its delimiters go, what was escaped comes back."""
    bare = F.replace(part, F.lit(_DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(f"{_ESCAPE}d"), F.lit(_DELIMITER)), F.lit(f"{_ESCAPE}e"), F.lit(_ESCAPE))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32: the first 8-digit groups of the hash of seed and id. Rows of one id draw alike."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text of an output, from the output and its form alone. Markers have no border in common and a transformed text
    holds none, so the first of each is the one that was put there."""
    begun = F.substr(output, F.lit(len(PREFIX) + 1))
    first = F.when(form == "psm", F.substring_index(begun, SUFFIX, 1)).otherwise(F.substring_index(begun, PREFIX, 1))
    rest = F.substr(output, F.char_length(first) + 2 * len(PREFIX) + 1)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.char_length(second) + len(MIDDLE) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).otherwise(F.concat(second, middle, first))


def fill_in_middle(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs and their columns n, form, prefix_chars, middle_chars, output, in place of columns of these names.

    unit is a pattern whose matches, left to right, make up the whole text. Two draws cut a text of n units at places 0 to
    n; percent of the texts are transformed, spm_percent of these with the suffix first. A null or empty text stays as it is
    (form plain, output empty), and so does one that holds a marker, which could not be told from an inserted one. A null id
    draws like an empty one, and rows of one id draw alike, each from its own text. Texts may hold any character, the
    delimiter too, and have any length: each is worked on whole by functions that take time in proportion to it. An empty
    table gives an empty one. Other columns are carried as they are. There is nothing to be ranked, so there are no ties,
    and nothing is shuffled.
    """
    more = {"n", "form", "prefix_chars", "middle_chars", "output"}
    t, h, marked, n, a, b, form, prefix, middle, suffix = fresh(docs, "text", "draws", "marked", "n", "a", "b", "form", "prefix", "middle", "suffix")
    x = docs.withColumn(t, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(h, F.array(*draws(F.col(f"`{doc}`"), seed)))
    x = x.withColumn(marked, F.regexp_replace(escaped(F.col(t)), unit, f"$0{_DELIMITER}"))
    x = x.withColumn(n, (F.octet_length(marked) - F.octet_length(F.replace(F.col(marked), F.lit(_DELIMITER), F.lit("")))).cast("long"))
    place = lambda k: F.col(h)[k] % (F.col(n) + 1)
    x = x.withColumn(a, F.least(place(0), place(1)).cast("int")).withColumn(b, F.greatest(place(0), place(1)).cast("int"))
    is_plain = (F.col(t) == "") | F.col(t).contains(PREFIX) | F.col(t).contains(SUFFIX) | F.col(t).contains(MIDDLE) | (F.col(h)[2] % 100 >= percent)
    x = x.withColumn(form, F.when(is_plain, "plain").when(F.col(h)[3] % 100 < spm_percent, "spm").otherwise("psm"))
    part = lambda s, k: F.call_function("substring_index", s, F.lit(_DELIMITER), k)
    x = x.withColumn(prefix, unescaped(part(F.col(marked), F.col(a))))
    x = x.withColumn(middle, unescaped(part(part(F.col(marked), F.col(b)), F.col(a) - F.col(b))))
    x = x.withColumn(suffix, unescaped(part(F.col(marked), (F.col(b) - F.col(n) - 1).cast("int"))))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    chars = lambda c: F.when(F.col(form) != "plain", F.char_length(c).cast("long"))
    output = F.when(F.col(form) == "plain", F.col(t)).when(F.col(form) == "psm", psm).otherwise(spm)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in more]
    return x.select(*kept, F.col(n).alias("n"), F.col(form).alias("form"), chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.alias("output"))


def fill_in_middle_report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256. Odd
    rows and tables are as in fill_in_middle."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    x = fill_in_middle(docs.select("doc_id", "text"))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as x from documents),
u as (select doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') as lines, ('0x' || substr(x, 1, 8))::bigint as h1, ('0x' || substr(x, 9, 8))::bigint as h2,
  ('0x' || substr(x, 17, 8))::bigint as h3, ('0x' || substr(x, 25, 8))::bigint as h4 from d),
c as (select *, len(lines) as n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) as b from u),
p as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form,
  array_to_string(lines[1:a], '') as pre, array_to_string(lines[a + 1:b], '') as mid, array_to_string(lines[b + 1:n], '') as suf from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(pre)::bigint end as prefix_chars, case when form <> 'plain' then length(mid)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
  sha256(t) as restored_sha256
from p"""
