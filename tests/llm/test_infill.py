"""Fill-in-middle against a plain version, and the texts that its markers and its delimiter could trip over."""

import hashlib
import random
import re

import pytest
from brute import sha

from tideline.llm import infill


def plain(i, text, seed=7, percent=100, spm_percent=50, unit=r"[^\n]*\n|[^\n]+"):
    """(n, form, prefix_chars, middle_chars, output)."""
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(unit, text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(z in text for z in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm_percent:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    odd = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "<P>", "x<M>y\n", "<S", "S>\n<", "<<P\n>P>\n<S\n<M", "\x01\x02\n\x02\x01d\n\x02e\x02d", "\r\n\r\n", "é\n漢字\n🎈", "  \u0085\nx", "$0\n\\1\n"]
    alphabet = ["a", "é", "\n", "\n", "<", ">", "P", "S", "M", "\x01", "\x02", "d", "e", " ", "🎈"]
    return odd + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(300)] + ["long line " * 30_000, "l\n" * 60_000]


@pytest.mark.parametrize("percent, spm, unit", [(100, 50, infill.LINE), (60, 10, infill.LINE), (100, 100, r"[ \n]*[^ \n]+[ \n]*|[ \n]+")])
def test_forms_and_parts(spark, percent, spm, unit):
    rows = list(enumerate(texts())) + [(None, "no\nid"), (None, "other"), (7, "twice\none id"), (7, "twice\none id")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, OUTPUT string").repartition(6)
    x = infill.fill_in_middle(df, percent=percent, spm_percent=spm, unit=unit)
    assert x.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    key = lambda r: repr((r[0], r[1]))
    got = sorted(map(tuple, x.collect()), key=key)
    assert got == sorted(((i, t, *plain(i, t, 7, percent, spm, unit)) for i, t in rows), key=key)
    assert {r[3] for r in got} == ({"plain", "spm", "psm"} if spm < 100 else {"plain", "spm"})


def test_texts_come_back(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: r for r in infill.fill_in_middle_report(df).collect()}
    for i, t in rows:
        want = plain(i, t)
        assert got[i][1:] == (*want[:4], sha(want[4]), sha(t or ""))


def test_empty_table_and_plan(spark):
    none = spark.createDataFrame([], "doc_id long, text string, form string")
    x = infill.fill_in_middle(none)
    assert x.count() == 0 and x.columns[:3] == ["doc_id", "text", "n"]
    assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
