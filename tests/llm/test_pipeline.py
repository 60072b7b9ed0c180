"""The pipeline and each of its stages against plain versions."""

import public_tokenizers
import tiktoken
from brute import components, lines, quality, sha
from test_text_operators import CORPUS

import corpus_pipeline
from tideline.llm import bpe, mixing
from tideline.llm.queries import RANKS


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in CORPUS.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "mixing", "byte-level BPE"]
    columns, now, at = docs.columns, docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        at[name] = now.collect()
        assert k == 4 or now.columns == columns
    kept = {i: t for i, t in CORPUS.items() if quality(t)[6]}
    assert {r.doc_id for r in at["quality rules"]} == set(kept) and len(kept) > 8
    left = {i: t for i, (_, _, t) in lines(kept).items()}
    assert {r.doc_id: (r.text or "", r.n_chars) for r in at["line dedup"]} == {i: (t, len(t)) for i, t in left.items()}
    first = {i: t for i, t in left.items() if components(left, 5)[i][1] == i}
    assert {r.doc_id: r.text for r in at["near-dedup"]} == first and len(first) < len(left)
    copies = {r.doc_id: r.taken // max(1, r["size"]) for r in mixing.mixing_report(spark.createDataFrame(at["near-dedup"], docs.schema)).collect()}
    assert sorted(r.doc_id for r in at["mixing"]) == sorted(i for i in first for _ in range(copies[i]))
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    for r in at["byte-level BPE"]:
        ids = lib.encode_ordinary(first[r.doc_id])
        assert r.n_tokens == len(ids) and r.decoded_sha256 == sha(first[r.doc_id]) and bytes(r.ids)[:4] == ids[0].to_bytes(4, "little")
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(at["byte-level BPE"])
