"""The engine's queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import changepoints, changes, chunks, detectors, document, evaluate, recall, sentences, speakers, stitch
from ..streaming import checkpoints, resume, stateful
from . import adapters as A

#: Change threshold, marks per recording and their spacing in the queries.
DELTA, BUDGET, GAP = 16, 10, 3.0
#: Draws of the random baselines: sets of random times, and of random seconds.
DRAWS, SCREEN_DRAWS = 30, 30
#: Grid factors, thresholds, masks and region sizes of the sweep.
SWEEP = {"factors": (1, 2), "deltas": [16, 48], "masks": [0.5, 0.9], "sizes": [2, 6, 12]}


def _scores(s: SparkSession, d: str) -> DataFrame:
    return changes.change_scores(A.frames(s, d), DELTA)


def _marks(s: SparkSession, d: str) -> DataFrame:
    return changes.select_marks(_scores(s, d), 1.0, BUDGET, GAP)


def _event_marks(s: SparkSession, d: str) -> DataFrame:
    return changes.select_marks(A.event_scores(s, d), 1.0, BUDGET, GAP)


def _matched_marks(s: SparkSession, d: str) -> DataFrame:
    """As many marks as a recording has purchases."""
    budget = A.events(s, d).groupBy("rec_id").agg(F.count_if(F.col("event_type") == "purchase").alias("b"))
    return changes.select_marks(A.event_scores(s, d).join(budget, "rec_id"), 1.0, F.col("b"), 0.0)


def _purchases(s: SparkSession, d: str) -> DataFrame:
    return A.events(s, d).where("event_type = 'purchase'").select("rec_id", F.col("i").cast("double").alias("t"))


def _sentence_spans(s: SparkSession, d: str) -> DataFrame:
    return A.tokens(s, d).groupBy("rec_id", "sent_ix").agg(F.min_by("t", "pos").alias("start"), F.max_by("t", "pos").alias("end"))


def _tv(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: f(A.tokens(s, d), A.turns(s, d), A.WEEK)


def _labels(s: SparkSession, d: str) -> DataFrame:
    return speakers.label_sentences(A.tokens(s, d), A.turns(s, d), A.WEEK)


def _token_points(s: SparkSession, d: str) -> DataFrame:
    return A.tokens(s, d).select("rec_id", "pos", "t")


def _hashes(s: SparkSession, d: str) -> DataFrame:
    return detectors.difference_hash(A.frames(s, d))


def _overlap(s: SparkSession, d: str) -> DataFrame:
    return speakers.overlap_labels(_sentence_spans(s, d), A.turns(s, d), A.WEEK)


def _word_tokens(s: SparkSession, d: str) -> DataFrame:
    """Words of a conversation as tokens, 0.4 s each, turn after turn."""
    c = A.table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.posexplode(F.split("text", " ")).alias("k", "w"), "turn")
    pos = F.row_number().over(Window.partitionBy("rec_id").orderBy("turn", "k")) - 1
    return c.select("rec_id", pos.alias("pos"), F.concat(F.lit(" "), "w").alias("text"), F.round(pos * 0.4, 6).alias("start"), F.lit(0.4).alias("duration"))


def _sentences(s: SparkSession, d: str) -> DataFrame:
    x = sentences.sentences(_word_tokens(s, d))
    return x.select("rec_id", "sent_ix", "start", F.round("end", 6).alias("end"), "text", F.size("tokens").alias("n_tokens"))


def _deictic(s: SparkSession, d: str) -> DataFrame:
    """All languages: the words that point are English ones, and a sentence of another language that holds them counts."""
    return recall.pointing_sentences(A.table(s, d, "documents"))


def _progress(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events").select("event_id", "value")
    done, total, from_, took = F.col("value"), F.lit(4427.028), F.lit(2.0), F.col("event_id") / 100.0
    return e.select(
        "event_id", scalars.clock(F.col("value") * 20).alias("at"), F.round(scalars.fraction(done, total), 6).alias("fraction"), F.round(scalars.speed(done, from_, took), 6).alias("speed"),
        scalars.clock(scalars.eta(done, total, from_, took)).alias("eta"),
    )


def _bars(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events").select("event_id", "value")
    return e.select("event_id", scalars.progress_bar(F.col("value"), F.lit(4427.028), F.lit(2.0), F.col("event_id") / 100.0, F.lit("running")).alias("bar"))


def _small(s: SparkSession, d: str) -> DataFrame:
    """Small scalars over orders: samples to seconds, rounding, chunk paths, base names, frame rates, parsers, conversion."""
    o = A.table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_custkey")
    rate = F.concat_ws("/", F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 4).cast("string"))
    lines = F.concat_ws("\n", F.lit("frame=1"), F.concat(F.lit("out_time_us="), F.when(F.col("o_orderkey") % 5 == 0, "N/A").otherwise((F.col("o_orderkey") * 1_000).cast("string"))), F.lit("progress=end"))
    path = F.concat(F.lit("/media/"), F.col("o_orderstatus"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".mov"))
    return o.select(
        "o_orderkey", scalars.samples_to_seconds(F.col("o_orderkey"), 16_000).alias("seconds"), F.round(scalars.frame_rate(rate), 6).alias("rate"), scalars.out_seconds(lines).alias("out_s"),
        scalars.base_name(path).alias("base"), scalars.checkpoint_path(path).alias("checkpoint"), scalars.needs_conversion(F.when(F.col("o_orderstatus") == "F", "pcm_s16le").otherwise("aac"), F.lit(16_000), (F.col("o_orderkey") % 2 + 1).cast("int")).alias("convert"),
        evaluate.per_minute_budget(F.col("o_custkey"), 1.0).alias("budget"),
    )


def _fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Manifest rows of documents whose fingerprint (language, source, version) is the wanted one in every field; nulls equal nulls."""
    docs = A.table(s, d, "documents").select("doc_id", F.struct("lang", "source", (F.col("doc_id") % 10).cast("int").alias("version")).alias("fingerprint"))
    return resume.valid_rows(docs, {"lang": "en", "source": "src7", "version": 7}).unionByName(resume.valid_rows(docs, {"lang": "de", "source": "src4", "version": 4})).select("doc_id")


def _chunked(s: SparkSession, d: str) -> DataFrame:
    """A user's events as tokens of overlapping chunks, 12 long and 8 apart."""
    e = A.events(s, d).select("rec_id", F.col("event_id").cast("int").alias("id"), F.concat(F.lit(" "), "event_type").alias("text"), F.col("i").cast("double").alias("start"))
    one = e.withColumns({"duration": F.lit(0.5), "confidence": F.lit(1.0)})
    return one.withColumn("chunk_ix", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("start") - 11) / 8)), F.floor(F.col("start") / 8)))).withColumn("pos", F.col("start").cast("int"))


def _stateful(s: SparkSession, d: str) -> DataFrame:
    """The same chunks, in the order in which Spark hands them over, through keyed state."""
    x = stitch.chunk_lists(_chunked(s, d))
    n = F.count("*").over(Window.partitionBy("rec_id")).cast("int")
    return stateful.stitched(stateful.stitch_log(x.select("rec_id", "chunk_ix", n.alias("n_chunks"), "tokens"), overlap_s=4.0))


def _checkpoints(s: SparkSession, d: str) -> DataFrame:
    """A checkpoint for each document, most of them void in one way or another, by its number; what each is judged."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 16
    name = F.concat(F.lit("/media/"), F.coalesce("source", F.lit("none")))
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    of = text('{"media": "', name, '", "size": ', F.when(k == 6, F.concat(i, F.lit(".0"))).when(k == 1, "-1").otherwise(i), F.when(k == 2, "").otherwise(', "chunk_s": 120'), F.when(k == 3, ', "more": 1').otherwise(""), "}")
    start = F.when(k == 4, F.concat(F.lit('"'), i, F.lit('"'))).when(k == 5, F.concat(i, F.lit(".0"))).when(k == 7, "true").otherwise(i)
    first = F.when(k == 8, '{"id": 1, "text": "a", "start": 0, "duration": 1}').when(k == 9, '{"id": 1.5, "text": "a", "start": 0, "duration": 1, "confidence": 1}').when(k == 10, "7").when(k == 11, '{"id": 1, "text": 2, "start": 0, "duration": 1, "confidence": 1}')
    first = first.otherwise(text('{"id": ', i, ', "text": " a", "start": ', (F.col("doc_id") % 7).cast("string"), '.25, "duration": 1, "confidence": 0.5}'))
    tokens = F.when(k == 12, '"nope"').when(k == 13, "[]").otherwise(text("[", first, ', {"id": 2, "text": "b", "start": 1, "duration": 0.5, "confidence": 1}]'))
    doc = F.when(k == 14, "{").otherwise(text('{"fingerprint": ', of, ', "next_start": ', start, ', "tokens": ', tokens, "}"))
    wanted = F.struct(name.alias("media"), F.col("doc_id").alias("size"), F.lit(120.0).alias("chunk_s"))
    x = A.table(s, d, "documents").select(F.col("doc_id").alias("rec_id"), F.when(k != 15, doc).alias("document"), wanted.alias("fingerprint"))
    seconds = F.aggregate("tokens", F.lit(0.0), lambda a, t: a + t["start"] + t["duration"])
    return checkpoints.judged(x).select("rec_id", "void", "next_start", F.size("tokens").alias("n_tokens"), F.round(seconds, 6).alias("seconds"))


def _shifted(s: SparkSession, d: str) -> DataFrame:
    """Tokens in their chunk's own time, moved to the recording's."""
    x = _chunked(s, d).withColumn("chunk_start", F.col("chunk_ix") * 128_000).withColumn("start", F.col("start") - F.col("chunk_ix") * 8)
    return chunks.shift_tokens(x).select("rec_id", "chunk_ix", "pos", "start")


def _geometry(s: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_geometry(A.table(s, d, "documents").select(F.col("doc_id").alias("rec_id"), F.col("n_chars").alias("total")), rate=10, chunk_s=120.0, overlap_s=15.0, hop=16)


def _spans(s: SparkSession, d: str) -> DataFrame:
    return A.events(s, d).groupBy("rec_id").agg(F.count("*").cast("double").alias("duration"))


def _screens(s: SparkSession, d: str) -> DataFrame:
    return evaluate.random_screens(A.frames(s, d), _marks(s, d), SCREEN_DRAWS, DELTA)


def _truth(s: SparkSession, d: str) -> DataFrame:
    """Purchases at twice their place, so that some lie beyond the recording."""
    spans = A.events(s, d).groupBy("rec_id").agg(F.count("*").cast("double").alias("duration"), F.count("*").alias("n_frames"))
    return evaluate.usable_truth(_purchases(s, d).withColumn("t", F.col("t") * 2), spans, 2, 8)


def _intervals(s: SparkSession, d: str) -> DataFrame:
    return changepoints.change_points(A.slides(s, d)).select("rec_id", F.col("lower_bound").alias("lo"), F.col("time").alias("hi"))


def _outputs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents of two runs: every tenth differs, every seventh is missing from the second."""
    a = A.table(s, d, "documents").select(F.col("doc_id").alias("rec_id"), "lang", "n_chars")
    return a, a.where("rec_id % 7 <> 3").withColumn("n_chars", F.when(F.col("rec_id") % 10 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))


def _differences(s: SparkSession, d: str) -> DataFrame:
    return evaluate.first_difference(*_outputs(s, d), ["rec_id"], "n_chars").select("rec_id", F.col("left_sha256").isNull().alias("left_missing"), F.col("right_sha256").isNull().alias("right_missing"))


def _json(s: SparkSession, d: str) -> DataFrame:
    a, _ = _outputs(s, d)
    before = a.select("rec_id", F.to_json(F.struct("lang", "n_chars")).alias("document"))
    after = a.select("rec_id", F.to_json(F.struct("lang", F.col("n_chars").alias("marks"), F.when(F.col("rec_id") % 2 == 0, F.col("n_chars")).alias("n_chars"))).alias("document"))
    return evaluate.added_keys(before, after).select("rec_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


def _overhead(s: SparkSession, d: str) -> DataFrame:
    x = A.table(s, d, "labels").select(F.col("doc_id").alias("rec_id"), F.struct(F.col("doc_id").alias("a"), F.col("quality").alias("b")).alias("document"))
    wide = F.struct(F.col("document.a").alias("a"), F.col("document.b").alias("b"), F.lit("SPEAKER_00").alias("speaker"))
    return document.size_overhead(x, {"speaker": wide, "same": F.col("document")})


def _grades(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events")
    return evaluate.arm_totals(e.select((F.col("user_id") % 3).alias("arm"), F.when(F.col("event_type") == "view", "correct").when(F.col("event_type") == "click", "hedge").otherwise("fabricate").alias("grade")))


def _sweep(s: SparkSession, d: str) -> DataFrame:
    return detectors.sweep(A.frames(s, d), SWEEP["deltas"], SWEEP["masks"], SWEEP["sizes"], 8, SWEEP["factors"])


def _best(s: SparkSession, d: str) -> DataFrame:
    """Of configurations that mark every recording, the one with the fewest marks."""
    x = _sweep(s, d).groupBy("config_ix").agg(F.sum("n_marks").alias("n_marks"), (F.min("n_marks") > 0).alias("hit"))
    return detectors.best_config(x).select("config_ix", "n_marks")


def _skips(s: SparkSession, d: str, which: int) -> DataFrame:
    return recall.lookup(A.table(s, d, "documents").select("doc_id", "lang"), A.table(s, d, "labels").select("doc_id", "quality"), "doc_id")[which]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "change_scores": _scores,
    "change_marks": _marks,
    "marks_events": _event_marks,
    "change_marks_budget_matched": _matched_marks,
    "mark_gaps": lambda s, d: changes.mark_gaps(_event_marks(s, d)),
    "mark_bucket_counts": lambda s, d: changes.marks_per_bucket(_event_marks(s, d), 20.0),
    "score_percentiles": lambda s, d: changes.score_percentiles(A.event_scores(s, d)),
    "asof_speaker": lambda s, d: speakers.speaker_at(_token_points(s, d), A.turns(s, d), A.WEEK),
    "nearest_speaker": lambda s, d: speakers.nearest_speaker(_token_points(s, d), A.turns(s, d), A.WEEK),
    "speaker_vote": _tv(speakers.label_sentences),
    "vote_census": _tv(speakers.vote_census),
    "vote_margins": _tv(speakers.vote_margins),
    "speaker_wins": _tv(speakers.sentences_per_speaker),
    "speaker_totals": lambda s, d: speakers.seconds_per_speaker(A.turns(s, d)),
    "speaker_runs": lambda s, d: speakers.speaker_runs(_labels(s, d)),
    "label_encode": lambda s, d: speakers.encode_labels(A.table(s, d, "conversations").select(F.col("conv_id").alias("rec_id"), F.col("role").alias("label"))),
    "overlap_label": _overlap,
    "vote_overlap_disagreement": lambda s, d: speakers.disagreements(_labels(s, d), _overlap(s, d)),
    "turn_overlap_violations": lambda s, d: speakers.overlapping_turns(A.turns(s, d).withColumn("end", F.col("start") + A.TURN_SECONDS)),
    "chunk_geometry": _geometry,
    "chunks_remaining": lambda s, d: chunks.remaining(_geometry(s, d), 1_050).select("rec_id", "chunk_ix", "start"),
    "chunks_reported": lambda s, d: chunks.reported_seconds(_geometry(s, d), 10),
    "token_shift": _shifted,
    "sentence_segments": _sentences,
    "changepoints": lambda s, d: changepoints.change_points(A.slides(s, d)),
    "changepoint_summary": lambda s, d: changepoints.recording_totals(A.slides(s, d)),
    "changepoint_corpus": lambda s, d: changepoints.corpus_totals(A.slides(s, d)),
    "nearest_distance": lambda s, d: evaluate.nearest_distance(_event_marks(s, d), _purchases(s, d)),
    "interval_distance": lambda s, d: evaluate.interval_distance(_event_marks(s, d), _intervals(s, d)),
    "interval_hits": lambda s, d: evaluate.hit_summary(evaluate.interval_distance(_event_marks(s, d), _intervals(s, d))),
    "segment_coverage": lambda s, d: evaluate.coverage(A.frames(s, d), _marks(s, d), DELTA),
    "frame_instability": lambda s, d: evaluate.instability(A.frames(s, d), DELTA),
    "unstable_marks": lambda s, d: evaluate.unstable_share(_marks(s, d), evaluate.instability(A.frames(s, d), DELTA)),
    "preceding_mark_age": lambda s, d: evaluate.preceding_coverage(_purchases(s, d), _event_marks(s, d)),
    "noise_floor": lambda s, d: evaluate.noise_floor(_scores(s, d)),
    "random_baseline": lambda s, d: evaluate.random_baseline(_purchases(s, d), _spans(s, d), DRAWS, BUDGET),
    "random_distance_p": lambda s, d: evaluate.distance_p(_purchases(s, d), _event_marks(s, d), _spans(s, d), DRAWS, BUDGET),
    "random_screens": _screens,
    "coverage_sigma": lambda s, d: evaluate.sigma_above_random(evaluate.coverage(A.frames(s, d), _marks(s, d), DELTA), _screens(s, d), "coverage"),
    "usable_truth": _truth,
    "usable_intervals": lambda s, d: evaluate.usable_intervals(_intervals(s, d), _event_marks(s, d)),
    "sign_test": lambda s, d: evaluate.sign_test_row(A.table(s, d, "labels").select(F.col("toxic").alias("ours"), F.col("quality").alias("theirs"))),
    "recall_pairs": lambda s, d: recall.found_items(A.table(s, d, "documents"), A.table(s, d, "benchmark")),
    "recall_misses": lambda s, d: recall.missed_items(A.table(s, d, "documents"), A.table(s, d, "benchmark")),
    "recall_by_item": lambda s, d: recall.recall_by_group(recall.found_items(A.table(s, d, "documents"), A.table(s, d, "benchmark")), A.table(s, d, "benchmark").select("item_id", (F.col("item_id") % 5).cast("string").alias("grp")), "grp"),
    "deictic_candidates": _deictic,
    "deictic_densest_bucket": lambda s, d: recall.densest_per_bucket(_deictic(s, d)),
    "hash_consecutive": lambda s, d: detectors.hamming_steps(_hashes(s, d)),
    "hash_summary": lambda s, d: detectors.hamming_summary(detectors.hamming_steps(_hashes(s, d))),
    "hash_keep_last": lambda s, d: detectors.keep_changed(_hashes(s, d), 26).select("rec_id", "frame_ix"),
    "tile_activity": lambda s, d: detectors.tile_activity(A.frames(s, d), DELTA),
    "row_activity": lambda s, d: detectors.row_activity(detectors.tile_activity(A.frames(s, d), DELTA)),
    "coarse_frames": lambda s, d: detectors.coarsen(A.frames(s, d), 8, 3).withColumn("tiles", F.array_join("tiles", ",")),
    "component_size": lambda s, d: detectors.component_sizes(A.frames(s, d), 8, DELTA),
    "region_marks": lambda s, d: detectors.region_marks(A.frames(s, d), 8, DELTA, most=0.5, least=8, cap=1.0),
    "sweep_marks": _sweep,
    "best_config": _best,
    "stitch_overlap": lambda s, d: stitch.stitch(_chunked(s, d), overlap_s=4.0),
    "stitch_stateful": _stateful,
    "progress_clock": _progress,
    "progress_bar": _bars,
    "scalars": _small,
    "first_difference": _differences,
    "added_keys": _json,
    "size_overhead": _overhead,
    "arm_totals": _grades,
    "lookup_known": lambda s, d: _skips(s, d, 0),
    "lookup_skipped": lambda s, d: _skips(s, d, 1),
    "first_n": lambda s, d: recall.first_n(A.events(s, d).select("rec_id", "i", "value"), 25, "rec_id", "i"),
    "fingerprint_match": _fingerprints,
    "checkpoint_judged": _checkpoints,
}
