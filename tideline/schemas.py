"""Row types of the timeline model, as DDL, which needs no session. Every table is keyed by rec_id, the recording."""

AUDIO_STREAM = "codec STRING, sample_rate INT, channels INT, duration_s DOUBLE"
CHUNK = "rec_id STRING, chunk_ix INT, start BIGINT, end BIGINT, next_start BIGINT"
ALIGNED_TOKEN = "id INT, text STRING, start DOUBLE, duration DOUBLE, confidence DOUBLE"
OUTPUT_TOKEN = "t DOUBLE, w STRING"
SENTENCE = "rec_id STRING, sent_ix INT, start DOUBLE, end DOUBLE, speaker INT, text STRING, tokens ARRAY<STRUCT<t: DOUBLE, w: STRING>>"
TRANSCRIPTION = "text STRING, sentences ARRAY<STRUCT<start: DOUBLE, end: DOUBLE, text: STRING, tokens: ARRAY<STRUCT<t: DOUBLE, w: STRING>>>>"
TURN = "rec_id STRING, start DOUBLE, end DOUBLE, speaker INT"
FRAME = "rec_id STRING, frame_ix INT, tiles BINARY"
SCORE = "rec_id STRING, i INT, score INT"
MARK = "t DOUBLE, score INT, look DOUBLE"
MARKS_META = "source STRING, fps DOUBLE, grid ARRAY<INT>, delta INT, budget INT, min_gap_s DOUBLE, frames_sampled INT"
FINGERPRINT = "schema INT, media STRING, media_size BIGINT, media_mtime_ns BIGINT, total_samples BIGINT, model_id STRING, engine_version STRING, chunk_s DOUBLE, overlap_s DOUBLE"
CHECKPOINT = f"fingerprint STRUCT<{FINGERPRINT}>, next_start BIGINT, tokens ARRAY<STRUCT<{ALIGNED_TOKEN}>>"
CHANGE_POINT = "rec_id STRING, time DOUBLE, lower_bound DOUBLE, from_slide INT, to_slide INT, kind STRING"
KEYFRAMES = "video_path STRING, app STRING, keyframes ARRAY<STRUCT<frame: INT>>"
