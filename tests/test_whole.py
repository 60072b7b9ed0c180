"""Registered queries take in whole tables."""

import datetime as dt

from tideline.plans import catalog


def test_stitch_takes_in_every_recording(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(k, user, at + dt.timedelta(minutes=k), "view", 1.0) for k, user in enumerate([3, 19, 20, 21, 4_000] * 25)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    df.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["stitch_overlap"](spark, str(tmp_path)).select("rec_id", "pos", "id").collect()
    want = [(user, i, 5 * i + k) for k, user in enumerate([3, 19, 20, 21, 4_000]) for i in range(25)]
    assert sorted(map(tuple, got)) == sorted(want)
