import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tremolo.operators.rollup import rollup
from tremolo.sources.readings import events_readings, load_readings_csv
from tremolo.streaming.rollup import (run_rollup_to_parquet, stream_readings,
                                      streaming_daily_rollup)

CSV = """Timestamp,Value,Situation
2023-05-01T10:00:00Z,15.2,Red
2023-05-01T12:00:00+03:00,1.0,GREEN
2023-05-01 11:00:00,abc,green
x,2.0,Yellow
2023-05-02T00:00:00,,red
"""


def test_csv_strict_and_lenient(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text(CSV)
    lenient = load_readings_csv(spark, str(p), mode="lenient").orderBy("ts").collect()
    assert [(str(r.ts), r.value, r.level) for r in lenient] == [
        ("2023-05-01 09:00:00", 1.0, "GREEN"),     # +03:00 converted to UTC
        ("2023-05-01 10:00:00", 15.2, "RED")]
    with pytest.raises(Exception):
        load_readings_csv(spark, str(p), mode="strict").collect()


def test_streaming_rollup_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    shutil.copy(f"{SF01}/events.parquet", src / "part-0.parquet")
    schema = spark.read.parquet(f"{SF01}/events.parquet").schema.simpleString()
    schema = schema[len("struct<"):-1].replace(":", " ")
    r = stream_readings(spark, str(src), schema, ts="ts", value="value",
                        machine="event_type", reading_id="event_id")
    q = run_rollup_to_parquet(streaming_daily_rollup(r, "0 seconds"), str(tmp_path / "out"),
                              str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = rollup(events_readings(spark, SF01))
    # with availableNow the last day stays open (the watermark has not passed it)
    last = batch.agg(F.max("period")).first()[0]
    want = batch.where(F.col("period") < last)
    cols = ["machine_id", "period", "level", "n", "min_value", "max_value"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())
