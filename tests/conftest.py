import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tremolo.session import build_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


def make_readings(spark, rows, machine="M1"):
    """rows: (reading_id, 'YYYY-MM-DD HH:MM:SS[.f]', value, level_raw or None)."""
    from pyspark.sql import functions as F

    from tremolo.functions.levels import band_level
    from tremolo.sources.readings import finish_readings
    df = spark.createDataFrame(
        [(rid, machine, ts, v, lv) for rid, ts, v, lv in rows],
        "reading_id long, machine_id string, ts_text string, value double, lv string")
    df = df.select("reading_id", "machine_id",
                   F.to_timestamp_ntz("ts_text").alias("ts"), "value",
                   F.coalesce(F.col("lv"), band_level(F.col("value"))).alias("level_raw"))
    return finish_readings(df)
