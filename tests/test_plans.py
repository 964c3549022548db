"""Plan checks: what the physical plans must (not) contain at scale."""
from conftest import SF01
from tremolo import registry as R


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sequences_never_gather_a_machine_in_one_partition(spark):
    for name in ("red_runs", "longest_red_run", "green_to_red_dates", "green_to_red_count",
                 "change_density_top"):
        plan = _plan(R.QUERIES[name](spark, SF01))
        assert "SinglePartition" not in plan, name
        # windows see a row or two per range partition, not the readings
        assert "hashpartitioning(machine_id" in plan, name


def test_day_and_year_filters_reach_the_scan(spark):
    plan = _plan(R.QUERIES["day_range"](spark, SF01))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    plan = _plan(R.QUERIES["year_summary"](spark, SF01))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(R.QUERIES["value_range"](spark, SF01))
    # props and user_id are never read for a value range
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_rollup_aggregates_map_side(spark):
    plan = _plan(R.QUERIES["peak_days_red"](spark, SF01))
    assert "partial_count" in plan


def test_catalogue_join_is_broadcast(spark):
    plan = _plan(R.QUERIES["route_questions"](spark, SF01))
    assert "BroadcastHashJoin" in plan


def test_date_partitioned_readings_prune_partitions(spark, tmp_path):
    from tremolo.operators import catalogue as cat
    from tremolo.sources.readings import events_readings, write_readings
    out = str(tmp_path / "readings")
    write_readings(events_readings(spark, SF01), out)
    stored = spark.read.parquet(out)
    plan = _plan(cat.day_range(stored, "2024-01-15"))
    assert "PartitionFilters: [isnotnull(date" in plan and "2024-01-15" in plan
    assert cat.day_range(stored, "2024-01-15").count() == \
        cat.day_range(events_readings(spark, SF01), "2024-01-15").count()


def test_chat_flatten_gathers_no_session(spark):
    from conftest import SF001
    from tremolo.registry import QUERIES
    df = QUERIES["chat_flatten"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Exchange" not in plan
    assert df.count() == spark.read.parquet(f"{SF001}/conversations.parquet").count()


def test_read_session_takes_a_table_of_ids(spark):
    from tremolo.operators.chats import read_session
    turns = spark.createDataFrame([(i, k, "user", f"{i}.{k}") for i in (3, 1, 2) for k in (1, 0)],
                                  "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1,), (3,), (3,), (9,)], "conv_id long")
    assert [r.text for r in read_session(turns, asked).collect()] == ["1.0", "1.1", "3.0", "3.1"]


def _scanned_rows(df) -> int:
    """Rows that the scans of a finished query gave on (after row groups were skipped)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    rows = 0
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if "Adaptive" in leaf.getClass().getSimpleName() or "QueryStage" in leaf.getClass().getSimpleName():
            continue
        rows += leaf.metrics().apply("numOutputRows").value()
    return rows


def test_level_filters_reach_the_scan(spark):
    for name, bound in (("filter_level", "GreaterThanOrEqual(value,14.0)"),
                        ("peak_days_red", "GreaterThanOrEqual(value,14.0)"),
                        ("peak_days_yellow", "LessThan(value,11.2)")):
        assert bound in _plan(R.QUERIES[name](spark, SF01)), name


def test_sorted_files_skip_row_groups(spark, tmp_path):
    from pyspark.sql import functions as F

    from tremolo.functions.levels import at_level
    from tremolo.sources.readings import events_readings, write_readings
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    r = events_readings(spark, "/root/testdata/sf0.1")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    small = {"parquet.block.size": "4096", "parquet.page.size": "1024"}  # groups of about 100 rows
    for k, v in small.items():
        conf.set(k, v)
    write_readings(r, clustered)
    r.repartition(8, "reading_id").write.partitionBy("date").parquet(plain)
    for k in small:
        conf.unset(k)
    read = {}
    for path in (plain, clustered):
        stored = spark.read.parquet(path)
        for level, bound in (("ORANGE", "GreaterThanOrEqual(value,11.2)"), ("RED", "GreaterThanOrEqual(value,14.0)")):
            found = at_level(stored, level, ()).select("reading_id")
            assert bound in _plan(found)
            assert found.count() == r.where(F.col("level") == level).count()
            read[path, level] = _scanned_rows(found)
    assert read[clustered, "ORANGE"] < 0.6 * read[plain, "ORANGE"]
    odd = stored.withColumn("value", F.when(F.col("reading_id") % 2 == 0, F.col("value")))
    assert at_level(odd, "RED", ()).count() == at_level(odd, "RED").count()  # RED without a value was NaN
