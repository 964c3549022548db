"""Whole jobs from files to files: question tables to answered ones, readings to a range report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolo.operators.anomaly import anomaly_daily, anomaly_points
from tremolo.operators.ranges import range_readings, range_requests
from tremolo.plans.answers import answer_questions
from tremolo.plans.routing import route_questions
from tremolo.sources.questions import COL_ANSWER, COL_GROUP, COL_QUESTION, read_question_csv, write_question_table
from tremolo.sources.readings import load_readings_csv, write_readings


def answer_file(spark: SparkSession, questions_csv: str, readings: DataFrame, machine_id: str, out: str,
                fmt: str = "csv", **routing) -> DataFrame:
    """SRC4, B1, SNK1: a question CSV to an answered table, one row per question in the order of the
    file. ``routing`` goes to ``route_questions``. Returns (row_no, group_no, question, status, answer, error)."""
    asked = read_question_csv(spark, questions_csv).select("row_no", "group_no", "question")
    routed = route_questions(asked, ["row_no", "group_no"], "question", **routing).withColumn(
        "machine_id", F.lit(machine_id))
    answered = answer_questions(routed, readings).select("row_no", "status", "answer", "error")
    done = asked.join(answered, "row_no").select("row_no", "group_no", "question", "status", "answer", "error")
    # sorted by range partitions, so files follow the order of the questions
    shown = done.orderBy("row_no").select(
        F.col("group_no").alias(COL_GROUP), F.col("question").alias(COL_QUESTION),
        F.coalesce("answer", F.concat(F.lit("ERROR: "), F.coalesce("error", "status"))).alias(COL_ANSWER))
    write_question_table(shown, out, fmt)
    return done


def land_readings(spark: SparkSession, csv: str, out: str, mode: str = "lenient",
                  machine_id: str = "M1") -> DataFrame:
    """SRC1 / SRC2: a readings CSV to the sorted, date-partitioned table of record; what is read back."""
    write_readings(load_readings_csv(spark, csv, mode, machine_id), out)
    return spark.read.parquet(out)


def range_report(readings: DataFrame, start: str, end: str, min_date: str, max_date: str) -> tuple[str, DataFrame | None]:
    """PF10, AN1-AN3: the request's status and, if it is ``ok``, readings and anomalies per day."""
    spark = readings.sparkSession
    request = spark.createDataFrame([(0, start, end)], "request_id long, start string, end string")
    status = range_requests(request, readings, min_date, max_date).first()["status"]
    if status != "ok":
        return status, None
    return status, anomaly_daily(anomaly_points(range_readings(readings, start, end)))
