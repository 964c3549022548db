"""Files cut into records by many tasks, and whole jobs from files to files."""
import csv
import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import make_readings
from tremolo.operators import chats as ch
from tremolo.plans import jobs
from tremolo.sources.questions import QUESTION_SCHEMA, read_question_csv
from tremolo.sources.readings import events_readings


@pytest.fixture()
def small_splits(spark):
    """Splits of 64 bytes: every file is read by many tasks."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.set(k, "64")
    yield
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def _question_rows():
    r = random.Random(2)
    answers = ["plain", "two\nlines", 'a "quoted" word', "", "comma, inside", '"', "\n\n", 'ends with "\n', "ğüşıöç\nİ",
               '""', "x" * 300 + "\n" + "y" * 300]
    return [(k // 5 + 1, f"soru {k}, \"{k}\"", r.choice(answers), r.choice(["evet", ""])) for k in range(120)]


@pytest.mark.parametrize("bom", ["", "﻿"])
def test_multi_line_csv_in_small_splits(spark, tmp_path, small_splits, bom):
    rows = _question_rows()
    path = tmp_path / "q.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(bom)
        w = csv.writer(f, lineterminator="\n")
        w.writerow(["Soru No", "Soru", "Cevap", "Doğru Cevap"])
        for k, row in enumerate(rows):
            w.writerow(row)
            if k % 10 == 0:
                f.write("\n")  # a blank line
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 50
    got = read_question_csv(spark, str(path)).orderBy("row_no").collect()
    assert [x.row_no for x in got] == list(range(len(rows)))
    plain = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
             .schema(QUESTION_SCHEMA).csv(str(path)).collect())
    assert [(x.group_no, x.question, x.answer or None, x.verdict_in) for x in got] == [
        (x[0], x[1], x[2] or None, x[3]) for x in plain]


def _sessions():
    r = random.Random(5)
    texts = ["merhaba", "brace } and { and [ ]", 'quote " and \\ backslash', "}\n{\"role\": \"x\"}, ]", "\\\\}", "ü🧑\t",
             "", "\"}, {\"", "a\\\"}b", "x" * 500]
    return {name: [{"role": r.choice(["user", "assistant"]), "content": r.choice(texts)} for _ in range(n)]
            for name, n in (("Sohbet 1", 30), ("boş", 0), ('ad "tırnaklı" \\ }', 7), ("role", 3), ("Sohbet 2", 1),
                            ("a [ b ] { c", 2), ("son", 0))}


@pytest.mark.parametrize("indent", [None, 2])
def test_one_large_json_document_in_small_splits(spark, tmp_path, small_splits, indent):
    path = tmp_path / "chat.json"
    path.write_text(json.dumps(_sessions(), ensure_ascii=indent is None, indent=indent), encoding="utf-8")
    got = ch.read_chat_json(spark, str(path)).collect()
    want = [(name, k, m["role"], m["content"]) for name, ms in _sessions().items() for k, m in enumerate(ms)]
    assert sorted((x.conv_id, x.turn, x.role, x.content) for x in got) == sorted(want)


def test_json_edges(spark, tmp_path):
    (tmp_path / "a.json").write_text("{}")
    (tmp_path / "b.json").write_text('{"s": []}')
    (tmp_path / "c.json").write_text('{"s": [{}, {"role": "user"}], "t": [{"turn": 9, "content": null}]}')
    (tmp_path / "d.json").write_text("")
    got = ch.read_chat_json(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("s", 0, None, None), ("s", 1, "user", None), ("t", 9, None, None)]


def test_chat_round_trip_with_null_ids(spark, tmp_path):
    turns = spark.createDataFrame([("7", 0, "user", "a }"), (None, 0, "user", "no id"), ("7", 1, "assistant", None)],
                                  "conv_id string, turn long, role string, content string")
    ch.write_chat_json(turns, str(tmp_path / "out"))
    back = ch.read_chat_json(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, turns.collect()), key=str)


TURNS = "conv_id long, turn long, role string, text string"


def test_pairs_of_null_ids_and_turns(spark):
    turns = spark.createDataFrame([
        (1, 0, "user", "a"), (1, 1, "assistant", "A"), (None, 0, "user", "b"), (None, 1, "assistant", "B"),
        (None, 2, "user", "c"), (2, None, "user", "d"), (2, 5, "assistant", "D"), (3, 4, "user", "e"),
        (3, 4, "assistant", "E")], TURNS)
    got = {(x.conv_id, x.turn, x.message): x.reply for x in ch.pairs(turns).collect()}
    assert got == {(1, 0, "a"): "A", (None, 0, "b"): "B", (None, 2, "c"): None, (2, None, "d"): "D",
                   (3, 4, "e"): "E"}
    left = [(x.conv_id, x.turn) for x in ch.undo_last_pair(turns).collect()]
    assert sorted(left, key=str) == sorted([(None, 0), (2, None)], key=str)
    one = spark.createDataFrame([(None,)], "conv_id long")
    assert ch.read_session(turns, one).count() == 3
    assert ch.clear_sessions(turns, one).count() == 6
    sessions, rest = ch.delete_sessions(ch.sessions_of(turns), turns, one)
    assert (sessions.count(), rest.count()) == (3, 6)


def test_answer_file(spark, tmp_path):
    readings = make_readings(spark, [
        (1, "2023-02-15 10:00:00", 1.0, None), (2, "2023-02-15 11:00:00", 20.0, None),
        (3, "2023-03-01 10:00:00", 5.0, None)])
    path = tmp_path / "q.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        w = csv.writer(f)
        w.writerow(["Soru No", "Soru", "Cevap", "Doğru Cevap"])
        w.writerow([1, "Tüm kırmızı günleri listele", "", ""])
        w.writerow([1, "15-02-2023 tarihinde RTF makinesinin değer aralığı neydi?", "", ""])
        w.writerow([2, "hava\nnasıl?", "", ""])
    done = jobs.answer_file(spark, str(path), readings, "M1", str(tmp_path / "out"))
    got = {x.row_no: (x.status, x.answer) for x in done.collect()}
    assert got[0] == ("matched", "2023-02-15")
    assert got[1] == ("matched", "1.00 - 20.00") and got[2][0] == "not_found"
    back = read_question_csv(spark, str(tmp_path / "out")).orderBy("row_no").collect()
    assert [x.answer for x in back] == ["2023-02-15", "1.00 - 20.00", "ERROR: not_found"]
    assert back[2].question == "hava\nnasıl?"


def test_land_and_report(spark, tmp_path):
    rows = "\n".join(f"2023-03-{1 + k // 60:02d} 10:{k % 60:02d}:00,{2.0 + (k % 7) / 10},Green" for k in range(300))
    (tmp_path / "r.csv").write_text("Timestamp,Value,Situation\n" + rows + "\n2023-03-03 12:00:30,95.0,Red\nbad,1,Green\n")
    stored = jobs.land_readings(spark, str(tmp_path / "r.csv"), str(tmp_path / "t"))
    assert stored.count() == 301
    status, report = jobs.range_report(stored, "2023-03-02", "2023-03-04", "2023-01-01", "2023-12-31")
    days = {x.date: (x.n, x.anomalies) for x in report.collect()}
    assert status == "ok" and days[dt.date(2023, 3, 3)] == (61, 1) and sum(n for n, _ in days.values()) == 181
    assert jobs.range_report(stored, "2023-03-05", "2023-03-02", "2023-01-01", "2023-12-31") == ("start_after_end", None)
    assert jobs.range_report(stored, "2023/03/05", "2023-03-02", "2023-01-01", "2023-12-31") == ("bad_format", None)


def test_null_machine_gets_its_answers(spark):
    from tremolo.plans import answers as ans
    rows = [(1, "2023-02-15 10:00:00", 1.0, None), (2, "2023-02-15 11:00:00", 20.0, None),
            (3, "2023-03-01 10:00:00", 5.0, None)]
    named = make_readings(spark, rows)
    both = named.unionByName(named.withColumn("machine_id", F.lit(None).cast("string")))
    got = {(x.machine_id, x.intent_id): x.answer for x in ans.catalogue_answers(both, 2023).collect()}
    assert all(got[None, i] == a for (m, i), a in got.items() if m == "M1")
    for fn in (ans.day_answers, ans.month_answers):
        rows = {(x.machine_id, x.key): x.answer for x in fn(both).collect()}
        assert {k[1]: v for k, v in rows.items() if k[0] is None} == {k[1]: v for k, v in rows.items() if k[0]}


def test_sequences_keep_the_null_machine(spark):
    r = events_readings(spark, "/root/testdata/sf0.001")
    from tremolo.operators import catalogue as cat
    from tremolo.operators import sequence as seq
    r = r.withColumn("machine_id", F.when(F.col("machine_id") != r.first().machine_id, F.col("machine_id")))
    machines = {x.machine_id for x in cat.value_summary(r).collect()}
    assert None in machines and {x.machine_id for x in seq.transition_count(r).collect()} == machines


def test_long_sessions_are_nested_in_pieces(spark):
    turns = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(2500)] + [(None, k % 2, "user", f"n{k}")
                                  for k in range(30)] + [(2, None, "assistant", "x")], TURNS)
    got = {(x.conv_id, x.piece): x for x in ch.nest_sessions(turns, "text", 1000).collect()}
    assert {k: len(x.messages) for k, x in got.items()} == {(1, 0): 1000, (1, 1): 1000, (1, 2): 500, (None, 0): 30,
                                                            (2, 0): 1}
    assert [m.content for m in got[1, 1].messages] == [f"t{k}" for k in range(1000, 2000)]
    back = ch.flatten_sessions(spark.createDataFrame([x.asDict() for x in got.values()],
                                                     "conv_id long, piece long, json string"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(
        ((None if c is None else str(c), 0 if t is None else t, r, x) for c, t, r, x in map(tuple, turns.collect())),
        key=str)


def test_long_sessions_are_nested_whole(spark):
    """A session of any number of turns is one row, in order; ids and turns may be missing or come twice."""
    rows = [(1, k, "user", f"t{k}") for k in range(2500)] + [(None, k % 2, "user", f"n{k:02}") for k in range(30)] + [
        (2, 0, "assistant", "x"), (2, 0, "assistant", "x")]
    got = {x.conv_id: x for x in ch.nest_sessions(spark.createDataFrame(rows, TURNS), "text").collect()}
    assert {k: [(m.turn, m.content) for m in x.messages] for k, x in got.items()} == {
        c: sorted((t, x) for i, t, _, x in rows if i == c) for c in (1, None, 2)}
    assert got[1].json.count('"role"') == 2500 and "piece" not in got[1]


def test_chat_nest_gives_a_row_per_session(spark, tmp_path):
    from tremolo.registry import QUERIES
    spark.createDataFrame([(7, k, "user", f"t{k}") for k in range(1500)] + [(8, 0, "assistant", "y")], TURNS).write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: (x.n_messages, x.messages) for x in QUERIES["chat_nest"](spark, str(tmp_path)).collect()}
    assert got == {"7": (1500, "\n".join(f"user: t{k}" for k in range(1500))), "8": (1, "assistant: y")}
