import csv
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from tremolo.operators import chats as ch
from tremolo.operators import consistency as cons
from tremolo.operators import incidents as inc
from tremolo.sources.questions import read_question_csv, write_question_table
from tremolo.sources.static import explanations_df, incidents_df

def _recorded():
    """An answered question table of our own: (group, question, answer) in file order; groups of uneven
    size, answers with line breaks, quotes and none at all."""
    answers = [["a", "a", "b", None, "a"], [None, None, "x", None], ['line\nbreak', 'line\nbreak', "line\n"],
               ["q\"q", "q\"q"], ["same"] * 9, ["1", "2", "3", "1", "1", None], [None] * 4]
    return [(g + 1, f"soru {g}.{k}", a) for g, group in enumerate(answers) for k, a in enumerate(group)]


@pytest.fixture()
def recorded_csv(tmp_path):
    path = tmp_path / "recorded.csv"
    with open(path, "w", encoding="utf-8", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(["Soru No", "Soru", "Cevap", "Doğru Cevap"])
        w.writerows((g, q, a or "", "") for g, q, a in _recorded())
    return str(path)


def test_question_csv_multiline(spark, recorded_csv):
    q = read_question_csv(spark, recorded_csv)
    assert [(r.group_no, r.question, r.answer) for r in q.orderBy("row_no").collect()] == _recorded()
    assert q.agg(F.min("row_no"), F.max("row_no")).first() == (0, len(_recorded()) - 1)


def _verdicts(leader_of):
    """Each row against the first row of its group: NULL for the first, else whether the answers agree."""
    seen, out = {}, {}
    for i, (group, _, answer) in enumerate(_recorded()):
        key = leader_of(i, group)
        if key not in seen:
            seen[key] = answer
            out[i] = None
        else:
            out[i] = "evet" if answer is not None and answer == seen[key] else "hayır"
    return out


def test_block_check_on_recorded_answers(spark, recorded_csv):
    """Blocks of five rows; the share of each verdict as well."""
    c = cons.answer_consistency(read_question_csv(spark, recorded_csv), "answer", "row_no", by="block")
    want = _verdicts(lambda i, group: i // 5)
    assert {r.row_no: r.verdict for r in c.collect()} == want
    got = {r.verdict: r.n for r in cons.answer_agreement(c).collect()}
    assert got == {v: list(want.values()).count(v) for v in set(want.values())}


def test_dense_row_number_matches_window(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet").select("o_orderkey")
    # keys with gaps, numbered with small ranges so that many ranges are used
    gappy = o.where(F.col("o_orderkey") % 3 != 1)
    got = cons.dense_row_number(gappy, "o_orderkey", partitions=7)
    rows = got.orderBy("o_orderkey").collect()
    assert [r.row_no for r in rows] == list(range(len(rows)))


def test_incident_shares_from_literal_table(spark):
    out = {r.root_cause: r for r in
           inc.root_cause_share(incidents_df(spark), explanations_df(spark)).collect()}
    assert {k: v.rows for k, v in out.items()} == {
        "Bearing fault": 7, "Process based alert": 3, "Balance fault": 3}
    assert {k: v.incidents for k, v in out.items()} == {
        "Bearing fault": 202, "Process based alert": 3, "Balance fault": 20}
    assert round(out["Bearing fault"].row_share * 100, 1) == 53.8
    assert round(out["Balance fault"].row_share * 100, 1) == 23.1
    assert all(v.explanation for v in out.values())
    daily = inc.daily_incidents(incidents_df(spark))
    assert daily.agg(F.sum("incidents")).first()[0] == 225


def test_chat_json_of_our_own(spark, tmp_path):
    src = tmp_path / "in.json"
    src.write_text(json.dumps({
        "Oda 1": [{"role": "user", "content": "2024-01-02 03:04:05\n🧑 ilk satır\nikinci"},
                  {"role": "assistant", "content": "2024-01-02 03:04:06\n🤖 yanıt"}],
        "Oda 2": [], "Oda 3": [{"role": "user", "content": "zamansız"}]}, ensure_ascii=False,
        indent=1), encoding="utf-8")
    t = ch.read_chat_json(spark, str(src))
    got = [(r.conv_id, r.turn, r.role, str(r.said_at), r.icon, r.text)
           for r in ch.parse_content(t).orderBy("conv_id", "turn").collect()]
    assert got == [
        ("Oda 1", 0, "user", "2024-01-02 03:04:05", "🧑", "ilk satır\nikinci"),
        ("Oda 1", 1, "assistant", "2024-01-02 03:04:06", "🤖", "yanıt"),
        ("Oda 3", 0, "user", "None", None, "zamansız")]
    built = ch.parse_content(t).where("said_at IS NOT NULL").select(
        "content", ch.build_content(F.col("said_at"), F.col("role"), F.col("text")).alias("again"))
    assert built.count() == 2 and built.where("content <> again").count() == 0
    out = str(tmp_path / "out")
    ch.write_chat_json(t, out)
    lines = [ln for f in glob.glob(out + "/*.txt") for ln in open(f, encoding="utf-8")]
    assert len(lines) == 3  # a line per turn
    assert sorted(ch.read_chat_json(spark, out).collect()) == sorted(t.collect())


def test_question_table_of_our_own(spark, tmp_path):
    src = tmp_path / "q.csv"
    src.write_text('Soru No,Soru,Cevap\n1,"ilk, soru",evet\n1,"iki\nsatırlı ""soru""",evet\n'
                   '2,son,\n', encoding="utf-8")
    q = read_question_csv(spark, str(src))
    rows = [(r.row_no, r.group_no, r.question, r.answer) for r in q.orderBy("row_no").collect()]
    assert rows == [(0, 1, "ilk, soru", "evet"), (1, 1, 'iki\nsatırlı "soru"', "evet"),
                    (2, 2, "son", None)]
    out = str(tmp_path / "table")
    write_question_table(q, out)
    back = [f for f in glob.glob(out + "/**/*", recursive=True) if os.path.isfile(f)]
    assert back
    verdict = {r.row_no: r.verdict for r in cons.answer_consistency(
        q, "answer", "row_no", by="question", group_col="group_no").collect()}
    assert verdict == {0: None, 1: "evet", 2: None}


def test_chat_batch_changes(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "a"), (1, 1, "assistant", "A"), (1, 2, "user", "b"),
         (2, 0, "user", "c"), (2, 1, "assistant", "C"), (3, 0, "user", "d")],
        "conv_id long, turn long, role string, text string")
    p = {(r.conv_id, r.turn): r.reply for r in ch.pairs(turns).collect()}
    assert p == {(1, 0): "A", (1, 2): None, (2, 0): "C", (3, 0): None}
    u = sorted((r.conv_id, r.turn) for r in ch.undo_last_pair(turns).collect())
    assert u == [(1, 0)]
    req = spark.createDataFrame([(1, 0, "x", "X"), (1, 1, "y", None), (9, 0, None, "Z")],
                                "conv_id long, req_no int, message string, reply string")
    app = {(r.conv_id, r.turn): (r.role, r.text) for r in ch.append_messages(turns, req).collect()}
    assert app[(1, 3)] == ("user", "x") and app[(1, 5)] == ("user", "y")
    assert app[(1, 4)] == ("assistant", "X") and app[(1, 6)] == ("assistant", None)
    assert app[(9, 0)] == ("user", None) and app[(9, 1)] == ("assistant", "Z")
    # rename 1 -> 2 overwrites 2; rename 3 -> 1 takes the freed name
    ren = spark.createDataFrame([(1, 2), (3, 1)], "old_id long, new_id long")
    got = sorted((r.conv_id, r.turn, r.text) for r in ch.rename_sessions(turns, ren).collect())
    assert got == [(1, 0, "d"), (2, 0, "a"), (2, 1, "A"), (2, 2, "b")]
    sessions = ch.sessions_of(turns)
    s2, t2 = ch.delete_sessions(sessions, turns, spark.createDataFrame([(3,)], "conv_id long"))
    assert ch.new_session_id(s2).first().conv_id == 3
    assert sorted(r.conv_id for r in ch.clear_sessions(turns, s2).collect()) == [3]


def test_question_mode_matches_brute_force(spark, recorded_csv):
    got = {r.row_no: r.verdict for r in cons.answer_consistency(
        read_question_csv(spark, recorded_csv), "answer", "row_no", by="question",
        group_col="group_no").collect()}
    assert got == _verdicts(lambda i, group: group)
