"""Rows that share an id, tables without a word, clashing columns, long lists of spans and tags."""

import time

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tremolo.llm import (
    chatformat,
    debruijn,
    decontaminate,
    forest,
    langid,
    licenses,
    mixing,
    prefixfree,
    quality,
    secrets,
)


def test_texts_that_share_an_id_keep_what_is_not_repeated(make_docs):
    """300 different texts under one id: only the one that another document has loses words."""
    shared = [(7, " ".join(words(80, 100 + k, vocab=1 << 40))) for k in range(300)]
    rows = [(3, shared[5][1]), *shared]
    got = debruijn.remove_repeats(make_docs(rows)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in got) == sorted(
        [(3, 80, 0), (7, 80, 80)] + [(7, 80, 0)] * 299)
    assert {x.kept_text for x in got if x.doc_id == 7} == {t for _, t in shared if t != rows[0][1]} | {""}
    got = prefixfree.remove_repeated_bytes(make_docs(rows)).collect()
    assert sorted((x.doc_id, x.n_removed > 0) for x in got) == sorted(
        [(3, True), (7, True)] + [(7, False)] * 299)


def test_repeated_rows_and_text_ids(spark, make_docs):
    text = " ".join(words(100, 5, vocab=1 << 40))
    other = " ".join(words(100, 6, vocab=1 << 40))
    docs = make_docs([(4, text), (4, text), (4, other), (9, text), (None, text), (2, other)])
    got = debruijn.remove_repeats(docs).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(4, 0), (4, 0), (4, 100), (9, 100), (None, 0), (2, 0)], key=str)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    got = prefixfree.remove_repeated_bytes(named).select("doc_id", F.col("n_removed") == F.col("n_bytes")).collect()
    assert len(got) == 6 and all(x[1] for x in got)


def test_mix_without_a_word_and_with_shared_ids(spark, make_docs):
    empty = make_docs([(1, None), (2, ""), (3, " \n")])
    got = mixing.mix(empty).collect()
    assert sorted((x.doc_id, x.size, x.source_size, x.target, x.taken) for x in got) == [
        (k, 0, 0, 0.0, 0) for k in (1, 2, 3)]
    rows = [(None if k % 3 else k, " ".join(words(k % 40, k)), "en", f"s{k % 2}") for k in range(3000)]
    docs = make_docs(rows)
    sized = mixing.sizes(docs)
    where = mixing.ordered.ranged(sized, "source", ("key", "size", "text_hash", "row"), 24).groupBy(
        F.spark_partition_id()).count().collect()
    assert max(x["count"] for x in where) < 3 * 3000 / 24  # two thirds of the rows have no id
    got = mixing.mix(docs)
    total = got.groupBy("source_size", "target").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).collect()
    assert all(x.s == x.source_size and abs(x.t - x.target) < 0.02 * x.target + 200 for x in total)
    assert got.where("taken > 3 * size").count() == 0
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, mixing.mix(
        docs.repartition(3)).collect()), key=key)


def test_expressions_end_at_the_next_tag():
    """Linear in texts of tags whose expressions never end."""
    took = []
    for n in (1000, 8000):
        text = "spdx-license-identifier:x or " * n
        began = time.monotonic()
        s = next(licenses_slices(text))
        got = licenses._scan(s, licenses._automata())
        took.append(time.monotonic() - began)
        assert got["expressions"][0] == ["x"] * n
    assert took[1] < 30 * max(took[0], 0.02)
    s = next(licenses_slices("the spdx list, without a tag"))
    assert licenses._scan(s, licenses._automata())["expressions"] == [[]]


def licenses_slices(text):
    import pyarrow as pa

    from tremolo.llm.tokens import slices
    return slices(pa.array([text]))


def test_redact_many_and_overlapping_secrets(make_docs):
    line = "token=abcdef{0:04d} plain AKIA{0:020d} "
    text = "start " + "".join(line.format(k) for k in range(2000)) + "end"
    got = secrets.redact(secrets.scan_secrets(make_docs([(1, text), (2, "password=0123456789abcdef0123456789 x"),
                                                         (3, "nothing"), (4, "token=abcdefgh")]))).collect()
    out = {x.doc_id: x.text for x in got}
    assert out[1].startswith("start [secret] plain [secret] ") and out[1].endswith("plain [secret] end")
    assert out[1].count("[secret]") == 4000 and "abcdef0" not in out[1]
    assert (out[2], out[3], out[4]) == ("[secret] x", "nothing", "[secret]")


OPERATORS = {
    "decontaminate": lambda d, b, n: decontaminate.contaminated(d, b),
    "secrets": lambda d, b, n: secrets.scan_secrets(d),
    "debruijn": lambda d, b, n: debruijn.remove_repeats(d),
    "licenses": lambda d, b, n: licenses.scan_licenses(d),
    "mixing": lambda d, b, n: mixing.mix(d),
    "quality": lambda d, b, n: quality.judge_quality(d, n),
    "forest": lambda d, b, n: forest.jaccard_join(d),
    "one_of_each": lambda d, b, n: forest.one_of_each(d),
    "prefixfree": lambda d, b, n: prefixfree.remove_repeated_bytes(d),
    "langid": lambda d, b, n: langid.identify(d),
}
CLASHES = ("_unit", "_links", "_key", "_copies", "_first", "_class", "_m_assign", "starts", "counts", "check",
           "doc", "place", "hits", "bucket", "n_words", "class_id", "kept", "size", "row", "spans", "start",
           "target", "key", "label", "root", "keys", "unit", "score", "labels", "_id", "_hash", "_spans")


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_and_no_words(spark, make_docs, name):
    """Results do not depend on further columns; tables of null and empty texts work."""
    run = OPERATORS[name]
    bench = spark.createDataFrame([(1, " ".join(words(40, 1)))], "item_id long, text string")
    judged = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = make_docs([(k, " ".join(words(60, k % 3)) + f" token=abcdef{k}") for k in range(6)])
    plain = run(docs, bench, judged)
    clash = run(docs.select("*", *[F.lit(f"old {c}").alias(c) for c in CLASHES]), bench, judged)
    columns = [c for c in plain.columns if c not in ("text",)]
    as_text = lambda df: sorted(str([r[c] for c in columns]) for r in df.collect())
    assert as_text(clash) == as_text(plain)
    for rows in ([], [(1, None), (None, None), (2, ""), (2, " \n")]):
        assert run(make_docs(rows), bench, judged).count() in (len(rows), 3)


def test_chat_clashes(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")],
                                  "conv_id long, turn long, role string, text string")
    plain = chatformat.format_chats(turns).collect()
    clash = turns.select("*", *[F.lit("old").alias(c) for c in ("n", "block", "upto", "n_turns", "chunk", "hash")])
    assert sorted(map(str, chatformat.format_chats(clash).collect())) == sorted(map(str, plain))


def _removed_bytes(texts, width=400):
    """Bytes of each text inside a string that starts anywhere else too."""
    starts = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            starts[t[i:i + width]] = starts.get(t[i:i + width], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        last = -1
        for i in range(len(t) - width + 1):
            if starts[t[i:i + width]] > 1:
                for j in range(max(i, last), i + width):
                    gone[j] = True
                last = i + width
        out.append(sum(gone))
    return out


@pytest.mark.parametrize("hot", [20, 1 << 17])
def test_hot_triggers_are_split(make_docs, monkeypatch, hot):
    """Boilerplate in 300 different contexts, of which some share more than 400 bytes, and whole copies."""
    import random
    r = random.Random(6)
    noise = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    boiler, passage = noise(230), noise(470)
    texts = [noise(r.randrange(300, 500)) + (passage if k % 7 == 0 else boiler) + noise(r.randrange(300, 500))
             for k in range(300)]
    texts += [texts[3], texts[4][100:], "x" + texts[5], boiler + noise(500), boiler]
    monkeypatch.setattr(prefixfree, "HOT_PHRASES", hot)
    docs = make_docs(list(enumerate(texts))).coalesce(2)
    found = prefixfree.hot_triggers(docs)
    assert (len(found) > 0) == (hot == 20)
    got = {x.doc_id: x.n_removed for x in prefixfree.remove_repeated_bytes(docs).collect()}
    assert [got[k] for k in range(len(texts))] == _removed_bytes(texts)
