"""The pipeline's stages, each against what its operator says of the stage's own input."""

import os

import corpus_pipeline
import __spark_entry__ as entry
from tests.conftest import SF001
from tremolo.llm import decontaminate, forest, quality

CONTRACTS = {
    "op1_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op3_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_licenses": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                     "labels", "score"],
    "op6_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept"],
    "op8_jaccard": ["doc_id", "class_id", "n_links"],
    "op9_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_periodic": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                      "collapsed_sha256"],
    "op12_linedups": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
}


def test_contract_columns(spark):
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    for name, columns in CONTRACTS.items():
        out = entry.queries()[name](spark, SF001)
        assert set(columns) <= set(out.columns), name
        assert out.count() == n, name


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans",
        "mixing sources to target weights"]
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    want = [
        lambda d: ids(quality.judge_quality(d, labels).where("kept")),
        lambda d: sorted({r.class_id for r in forest.jaccard_join(d).collect()}),
        lambda d: ids(decontaminate.contaminated(d, bench).where("NOT contaminated")),
        ids, ids]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = os.path.join(str(tmp_path), str(k))
        stage(spark, docs, SF001).write.parquet(out)
        docs = spark.read.parquet(out)
        assert ids(docs) == want[k](before), name
        if k < 4:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    assert ids(corpus_pipeline.run(spark, SF001)) == ids(docs)


def test_edges_of_the_pipeline(spark, make_docs, tmp_path):
    """Empty tables, tables without a good text, null and repeated ids, null sources and further columns."""
    good = [r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    cases = {
        "empty": [],
        "wordless": [(1, None), (None, None), (2, ""), (3, " \n")],
        "null_ids": [(None, t, None, None) for t in good[:5] * 3] + [(7, t) for t in good[5:9] * 2],
    }
    for name, rows in cases.items():
        folder = tmp_path / name
        docs = make_docs([]) if not rows else make_docs([r for r in rows if len(r) == 2]).unionByName(
            spark.createDataFrame([(*r, None) for r in rows if len(r) == 4], make_docs([]).schema))
        docs.selectExpr("*", "'x' AS kept", "1 AS size", "'y' AS _unit").write.parquet(str(folder / "documents.parquet"))
        for other in ("labels", "benchmark"):
            spark.read.parquet(f"{SF001}/{other}.parquet").write.parquet(str(folder / f"{other}.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        if name != "null_ids":
            assert got == []
        else:
            kept = quality.judge_quality(docs, spark.read.parquet(f"{SF001}/labels.parquet")).where("kept")
            assert 0 < len(got) <= kept.select("text").distinct().count()
            assert all(x.taken <= 3 * x.size for x in got)
