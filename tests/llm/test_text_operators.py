"""Operators that map over whole texts, against plain Python on small rows."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tremolo.llm import decontaminate, langid, licenses, quality, secrets
from tremolo.llm.tokens import minima, slices

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_benchmark_windows(spark, make_docs, text_cases, block_bytes):
    base = text_cases[0][1].split()
    items = [(1, " ".join(base[3:30]).upper()), (2, "Two"), (3, None), (4, ""),
             (5, " ".join(base[20:25])), (None, "one"), (5, "w")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    patterns = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[k:k + n]), set()).add(i)
    want = []
    for i, t in text_cases:
        w, hit, ids = ALNUM.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(p) for p in patterns}:
            for k in range(len(w) - n + 1):
                if found := patterns.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    ids |= {str(x) for x in found if x is not None}
        want.append((i, len(w), len(hit), tuple(sorted(ids))))
    got = decontaminate.find_benchmark_text(make_docs(text_cases), bench, block_bytes=block_bytes)
    got = got.withColumn("n_hit", decontaminate.n_hit()).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r.hit_items)) for r in got], key=key) == \
        sorted(want, key=key)
    assert any(w[2] for w in want)


def test_benchmark_empty(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.contaminated(make_docs([(1, "a b")]), none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in out] == [(2, 0, False)]
    assert decontaminate.contaminated(make_docs([]), none).count() == 0


SECRETS = [
    (1, 'é token = "abcdef1234" and PASSWORD:hunter22, secret:token:abcdefg api-key=zzzzzzzz'),
    (2, "AKIA" + "Q" * 16 + " AKIA" + "Q" * 15 + " xAKIAAKIA" + "0" * 20), (3, None), (4, ""),
    (5, "f" * 24 + " " + "g" + "0a" * 30 + "z " + "deadbeef" * 2),
    (6, "\U0001f600 api_key='" + "k" * 7 + "' apikey=   \"a=b/c+d\""),
    (6, "\U0001f600 api_key='" + "k" * 7 + "' apikey=   \"a=b/c+d\""),
    (7, " ".join("token=abcdefgh%d" % i for i in range(700))),
    (8, "the internationalization_of_documents and counterrevolutionaries are words"),
    (9, "x Zk3vQ9bT7mLp2RwXy8NfHs4D y"),
]


def base_spans(text):
    found = []
    assign = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                        r"([A-Za-z0-9+/_.=-]+)")
    for no, (pattern, ok) in enumerate([
            (assign, lambda m: len(m.group(2)) >= 6),
            (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
            (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24)]):
        found += [(m.start(), no, m.end()) for m in pattern.finditer(text) if ok(m)]
    return sorted(found)


def test_base_secrets(make_docs):
    found = secrets.scan_secrets(make_docs(SECRETS))
    got = found.select("doc_id", secrets.spelled(F.concat("assign", "access", "hex")).alias("s"),
                       F.size("assign").alias("n")).collect()
    want = [(i, ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t or "")))
            for i, t in SECRETS]
    assert sorted((r.doc_id, r.s) for r in got) == sorted(want)
    assert max(r.n for r in got) == 700


def test_markov_model(spark, make_docs):
    import base64
    plain = ["document", "internationalization", "user_name", "get_file_path", "responsibility",
             "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    coded = [base64.b64encode(hashlib.sha256(b"%d" % i).digest()).decode() for i in range(200)]
    samples = spark.createDataFrame([(t, False) for t in plain * 200] + [(t, True) for t in coded],
                                    "token string, is_random boolean")
    ratios = secrets.log_ratios(samples)
    pairs = {k: Counter() for k in (True, False)}
    for t, k in [(t, False) for t in plain * 200] + [(t, True) for t in coded]:
        pairs[k].update(zip(t, t[1:]))
    import math
    at = secrets.ALPHABET.index

    def p(k, a, b):
        row = sum(n for (x, _), n in pairs[k].items() if x == a)
        return math.log((pairs[k][a, b] + secrets.ALPHA) / (row + secrets.ALPHA * secrets.CLASSES))
    for a, b in [("o", "c"), ("e", "r"), ("_", "f")]:
        want = p(True, a, b) - p(False, a, b)
        assert ratios[(at(a) + 1) * secrets.CLASSES + at(b) + 1] == pytest.approx(want, abs=1e-4)
    rows = make_docs(SECRETS[8:])
    out = secrets.add_spans(rows, {"markov": secrets.TOKEN},
                            {"markov": secrets.looks_random(ratios)}).collect()
    assert {r.doc_id: len(r.markov) for r in out} == {8: 0, 9: 1}


def test_secrets_without_any_token(make_docs):
    assert secrets.scan_secrets(make_docs([])).count() == 0
    out = secrets.redact(secrets.scan_secrets(make_docs([(1, None), (2, ""), (3, "a token=abcdefg b")])))
    assert {r.doc_id: r.text for r in out.collect()} == {1: None, 2: "", 3: "a [secret] b"}


def test_licenses(make_docs, text_cases):
    rows = text_cases + [
        (20, "MIT License. Under the Apache-License! general PUBLIC\nlicense mit license"),
        (21, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception"),
        (22, "spdx-license-identifier: )("), (23, "summit license"), (24, "mit"),
    ]
    got = licenses.scan_licenses(make_docs(rows)).collect()
    for r in got:
        w = ALNUM.findall((r.text or "").translate(LOWER))
        want = sorted(i for p in licenses.BASE_PHRASES for i in range(len(w))
                      if w[i:i + len(p.split())] == p.split())
        assert (r.n_words, sorted(r.base_starts)) == (len(w), want)
    by = {r.doc_id: r for r in got}
    assert by[20].base_labels == ["apache", "gpl", "mit"] and len(by[20].base_starts) == 4
    assert by[21].expressions == ["mit gpl-2.0-only or apache-2.0 llvm-exception with and"]
    assert by[21].permissive is True and by[21].score == 1.0
    assert by[22].labels == ["spdx:invalid"] and by[23].base_labels == [] and by[3].score == 0


@pytest.mark.parametrize("line,holds,value", [
    ("mit and gpl-3.0", {"mit"}, False), ("mit or gpl-3.0", {"mit"}, True),
    ("a or b and c", {"a"}, True), ("(a or b) and c", {"a"}, False),
    ("a with x and b", {"a", "b"}, True), ("a */", {"a"}, True), ("a (", {"a"}, True)])
def test_licence_expressions(line, holds, value):
    assert licenses.evaluate(licenses.parse_expression(line), holds.__contains__) is value


def test_quality_base_counts(spark, make_docs, text_cases):
    rows = text_cases + [(30, "a b\nc # d\na b\n\n \na b\r\na b"), (31, "é|<>é " * 12)]
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (99, 1, 0), (None, 1, 0), (4, None, 0)],
                                   "doc_id long, quality int, toxic int")
    for r in quality.judge_quality(make_docs(rows), labels).collect():
        text = r.text or ""
        w, seen, lines = SPACED.findall(text), set(), 0
        for line in text.split("\n"):
            if SPACED.search(line):
                lines += line in seen
                seen.add(line)
        count = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        twice = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1
                 for j in range(i, i + 5)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, len(twice))
        failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
        assert r.base_failed is failed and not (failed and r.kept)


def test_quality_tells_junk_apart(spark, make_docs):
    from tests.llm.conftest import words
    good = [(i, " ".join(words(80, i, 20))) for i in range(60)]
    junk = [(100 + i, " ".join(w + "###" for w in words(80, i, 20))) for i in range(20)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge_quality(make_docs(good + junk), labels).collect()}
    assert all(out[i].kept for i, _ in good) and not any(out[i].kept for i, _ in junk)
    none = quality.judge_quality(make_docs(good), labels.where("false")).collect()
    assert {r.score for r in none} == {0.0}
    assert quality.judge_quality(make_docs([]), labels).count() == 0


def test_language(spark, make_docs):
    en = "the quick brown fox jumps over the lazy dog and then the other dogs bark at it "
    de = "der schnelle braune fuchs springt über den faulen hund und dann bellen die anderen "
    rows = [(i, (en, de)[i % 2] * (1 + i % 3), ("en", "de")[i % 2]) for i in range(40)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "123 !!", "en"), (53, en, None),
             (None, de, "de"), (54, en * 3000, "en")]
    out = langid.identify(make_docs(rows)).collect()
    import zlib
    for r in out:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out is held and 0 <= r.score <= 1
        want = "und" if not r.text or not any(c.isalpha() for c in r.text) else \
            "en" if "fox" in r.text else "de"
        assert r.lang_pred == want
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "abc", None)])).collect()} == {"und"}
    assert langid.identify(make_docs([])).count() == 0


def test_profiles_match_plain_counting(spark, make_docs):
    import pyarrow as pa
    texts = ["Ab cab ab", "", "é éa 1b", "zz", None, "a"]
    s = next(slices(pa.array(texts)))
    row, gram, n = langid.grams(s)
    for i, t in enumerate(texts):
        count = Counter()
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            padded = f" {w} "
            for k in langid.LENGTHS:
                count.update(padded[j:j + k] for j in range(len(padded) - k + 1))
        count.pop(" ", None)
        assert sorted(n[row == i].tolist()) == sorted(count.values())


def test_minima():
    import numpy as np
    v = np.random.default_rng(1).integers(0, 50, 100).astype(np.uint64)
    for w in (1, 2, 7, 100, 101):
        assert minima(v, w).tolist() == [min(v[i:i + w]) for i in range(len(v) - w + 1)]


def test_license_scan_is_linear_in_long_texts(spark, make_docs):
    import time
    many = 40_000
    text = "a mit license b " * many + "\n" + "x spdx-license-identifier: mit and apache-2.0 )" * many
    begun = time.time()
    row = licenses.scan_licenses(make_docs([(1, text)])).first()
    assert time.time() - begun < 60
    assert row.n_words >= 4 * many and row.base_starts == [4 * i + 1 for i in range(many)]
    assert row.labels == ["mit", "spdx:apache-2.0", "spdx:mit"] and len(row.expressions) == many
    assert licenses.parse_expression("mit" + " and mit" * 50_000)[-1] == ("op", "and")
