"""Operators 11 to 13 against brute force, with nulls, repeats, hot keys and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tremolo.llm import divergence, linedups, periodic
from tremolo.llm.queries import QUERIES


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _runs(words):
    """Every run (start, length, period), by the definition."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            part = words[i:i + size]
            if size >= max(6, 4 * q) and not any(
                    part[p:] == part[:-p] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _collapsed(doc_id, text):
    words = _words(text)
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    runs = _runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3),
            1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def _periodic_text(r):
    words = [f"w{r.randrange(r.choice([2, 40]))}" for _ in range(r.randrange(40))]
    for _ in range(r.randrange(4)):
        unit = [f"w{r.randrange(r.choice([1, 2, 30]))}" for _ in range(r.randrange(1, 20))]
        k = r.randrange(len(words) + 1)
        words[k:k] = [unit[i % len(unit)] for i in range(r.randrange(1, 8 * len(unit)))]
    return r.choice([" ", "\n", "\t "]).join(words)


def test_runs_equal_the_definition():
    """Runs of small alphabets, nested and touching, many documents in one call."""
    r = random.Random(4)
    for _ in range(150):
        docs = [_periodic_text(r).split() for _ in range(r.randrange(1, 6))]
        number = {w: k for k, w in enumerate(sorted({w for d in docs for w in d}))}
        words = np.array([number[w] for d in docs for w in d], np.uint64)
        first = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype(np.int64)
        want = [(int(first[k]) + s, n, q) for k, d in enumerate(docs) for s, n, q in _runs(d)]
        assert [tuple(x) for x in periodic.find_runs(words, first).tolist()] == want


def test_structured_words():
    """Fibonacci and Thue-Morse words have many small and no long repetitions."""
    a, b = [1], [0]
    while len(a) < 3000:
        a, b = a + b, a
    morse = [bin(i).count("1") % 2 for i in range(4096)]
    for word in (a, morse, [0] * 500 + morse[:600] * 5, (a[:233] * 5 + [2]) * 4):
        got = periodic.find_runs(np.array(word, np.uint64), np.array([0, len(word)]))
        assert [tuple(x) for x in got.tolist()] == _runs_fast(word)


def _runs_fast(word):
    """The definition with arrays, for a few thousand words."""
    w, out = np.array(word), []
    for q in range(1, len(w) // 4 + 1):
        same = np.concatenate(([0], (w[q:] == w[:-q]).astype(int), [0]))
        for i, j in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1),
                        strict=True):
            size = int(j - i + q)
            part = w[i:i + size]
            if size >= max(6, 4 * q) and not any(
                    (part[p:] == part[:-p]).all() for p in range(1, q)):
                out.append((int(i), size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_periodic_query(spark, make_docs, text_cases, tmp_path):
    r = random.Random(9)
    rows = text_cases + [(100 + k, _periodic_text(r)) for k in range(120)]
    rows += [(100, rows[-1][1]), (None, "a b " * 30), (None, None)]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    columns = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
               "collapsed_sha256")
    got = [tuple(x[c] for c in columns) for x in QUERIES["op11_periodic"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([_collapsed(*x) for x in rows if x[0] != 8]
                                          + [x for x in got if x[0] == 8], key=str)
    assert any(zlib.crc32(str(x[0]).encode()) % 10 == 0 and x[1] for x in got if x[0])


def test_periodic_clashes_and_empty(spark, make_docs):
    docs = make_docs([(1, "a b c d " * 9)])
    clash = docs.selectExpr("*", "'x' AS runs", "'y' AS collapsed", "1.5 AS start", "'z' AS _id")
    got = periodic.collapse_runs(clash).collect()
    assert got[0].collapsed == "a b c d" and got[0].runs[0].period == 4 and got[0]["_id"] == "z"
    assert periodic.collapse_runs(docs.where("false")).collect() == []


def _lines(rows, least_chars=20, least_docs=3):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(lower)
    held = defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        for x in {key(x) for x in (text or "").split("\n")}:
            held[x].append((doc_id is not None, doc_id or 0, k))
    out = []
    for doc_id, text in rows:
        kept, lines = [], (text or "").split("\n")
        for line in lines:
            of = held[key(line)]
            gone = len(key(line)) >= least_chars and len(of) >= least_docs and \
                (doc_id is not None, doc_id or 0) != max(x[:2] for x in of)
            kept += [] if gone else [line]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def _line_rows():
    r = random.Random(3)
    pool = [f"A line of Boilerplate number {k} Ümlaut" for k in range(40)] + ["short one", "", "  "] + \
        ["é" * 19, "é" * 20, "x" * 20, "x" * 19]
    rows = []
    for k in range(90):
        lines = [r.choice(pool) for _ in range(r.randrange(8))]
        lines = [r.choice(["", " ", "\t\x0b"]) + (x.upper() if r.random() < .2 else x) + r.choice(["", "\r", "\x0c "])
                 for x in lines] + [f"a line that only document {k} has"]
        rows.append((k, "\n".join(lines)))
    return rows + [(5, rows[7][1]), (5, rows[7][1]), (None, rows[8][1]), (None, None), (91, ""), (92, "\n\n"),
                   (None, "held by rows without an id only\nx"), (None, "held by rows without an id only"),
                   (None, " HELD by rows without an id only ")]


@pytest.mark.parametrize("shard_keys, hot_share", [(1 << 17, 1 / (1 << 16)), (4, 0.9), (3, 0.05)])
def test_line_dedup(make_docs, shard_keys, hot_share):
    rows = _line_rows()
    got = linedups.drop_lines(make_docs(rows).repartition(5), shard_keys=shard_keys,
                              hot_share=hot_share)
    got = [(x.doc_id, x.n_lines, x.n_dropped, x.kept_text) for x in got.collect()]
    assert sorted(got, key=str) == sorted(_lines(rows), key=str)


def test_line_dedup_edges(spark, make_docs):
    line = "the same line in all of the documents"
    rows = [(k, line if k % 2 else f"{line}\n{line}\nrest") for k in range(3000)]
    got = linedups.drop_lines(make_docs(rows)).where("n_dropped > 0").count()
    assert got == 2999
    docs = make_docs([(1, line), (2, line), (3, None)])
    clash = docs.selectExpr("*", "'x' AS hits", "'y' AS kept_text", "1 AS row_id", "'z' AS hash", "2 AS docs")
    got = {x.doc_id: (x.n_dropped, x.kept_text, x.row_id, x["hash"]) for x in linedups.drop_lines(
        clash, least_docs=2).collect()}
    assert got == {1: (1, "", 1, "z"), 2: (0, line, 1, "z"), 3: (0, "", 1, "z")}
    assert linedups.drop_lines(docs.where("false")).collect() == []


def test_minimal_perfect_hash():
    g = np.random.default_rng(1)
    hashes, prints = g.integers(0, 1 << 63, (2, 50_000)).astype(np.uint64)
    hashes[:10] = hashes[0]  # keys that differ in their fingerprint only
    counts, largest = g.integers(3, 300, 50_000), np.arange(50_000)
    made = linedups.Shard.build(hashes, prints, counts, largest)
    made = linedups.Shard.of_row(*made.row(7)[1:])
    number = made.find(hashes, prints)
    assert sorted(number.tolist()) == list(range(50_000))
    assert made.counts.dtype == np.uint16 and (made.counts[number] == counts).all()
    assert (made.largest[number] == largest).all()
    assert (made.find(hashes, prints + np.uint64(1)) < 0).all()
    assert made.bits.size < 10 * 50_000
    assert linedups.Shard.build(*[x[:0] for x in (hashes, prints, counts, largest)]).find(
        hashes[:3], prints[:3]).tolist() == [-1, -1, -1]


def _audit(rows, least, top=50):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs, used, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, w = lang or "", source or "", words(text)
        docs[lang].update(set(w))
        used[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: used[lang, s][t] for t in kept})

        def price(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        all_p = price(whole)
        ps = {s: price(used[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(ps[s][t] - all_p[t], t) for t in kept if used[lang, s][t] and ps[s][t] > all_p[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (value, item) in enumerate(items, 1):
                    if part == "pair" or k <= top:
                        out.append((lang, s, part, item, value, k))
    return sorted(out)


def _audit_rows():
    r = random.Random(8)
    vocab = [f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["über", "abé"]
    rows = []
    for k in range(400):
        lang = r.choice(["en", "en", "de", None])
        text = " ".join(r.choice(vocab[:r.choice([20, 302])]).upper() if r.random() < .3 else
                        r.choice(vocab) for _ in range(r.randrange(60)))
        rows.append((text.replace(" ", r.choice([" ", "-9_"])), lang, r.choice(["s1", "s2", "s3", "é", None, ""])))
    return rows + [(None, "en", "quiet"), ("", "xx", "one"), ("1 2 3", "xx", "two"), (None, "zz", None)]


@pytest.mark.parametrize("panel", [2048, 8, 1])
def test_joint_tables_in_panels(monkeypatch, panel):
    """Sums of a block are the same however its columns are cut, within a tile and between two."""
    monkeypatch.setattr(divergence, "PANEL", panel)
    g = np.random.default_rng(2)
    counts = g.integers(0, 4, (50, 6))
    rows, groups = np.nonzero(counts)
    totals = counts.sum(axis=0) * 3
    prices = 1 + 10 ** 9 * (counts + 5) // (totals + 5 * 70)
    left = np.array([True, True, True, True, False, False])
    for right in (left, ~left):
        got = list(divergence.joint_values(rows, groups, counts[rows, groups], totals, 50, 70, left, right))
        pairs = [(a, b) for a in range(4) for b in range(6) if right[b] and (a < b)]
        assert sorted(got) == [(a, b, int(abs(prices[:, a] - prices[:, b]).sum())) for a, b in pairs]


@pytest.mark.parametrize("block, tile", [(1024, 32), (40, 2), (7, 1)])
def test_audit(spark, block, tile):
    rows = _audit_rows()
    docs = spark.createDataFrame([(k % 7, *x, "other", 5) for k, x in enumerate(rows)],
                                 "doc_id long, text string, lang string, source string, term string, n long")
    got = divergence.audit_sources(docs, least_docs=10, block=block, tile=tile, top=12)
    assert sorted(map(tuple, got.collect())) == _audit(rows, 10, 12)


def test_audit_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit_sources(docs).collect() == []
    docs = spark.createDataFrame([(None, None, None)], docs.schema)
    assert divergence.audit_sources(docs).collect() == []


def test_prices_of_large_counts():
    levels = np.array([0, 7, 10 ** 13, (1 << 62)])
    for part in (levels[:2], levels):
        got = divergence._prices(part, 1 << 62, 10 ** 9)
        assert got.tolist() == [1 + 10 ** 9 * (int(c) + 5) // ((1 << 62) + 5 * 10 ** 9) for c in part]
