"""Operators that shuffle, against brute force on small rows."""

import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tremolo.llm import chatformat, debruijn, forest, mixing, prefixfree

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def key(row):
    return tuple((x is None, x) for x in row)


def near_copies(n, size=200, seed=5):
    """A base text and n copies, each with a few words changed."""
    import random
    base, r, out = words(size, seed), random.Random(seed), []
    for i in range(n):
        w = list(base)
        for _ in range(r.randrange(1, 6)):
            w[r.randrange(size)] = f"edit{r.randrange(10 ** 6)}"
        out.append((100 + i, " ".join(w)))
    return [(99, " ".join(base)), *out]


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_words(make_docs, text_cases, monkeypatch, hot):
    rows = text_cases + near_copies(30)
    if hot:  # boilerplate in ever other words: its gram leads many different windows
        import random
        r = random.Random(3)
        rows += [(1000 + i, " ".join([*words(9, r.randrange(40)), "all rights reserved worldwide by",
                                      *words(9, 50 + r.randrange(40))])) for i in range(120)]
        monkeypatch.setattr(debruijn, "HOT_EDGES", 40)
        texts = make_docs(rows).where("text IS NOT NULL").select("doc_id", "text", F.lit(0).cast(
            "long").alias("check")).repartition(1)
        assert len(debruijn.hot_grams(texts)) > 0
    first = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for k in range(len(w) - 12) if i is not None else ():
            g = tuple(w[k:k + 13])
            first[g] = min(first.get(g, i), i)
    want = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = {j for k in range(len(w) - 12) if i is not None and first[tuple(w[k:k + 13])] < i
                for j in range(k, k + 13)}
        want.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    for parts in (1, 7):
        got = debruijn.remove_repeats(make_docs(rows).repartition(parts)).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got],
                      key=key) == sorted(want, key=key)
    assert debruijn.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("group", [256, 2])
def test_repeated_bytes(make_docs, text_cases, group):
    rows = [r for r in text_cases if r[0] != 8] + near_copies(20, 300) + [
        (40, "ab" * 300 + "c" + "ab" * 400), (41, "zz" + "ab" * 300 + "c"), (None, "q" * 900)]
    width, count = 400, Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[k:k + width] for k in range(len(b) - width + 1))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - width + 1):
            if count[b[k:k + width]] > 1:
                gone[k:k + width] = [True] * width
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        want.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    got = prefixfree.remove_repeated_bytes(make_docs(rows).repartition(3), group=group).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got],
                  key=key) == sorted(want, key=key)
    assert sum(w[2] for w in want) > 0
    assert prefixfree.remove_repeated_bytes(make_docs([])).count() == 0


@pytest.mark.parametrize("block", [512, 4])
def test_jaccard_links_and_classes(make_docs, text_cases, block):
    rows = text_cases + near_copies(25) + [(60, "p q r"), (61, "p q  r"), (62, "p q s")]
    sets = {}
    for _, t in rows:
        w = SPACED.findall(t or "")
        sets[t] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {t: {u for u in sets if u != t and sets[t] and sets[u] and 5 * len(sets[t] & sets[u])
                 >= 4 * len(sets[t] | sets[u])} for t in sets}
    got = forest.jaccard_join(make_docs(rows), block=block).collect()
    for r in got:
        assert r.n_links == len(links[r.text]), r.doc_id
        group, todo = {r.text}, [r.text]
        while todo:
            for u in links[todo.pop()] - group:
                group.add(u)
                todo.append(u)
        ids = [i for i, t in rows if t in group and i is not None]
        want = min(ids) if sets[r.text] else r.doc_id
        assert r.class_id == want
    kept = forest.one_of_each(make_docs(rows)).collect()
    ids = Counter(r.doc_id for r in kept)
    assert ids[9] == 1 and None not in ids and ids[1] == 1 and ids[2] == 0
    assert forest.jaccard_join(make_docs([])).count() == 0


def test_one_of_each_with_null_and_repeated_ids(make_docs):
    def edited(seed):  # one word of 200 changed: similar to each other by 0.9
        w = words(200, seed)
        return [" ".join([*w[:30 * k], f"edit{k}", *w[30 * k + 1:]]) for k in range(1, 6)]
    other = " ".join(words(100, 77))
    rows = [(None, t) for t in edited(5)] + [(None, edited(5)[0])]  # a class without ids
    rows += [(7, t) for t in edited(6)] + [(7, other), (7, other)]
    rows += [(None, ""), (8, None), (8, None)]
    kept = [(r.doc_id, r.text) for r in forest.one_of_each(make_docs(rows)).collect()]
    assert Counter(i for i, t in kept if t) == {None: 1, 7: 2}
    assert kept.count((7, other)) == 1 and len(kept) == 3 + 3


def test_matched_depth_is_the_longest_that_reaches_the_recall():
    k = forest.matched_depth()
    assert 1 - (1 - 0.8 ** k) ** forest.TREES >= forest.RECALL
    assert 1 - (1 - 0.8 ** (k + 1)) ** forest.TREES < forest.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (201, 202), (300, 300)]
    got = forest.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, 100: 0, 200: 200,
                                             201: 200, 202: 200}


def filled(sizes, weights, cap=3):
    """Water-filling with fractions."""
    target, free, rest = {}, set(sizes), Fraction(sum(sizes.values()))
    while free:
        total = sum(weights[s] for s in free)
        full = {s for s in free if cap * sizes[s] <= rest * weights[s] / total}
        if not full:
            target |= {s: rest * weights[s] / total for s in free}
            break
        for s in full:
            target[s] = Fraction(cap * sizes[s])
        rest -= sum(target[s] for s in full)
        free -= full
    return target


def test_mixing(make_docs):
    import random
    r = random.Random(3)
    plan = {"a": 300, "b": 40, "c": 1, "Z": 90, None: 50, "ä": 4, "empty": 0}
    rows, i = [], 0
    for source, n in plan.items():
        for _ in range(max(1, n)):
            i += 1
            rows.append((i, "w " * r.randrange(1, 200) if n else None, "en", source))
    rows.append(rows[0])
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert sorted(map(tuple, got), key=key) == sorted(
        map(tuple, mixing.mix(docs.repartition(5)).collect()), key=key)  # reruns agree
    sizes = {s: 0 for s in plan}
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted([s for s in plan if s is not None]) + [None]
    want = filled(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)})
    taken = Counter()
    for row in got:
        assert row.source_size == sizes[row.source] and 0 <= row.taken <= 3 * row["size"]
        assert row.target == pytest.approx(float(want[row.source]))
        taken[row.source] += row.taken
    assert len(got) == len(rows)
    for s in sizes:
        if sizes[s] > 1000:
            assert taken[s] == pytest.approx(float(want[s]), rel=0.02)
    assert mixing.mix(make_docs([])).count() == 0


def test_chat_snapshots(spark):
    def conv(i, n, start=0, last="x"):
        return [(i, start + k, ("user", "assistant")[k % 2], f"t{k}" if k < n - 1 else last)
                for k in range(n)]
    rows = conv(1, 3, last="t2") + conv(2, 5, last="t4") + conv(3, 5, last="t4") + conv(4, 2)
    rows += conv(5, 2000, last="t1999") + [(6, 0, "user", None)] + [(7, 0, "user", "")]
    rows += [(None, 0, None, "n"), (8, 0, "user", "t0"), (9, None, "user", "t0")]
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema)
    got = chatformat.format_chats(df).collect()
    assert {r.conv_id for r in got} == {4, 5, 6, 7, None}
    long = sorted([r for r in got if r.conv_id == 5], key=lambda r: r.block)
    assert len(long) == 2 and long[0].n_turns == 2000
    text = "".join(r.text for r in long)
    assert text == "".join(f"<|{('user', 'assistant')[k % 2]}|>\nt{k}\n<|end|>\n" for k in range(2000))
    short = chatformat.format_chats(df.where("conv_id IN (2, 3, 4)")).collect()
    assert {(r.conv_id, r.n_copies) for r in short} == {(2, 2), (4, 1)}
    assert chatformat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_chat_with_repeated_turn_numbers_is_spread(spark):
    rows = [(None, (0, 1, None)[k % 3], "user", f"t{k % 500}") for k in range(3000)]
    rows += [(1, 0, "user", f"same{k % 2}") for k in range(3000)] + [(2, 0, "user", "same0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranks = chatformat.ranked(df).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = Counter((r.conv_id, r.chunk) for r in ranks)
    assert max(sizes.values()) < 2000  # one conversation has 3000
    by_rank = {i: [r.text for r in sorted((r for r in ranks if r.conv_id == i),
                                          key=lambda r: r.n)] for i in (None, 1)}
    for i in (None, 1):
        assert sorted(r.n for r in ranks if r.conv_id == i) == list(range(1, 3001))
        assert by_rank[i] == [x[3] for x in sorted(
            (x for x in rows if x[0] == i), key=lambda x: (x[1] is not None, x[1] or 0, x[3]))]
    got = chatformat.format_chats(df).collect()
    assert {r.conv_id for r in got} == {None, 1}
    assert next(r for r in got if r.conv_id == 1).n_turns == 3000
    # blocks go by rank: none holds more than BLOCK turns
    assert sorted((r.block, r.text.count("<|end|>")) for r in got if r.conv_id is None) == [
        (0, 1024), (1, 1024), (2, 952)]


def test_clashing_columns(make_docs, spark):
    docs = make_docs([(1, "a b c"), (2, "a b c")])
    for c in ("n_words", "class_id", "n_links", "unit", "root", "check", "doc", "kept", "starts",
              "size", "taken", "score", "labels"):
        docs = docs.withColumn(c, F.lit("x"))
    assert forest.jaccard_join(docs).where("class_id = 1").count() == 2
    assert debruijn.remove_repeats(docs).where("n_words = 3").count() == 2
    assert prefixfree.remove_repeated_bytes(docs).where("n_bytes = 5").count() == 2
    assert mixing.mix(docs).where("size = 3").count() == 2
