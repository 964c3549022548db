"""The LSH forest: nodes connect what brute force connects, templates stay apart, recall on planted pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import words
from tremolo.llm import forest


def _parts(near):
    """Component numbers by flooding."""
    comp = np.arange(len(near))
    while True:
        low = np.minimum(comp, np.where(near, comp[None, :], len(near)).min(axis=1, initial=len(near)))
        low = low[low]
        if (low == comp).all():
            return comp
        comp = low


def test_connect_equals_all_pairs():
    g = np.random.default_rng(3)
    for n in (1, 2, 40, 200):
        for spread in (0, 15, 40):
            centre = g.integers(0, 256, (5, forest.SKETCH), dtype=np.uint8)
            sketch = centre[g.integers(0, 5, n)].copy()
            for row in sketch:
                at = g.choice(forest.SKETCH, g.integers(0, spread + 1), replace=False)
                row[at] = g.integers(0, 256, len(at))
            known = g.integers(0, n, n) if spread == 15 else np.arange(n)
            need = int(np.ceil(forest.LEAST_ALIKE * forest.SKETCH))
            near = (sketch[:, None] == sketch[None]).sum(axis=2) >= need
            near |= known[:, None] == known[None]
            want, got = _parts(near), forest.connect(sketch, known)
            assert (np.equal.outer(want, want) == np.equal.outer(got, got)).all()


def _template_texts(n, shared=110, own=85):
    """Texts that share a page template: about 0.39 alike, no two of them near duplicates."""
    base = words(shared, 1)
    return [(k, " ".join(base + words(own, 1000 + k, vocab=1 << 40))) for k in range(n)]


def test_template_texts_give_no_cluster(make_docs):
    rows = _template_texts(1500)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows[:2]]
    alike = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert 0.35 < alike < 0.45
    docs = make_docs(rows)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("unit"))
    units = texts.mapInArrow(forest._labels(forest.TREES, forest.DEPTH, 5),
                             "doc_id long, unit long, label binary, sketch binary")
    assert forest.candidates(units).count() <= 3
    got = forest.jaccard_join(docs)
    assert got.where("class_id != doc_id OR n_links > 0").count() == 0


def _edited(w, n, r):
    """A copy of the words with ``n`` of them replaced, five or more apart."""
    out = list(w)
    for at in r.sample(range(0, len(w) // 6), n):
        out[6 * at] = f"e{r.randrange(1 << 40)}"
    return out


@pytest.mark.parametrize("edits, least", [(4, 0.999), (8, 0.99)])
def test_recall_on_planted_pairs(make_docs, edits, least):
    """Pairs at a similarity of about 0.90 and 0.81: ``edits`` words of 372 replaced, five shingles each."""
    r = random.Random(edits)
    rows = []
    for k in range(700):
        w = words(372, 5000 + k, vocab=1 << 40)
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(_edited(w, edits, r)))]
    got = {x.doc_id: (x.class_id, x.n_links) for x in forest.jaccard_join(make_docs(rows)).collect()}
    linked = sum(got[2 * k + 1] == (2 * k, 1) for k in range(700))
    assert linked >= least * 700
    assert all(c == d or (c == d - 1 and d % 2) for d, (c, _) in got.items())  # nothing else is linked


def test_levels_find_what_full_banding_finds(spark, make_docs):
    """A chain of edits and groups of copies: the classes are those of all pairs, also in tiny node blocks."""
    r = random.Random(7)
    rows, w = [], words(300, 9)
    for k in range(60):
        w = _edited(w, 2, r)
        rows.append((k, " ".join(w)))
    rows += [(100 + k, " ".join(words(40, 50 + k % 3))) for k in range(30)]
    docs = make_docs(rows)
    got = {x.doc_id: (x.class_id, x.n_links) for x in forest.jaccard_join(docs).collect()}
    sets = {t: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows}
    texts = list(sets)
    near = np.array([[len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 for b in texts] for a in texts])
    comp = _parts(near)
    first = {}
    for d, t in rows:
        first.setdefault(comp[texts.index(t)], d)
    want = {d: (first[comp[texts.index(t)]], int(near[texts.index(t)].sum()) - 1) for d, t in rows}
    assert got == want
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("unit"))
    units = texts.mapInArrow(forest._labels(forest.TREES, forest.DEPTH, 5),
                             "doc_id long, unit long, label binary, sketch binary").dropDuplicates(["unit"]).cache()
    found = [{x.node: x.root for x in forest.components(forest.candidates(units, node_block=block)).collect()}
             for block in (4096, 7)]  # a node is one block, or many
    assert found[0] == found[1] and len(found[0]) == 60
