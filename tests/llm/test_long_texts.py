"""Long texts are worked on in pieces: the same results, and memory that does not follow the text's bytes many times."""

import json
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tremolo.llm import langid, prefixfree, tokens


def _slice(text):
    return next(tokens.slices(pa.array([text])))


def test_pieces_cover_the_text():
    raw = " ".join(words(4000, 3))
    s = _slice(raw)
    for limit, overlap in ((100, 0), (100, 7), (5000, 399), (10 ** 6, 3)):
        parts = list(tokens.pieces(s, limit, overlap))
        assert b"".join(p.data.tobytes()[overlap if k else 0:] for k, (p, _) in enumerate(parts)) == raw.encode()
        assert all(p.data.tobytes() == raw.encode()[at:at + len(p.data)] for p, at in parts)
    breaks = ~tokens.SPACE_WORD
    parts = [p.data.tobytes() for p, _ in tokens.pieces(s, 100, 0, breaks)]
    assert len(parts) > 100 and all(p.endswith(b" ") for p in parts[:-1])
    assert len(list(tokens.pieces(_slice("x" * 5000), 100, 0, breaks))) == 1  # nowhere to cut


def test_results_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(words(20_000, 5)) + " Ünï cödé ẞ ççç " + "z" * 3000 + " " + " ".join(words(900, 5))
    s = _slice(text)
    whole_hashes = s.words(tokens.SPACE_WORD).hashes()
    whole_grams = langid.grams(s)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 1000)
    monkeypatch.setattr(langid, "SLICE", 1000)
    assert (s.words(tokens.SPACE_WORD).hashes() == whole_hashes).all()
    for a, b in zip(langid.grams(s), whole_grams, strict=True):
        assert np.array_equal(a, b)


@pytest.mark.parametrize("piece", [1000, 1 << 20])
def test_byte_windows_in_pieces(make_docs, monkeypatch, piece):
    """Every 400-byte string lies in one piece, whatever the pieces are (in the process that runs the tasks
    the size is the module's own, so the phrases are made here)."""
    monkeypatch.setattr(prefixfree, "SLICE", piece)
    text = " ".join(words(6000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array([text, "ab" * 300]), pa.array([5, 6]), pa.array([0, 0])],
                                       names=["text", "doc", "check"])
    seen = {5: set(), 6: set()}
    for got in prefixfree._phrases(400, 48, np.zeros(0, np.uint64))(iter([batch])):
        for doc, place, n in zip(got["doc"].to_pylist(), got["place"].to_pylist(), got["n"].to_pylist(), strict=True):
            mine = set(range(place, place + n))
            assert not mine & seen[doc]
            seen[doc] |= mine
    assert seen == {5: set(range(len(text) - 399)), 6: set(range(201))}


_PEAK = """
import json, resource, sys
import numpy as np, pyarrow as pa
sys.path.insert(0, {root!r})
from tremolo.llm import decontaminate, langid, prefixfree, tokens
rng = np.random.default_rng(1)
vocab = np.array([f"w{{k:x}}" for k in range(50000)])
text = " ".join(vocab[rng.integers(0, 50000, 12_000_000)])
batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([1]), pa.array([0])], names=["text", "doc", "check"])
del vocab
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if {what!r} == "phrases":
    n = sum(b.num_rows for b in prefixfree._phrases(400, 48, np.zeros(0, np.uint64))(iter([batch])))
elif {what!r} == "grams":
    n = len(langid.grams(next(tokens.slices(batch["text"])))[0])
else:
    n = len(next(tokens.slices(batch["text"])).words(tokens.ALNUM_WORD, lower=True).hashes())
print(json.dumps([len(text), n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024]))
"""


@pytest.mark.parametrize("what, most", [("phrases", 6), ("grams", 6), ("words", 14)])
def test_memory_of_a_64_mb_text(what, most):
    """Peak memory beyond the text, in multiples of its bytes (it was 90, 95 and 45)."""
    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", _PEAK.format(root=root, what=what)], capture_output=True,
                         text=True, check=True, timeout=300).stdout
    size, n, peak = json.loads(out)
    assert size > 60_000_000 and n > 0
    assert peak < most * size, peak / size
